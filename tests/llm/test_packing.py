import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textloom.llm import packing
from textloom.llm.packing import encoder, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
WEIRD = ["", " ", "a", "a b", "a  b", " a", "a ", "a\nb", "a\n\nb", "a \nb", "a\n b", "\n", "\na", "a\n", "it's a b", "a  b", "<|endoftext|> x <|endoftext|>", "tab\tx y", "12 3.4%", "éè 中文 \U0001f600 x", "a\x1cb", "\x85 a"]


def test_memoised_ids_equal_the_tokenizer():
    rng = random.Random(1)
    texts = WEIRD + ["".join(rng.choice(["a", " ", "\n", ".", "'s", "Zq", "é", "7", "\t"]) for _ in range(40)) for _ in range(500)]
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(PATH).many(texts)] == want


@pytest.mark.parametrize("size,windows,min_cut", [(2048, 16, 8), (32, 2, 1), (32, 3, 5)])
def test_each_id_lies_in_one_piece(spark, size, windows, min_cut):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(WEIRD)] + [(100 + i, "word " * rng.randrange(1, 200)) for i in range(60)]
    rows += [(500, None), (501, "x y z " * 6000), (None, "no id"), (7, WEIRD[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = pack_documents(docs, PATH, size, windows, 1, min_cut, fan_in=3).collect()
    tok = Tokenizer.from_file(PATH)
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    seen, sequences = {}, {}
    for r in out:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(piece) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in ids.items():
        copies = sum(d == e for e, _ in rows)
        assert sorted(k for s, n in seen[d] for k in range(s, s + n)) == sorted(list(range(len(x))) * copies)
    padded = 0
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
        padded += 0 if at & (at - 1) == 0 else size - at
    assert padded <= len(sequences) * (min_cut - 1)


def test_empty_table_and_extra_columns(spark):
    schema = "doc_id long, text string, ids int, start string, offset int"
    assert pack_documents(spark.createDataFrame([], schema), PATH).count() == 0
    out = pack_documents(spark.createDataFrame([(3, "a b", 1, "x", 2)], schema), PATH).collect()
    assert sum(r.length for r in out) == 3 and out[0].start == 0
    assert packing.MEMO_WORDS > 0


def test_pieces_are_encoded_once_as_lines_within_a_bounded_memo(monkeypatch):
    """Words go to the tokenizer together and once while the memo holds them; the memo's bound counts pieces of both kinds."""
    made = packing.Encoder(PATH)
    odd = ["x\ty", "\tq r", "r\t", "\x1cz", "", "nul\0 and\nnul", "\u3000w v", "a\n<|endoftext|> b<|endoftext|>\n<|endoftext|>c"]
    texts = [" ".join(f"w{i * j}x," for j in range(40)) + f"\nline{i} end\nx" for i in range(100)] + odd
    want = [made.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    calls, encode = [], made.encode
    monkeypatch.setattr(made, "encode", lambda t: calls.extend(t) or encode(t))
    assert [np.frombuffer(b, "<u4").tolist() for b in made.many(texts)] == want
    assert len(calls) < 20  # one text of lines a lead; words with white space and texts with more of it are alone
    calls.clear()
    assert [np.frombuffer(b, "<u4").tolist() for b in made.many(texts[:100])] == want[:100] and not calls
    monkeypatch.setattr(packing, "MEMO_WORDS", 400)
    for t, ids in zip(texts, want):
        assert np.frombuffer(made.many([t])[0], "<u4").tolist() == ids
    assert len(made.memo) <= 200 and len(made.old) <= 2000


def test_words_of_letters_go_to_the_model_without_the_split(monkeypatch):
    """Words of letters, with a tail or not, cost one call of the model; a tail is encoded once."""
    made = packing.Encoder(PATH)
    texts = ["Thonre éèle, ßüñ.\nÇa ǅa: x?! Ɛnd", "éèle. Thonre,\néèle;", "ªµº ÿ÷ÿ a×b Āɏ!!! xyz....", "a.b x). don't, it's. 'tis 7, x7. Ж, ɐb."]
    want = [made.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    calls, encode = [], made.encode
    monkeypatch.setattr(made, "encode", lambda t: calls.extend(t) or encode(t))
    assert [np.frombuffer(b, "<u4").tolist() for b in made.many(texts[:2])] == want[:2]
    assert sorted(calls) == [",", ".", ":", ";", "?!"]
    assert [np.frombuffer(b, "<u4").tolist() for b in made.many(texts)] == want


def test_white_space_in_a_row_is_found_beside_other_white_space():
    made = packing.Encoder(PATH)
    for t in ["a\tb  c", "x　y \n", "a\xa0b\n\nc", " \nq", "a\x1fb c", " a\n", "a \tb"]:
        assert np.frombuffer(made.many([t])[0], "<u4").tolist() == made.tokenizer.encode(t, add_special_tokens=False).ids


def test_idle_workers_hold_no_words(spark):
    """Spark keeps workers, so what a task remembered must not outlive it."""
    docs = spark.createDataFrame([(i, f"thonre{'abcdefghij'[i % 10]} erinand x{i}") for i in range(400)], "doc_id long, text string").repartition(8)
    assert pack_documents(docs, PATH).count() >= 400

    def held(batches):
        from textloom.llm.packing import _encoders

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(e.memo) + len(e.old) for e in _encoders.values())] * b.num_rows})

    assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}
