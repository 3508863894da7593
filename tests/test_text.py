import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import segment as S


def test_pieces_concatenate_and_offsets_slice_to_the_surface(spark):
    rng = random.Random(1)
    texts = ["", " ", "Он сказал: «Да». Она — нет...", "кто-то из-за угла", "чтò бо́льшая 3,14 и 2.5", "it's well-known\tx"] + ["".join(rng.choice("абЁ .,!?-—«»'\n9zé") for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("text", T.pieces(F.col("text")).alias("p")).collect():
        assert "".join(r.p) == r.text
    by_id = dict(enumerate(texts))
    for r in S.tokenize(df, ["doc_id"]).collect():
        assert by_id[r.doc_id][r.start : r.end] == r.surface


def plain_sentences(tokens):
    """Sentence numbers by walking the tokens, the rule as it reads."""
    out, k, cut = [], 0, set()
    closers, openers = "»\"”’)]", ("«", '"', "“", "„", "(", "—", "–")
    for i, (kind, s) in enumerate(tokens):
        if kind == "punct" and set(s) <= set(".!?…"):
            j = i + 1
            while j < len(tokens) and tokens[j][0] == "punct" and tokens[j][1] in closers:
                j += 1
            if j < len(tokens):
                word = next(((kd, x) for kd, x in tokens[j:] if kd != "punct"), None)
                opens = tokens[j][0] == "punct" and (tokens[j][1] in openers or set(tokens[j][1]) == {"-"})
                if opens or word is None or word[0] == "number" or word[1][0].isupper():
                    cut.add(j)
    for i in range(len(tokens)):
        k += i in cut
        out.append(k)
    return out


def test_sentence_windows_equal_the_walk(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["а", "Б", " ", " ", ".", "!", "»", "«", "—", "3", ")", "-"]) for _ in range(50)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.sentences(df, ["doc_id"]).orderBy("doc_id", "pos").collect()
    for d in range(len(texts)):
        mine = [r for r in rows if r.doc_id == d]
        assert [r.sentence for r in mine] == plain_sentences([(r.kind, r.surface) for r in mine])


@pytest.mark.parametrize(
    "word,key",
    [("Ёлка", "елка"), ("міръ", "мир"), ("ѳеатръ", "феатр"), ("чтò", "что"), ("сто́йте", "стойте"), ("объ", "об"), ("ъ", "ъ"), ("И’мя", "и'мя")],
)
def test_loose_key(spark, word, key):
    assert spark.createDataFrame([(word,)], "w string").select(T.loose_key(F.col("w"))).first()[0] == key


def test_scalars(spark):
    df = spark.createDataFrame([("Молоко'", "щи", "Хлѣбъ", "бо́льшая")], "a string, b string, c string, d string")
    r = df.select(
        T.split_accent(F.col("a")).alias("a"), T.transliterate(F.col("b")).alias("b"), T.is_pre_reform(F.col("c")).alias("c"), T.source_stress(F.col("d")).alias("d"),
        T.syllable_count(F.col("d")).alias("n"), T.with_acute(F.lit("молоко"), F.lit(5)).alias("w"), T.collapse_space(F.lit(" a \n b­ ")).alias("x"),
    ).first()
    assert (r.a.form, r.a.stress) == ("Молоко", 5) and r.b == "shchi" and r.c and r.d == 1 and r.n == 3 and r.w == "молоко́" and r.x == "a b"
