"""Bounded-space packing of token sequences, with a byte-level BPE vocabulary file as a parameter."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .memos import claim, register, release

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words kept by a task with their ids, half of them in a young generation; when it is full it becomes the old one.
MEMO_WORDS = 120_000
#: Letters of a word that is kept; longer ones are encoded again.
MEMO_LETTERS = 64
#: Text encoded at a time.
PART_BYTES = 2 << 20
#: Words encoded as lines of one text.
LINES = 2_000
#: Stands for a newline before a piece; texts that hold it are encoded whole.
MARK = "\0"
#: A word of letters (in every version of Unicode) and what may end it, which the byte-level split takes by itself.
WORD = r"^(?P<word>\x00?[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<tail>[.,;:!?]{0,3})$"
#: The byte-level alphabet: what stands for each byte that doesn't stand for itself.
BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
_SPACE, _TWO_SPACES = re.compile(r"\s"), re.compile(r"\s\s")
_encoders: dict[str, Encoder] = {}
register("packing", _encoders)


class Encoder:
    """Texts to little-endian uint32 ids by a tokenizer file.

    The vocabulary's own split never crosses a lone space (it opens the next word) or a lone newline, so
    ids of such pieces are looked up and joined: a piece is a word after a space, or a newline, written MARK,
    and the word after it. Each piece of a part is looked up once, as Arrow counts a part's distinct ones, and
    what ends a word of letters is looked up apart. Such a word is one piece of the byte-level split, so the
    model gets it without that split. A bounded memo keeps words. A text with two white-space characters in a
    row goes to the tokenizer whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.newline = self.encode(["\n"])[0]
        split = self.tokenizer.pre_tokenizer
        byte_level = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = any(all(c.isalpha() or c in ".,;:!? \n" for c in t) for t in added)  # it may lie in a word
        self.direct = isinstance(self.model, models.BPE) and byte_level and self.tokenizer.normalizer is None and not own

    def forget(self) -> None:
        """Called as a task ends, as Spark keeps idle workers: what it remembered goes back to the system."""
        self.memo, self.old = {}, {}
        release()

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def encode_lines(self, words: list[str]) -> list[bytes]:
        """`encode` of words that hold no white space but a leading space: as lines of one text, which costs less than a text each."""
        out: list[bytes] = []
        for at in range(0, len(words), LINES):
            some = words[at : at + LINES]
            ids = np.frombuffer(self.encode(["\n".join(some)])[0], "<u4")
            ends = np.flatnonzero(ids == np.frombuffer(self.newline, "<u4")[0])
            if len(self.newline) != 4 or len(ends) != len(some) - 1:  # a vocabulary whose newline is no id of its own
                out += self.encode(some)
                continue
            raw, cuts = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
            out += [raw[i + 4 : j] for i, j in itertools.pairwise(cuts)]
        return out

    def encode_letters(self, words: list[str], lead: str) -> list[bytes]:
        """`encode` of words of letters after `lead`, a space or nothing."""
        lead, model = lead.translate(BYTES), self.model
        mapped = [lead + (w if w.isascii() else w.encode().decode("latin-1").translate(BYTES)) for w in words]
        return [array("I", [t.id for t in model.tokenize(w)]).tobytes() for w in mapped]

    def _new(self, words: list[str], mark: str, letters: bool) -> list[bytes]:
        """The ids of words after a space, or of a newline and the word after it, by the tokenizer."""
        lead = "" if mark else " "
        if letters:
            found = self.encode_letters(words, lead)
        else:
            odd = [not w or bool(_SPACE.search(w)) for w in words]
            alone = iter(self.encode([lead + w for w in itertools.compress(words, odd)]))
            lined = iter(self.encode_lines([lead + w for w, o in zip(words, odd, strict=True) if not o]))
            found = [next(alone if o else lined) for o in odd]
        return [self.newline + ids for ids in found] if mark else found

    def _make_room(self) -> None:
        if len(self.memo) >= MEMO_WORDS // 2:
            self.old, self.memo = self.memo, {}

    def _look_up(self, words: list[str], letters: list[bool]) -> list[bytes]:
        """The ids of distinct words. Those of the old generation that are used again come back, so frequent ones stay."""
        self._make_room()
        found = list(map(self.memo.get, words))
        again = [i for i, ids in enumerate(found) if ids is None]
        for i in again:
            found[i] = self.old.get(words[i])
        missing = [i for i in again if found[i] is None]
        for kind in (False, True):
            for mark in (MARK, ""):
                places = [i for i in missing if letters[i] == kind and words[i].startswith(MARK) == bool(mark)]
                for i, ids in zip(places, self._new([words[i].removeprefix(MARK) for i in places], mark, kind), strict=True):
                    found[i] = ids
        for i in again:
            if len(words[i]) <= MEMO_LETTERS:
                self._make_room()
                self.memo[words[i]] = found[i]
        return found

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces."""
        if not self.direct:
            words = _strings(pieces)
            return pa.array(self._look_up(words, [False] * len(words)), pa.large_binary())
        cut = pc.extract_regex(pieces, WORD)
        letters = cut.is_valid()
        words = pc.if_else(letters, pc.struct_field(cut, "word"), pieces).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(cut, "tail"), "").dictionary_encode()
        is_word = np.zeros(len(words.dictionary), bool)
        is_word[words.indices.to_numpy()] = letters.to_numpy(zero_copy_only=False)
        ids = pa.array(self._look_up(_strings(words.dictionary), is_word.tolist()), pa.large_binary()).take(words.indices)
        for tail in _strings(tails.dictionary):
            if tail not in self.tails:
                self.tails[tail] = self.encode([tail])[0]
        ends = pa.array([self.tails[t] for t in _strings(tails.dictionary)], pa.large_binary()).take(tails.indices)
        return pc.binary_join_element_wise(ids, ends, pa.scalar(b"", pa.large_binary()))

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        whole = [_spaced(t) or MARK in t for t in texts]
        marked = [MARK if w else MARK + t.replace("\n", " " + MARK) for t, w in zip(texts, whole, strict=True)]
        pieces = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        at, coded = pieces.offsets.to_numpy(), pieces.values.dictionary_encode()
        del marked, pieces
        ids = self._ids(coded.dictionary).take(coded.indices)
        _, starts, data = ids.buffers()
        data = memoryview(data) if data is not None else memoryview(b"")
        ends = np.frombuffer(starts, "<i8")[at].tolist()
        skip = len(self.newline)  # that of the first piece of each text
        return [self.encode([t])[0] if w else bytes(data[i + skip : j]) for t, w, (i, j) in zip(texts, whole, itertools.pairwise(ends), strict=True)]


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _spaced(text: str) -> bool:
    """Whether two white-space characters are in a row."""
    if text.replace("\n", "").isprintable():  # no other white space than spaces and newlines, which are found faster than by pattern
        return any(pair in text for pair in ("  ", "\n\n", " \n", "\n "))
    return _TWO_SPACES.search(text) is not None


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; its memo is a task's."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """A fixed number of open windows. put() places best-fit; when nothing fits and all are open, the
    fullest is topped up with the head of what comes and emitted."""

    def __init__(self, size: int, windows: int, min_cut: int, emit: Callable[[list], None]) -> None:
        self.size, self.windows, self.min_cut, self.emit = size, windows, min_cut, emit
        self.open: list[list] = []  # [tokens used, pieces]

    def put(self, piece: tuple, cut: Callable[[tuple, int], tuple[tuple, tuple]]) -> None:
        """piece: any tuple whose first item is its number of tokens; cut splits one at a token."""
        while piece[0] >= self.size:
            head, piece = cut(piece, self.size)
            self.emit([head])
        while piece[0]:
            n = piece[0]
            fit = max((w for w in self.open if w[0] + n <= self.size), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.windows:
                self.open.append(fit := [0, []])
            if fit is not None:
                fit[0] += n
                fit[1].append(piece)
                if fit[0] == self.size:
                    self.open.remove(fit)
                    self.emit(fit[1])
                return
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            if self.size - fullest[0] >= self.min_cut:
                head, piece = cut(piece, self.size - fullest[0])
                fullest[1].append(head)
            self.emit(fullest[1])


def pack_documents(
    docs: DataFrame, vocabulary: str, size: int = 2048, windows: int = 16, end_id: int = 1, min_cut: int = 8, fan_in: int = 64
) -> DataFrame:
    """Packs the ids of `docs` (doc_id, text) into sequences of at most `size`; a row per piece.

    A document is its ids by the tokenizer file `vocabulary`, then `end_id`; a null text is empty, so one
    id. Longer documents fill sequences of their own and the rest is placed best-fit in one of `windows`
    open windows of the partition. When none fits, the fullest is topped up with the head of the document
    (gaps under `min_cut` stay padding) and emitted, so a worker holds at most `windows` x `size` ids.
    The windows left open, a bounded number per partition, are checkpointed with their ids and merged by
    groups of `fan_in` partitions in the same way; a group's last partial sequence is cut at powers of
    two, which need no padding. sequence_id is unique, not dense. Null doc_ids stay null, repeated
    documents are packed each, an empty table gives no rows, other columns are left out."""
    packed = checkpointed(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            lambda batches: _pack_partition(batches, vocabulary, size, windows, end_id, min_cut), f"{PIECES}, ids binary"
        )
    )
    done = packed.where("ids is null").drop("ids")
    left = packed.where("ids is not null").withColumn("crew", F.expr(f"(sequence_id >> 36) div {fan_in}"))
    left = left.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn null ids and their like to floats
    merged = left.groupBy("crew").applyInPandas(lambda pdf: _merge(pdf, size, min_cut), PIECES)
    return done.unionByName(merged)


def _pack_partition(
    batches: Iterator[pa.RecordBatch], vocabulary: str, size: int, windows: int, end_id: int, min_cut: int
) -> Iterator[pa.RecordBatch]:
    claim("packing")
    encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
    base = TaskContext.get().partitionId() << 36
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")] + [("ids", pa.binary())])
    rows: list[tuple] = []
    count = 0

    def emit(pieces: list, keep: bool = False) -> None:
        nonlocal count
        offset = 0
        for n, doc, start, ids, total in pieces:
            rows.append((doc, start, n, zlib.crc32(ids), total, base + count, offset, ids if keep else None))
            offset += n
        count += 1

    def cut(p: tuple, k: int) -> tuple[tuple, tuple]:
        n, doc, start, ids, total = p
        return (k, doc, start, ids[: 4 * k], total), (n - k, doc, start + k, ids[4 * k :], total)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()
        return batch

    packer = Packer(size, windows, min_cut, emit)
    for batch in batches:
        for part in _parts(batch):
            for doc, ids in zip(part.column(0).to_pylist(), encode.many([t or "" for t in part.column(1).to_pylist()]), strict=True):
                ids += end
                packer.put((n := len(ids) // 4, doc, 0, ids, n), cut)
            if len(rows) >= 20_000:
                yield flush()
    encode.forget()
    for _, pieces in packer.open:
        emit(pieces, keep=True)
    if rows:
        yield flush()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about PART_BYTES of text, or one row where that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        n = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")) - at, 1)
        yield batch.slice(at, n)
        at += n


def _merge(pdf: pd.DataFrame, size: int, min_cut: int) -> pd.DataFrame:
    """Merges leftover windows, fullest first; a piece here is (tokens, parts) and is cut between or inside parts."""
    out: list[tuple] = []
    crew, count = int(pdf["crew"].iat[0]), 0

    def emit(pieces: list) -> None:
        nonlocal count
        offset = 0
        for _, parts in pieces:
            for n, doc, start, ids, total in parts:
                out.append((doc, start, n, zlib.crc32(ids), total, (1 << 62) + (crew << 24) + count, offset))
                offset += n
        count += 1

    def cut(piece: tuple, k: int) -> tuple[tuple, tuple]:
        head, tail, left = [], [], k
        for n, doc, start, ids, total in piece[1]:
            m = min(n, left)
            if m:
                head.append((m, doc, start, ids[: 4 * m], total))
            if n > m:
                tail.append((n - m, doc, start + m, ids[4 * m :], total))
            left -= m
        return (k, head), (piece[0] - k, tail)

    packer = Packer(size, 1 << 30, min_cut, emit)
    left = []
    for _, w in pdf.sort_values(["sequence_id", "offset"]).groupby("sequence_id", sort=True):
        docs = [None if pd.isna(d) else int(d) for d in w["doc_id"]]
        parts = list(zip(map(int, w["length"]), docs, map(int, w["start"]), map(bytes, w["ids"]), map(int, w["doc_tokens"]), strict=True))
        left.append((sum(p[0] for p in parts), parts))
    packer.windows = 1  # with all leftovers at hand, one window that is topped up leaves one partial sequence
    packer.min_cut = 1
    for piece in sorted(left, key=lambda p: -p[0]):
        packer.put(piece, cut)
    for used, pieces in packer.open:
        rest = (used, [x for p in pieces for x in p[1]])
        while rest[0]:
            head, rest = cut(rest, 1 << (rest[0].bit_length() - 1))
            emit([head])
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
    return frame.astype({c: "Int64" for c in frame.columns})
