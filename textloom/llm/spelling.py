"""Spelling variants: words one edit apart, found by walking tries with a distance-one Levenshtein automaton."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, checkpointed

#: A run of letters; one byte a letter in Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
#: One of so many runs of a document loses a letter.
ONE_IN = 97
#: Distinct words counted in a task before they are handed on.
COUNT_WORDS = 200_000
#: Words of a trie shard.
SHARD_WORDS = 50_000

NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _count(batches: Iterator[pa.RecordBatch], least: int, one_in: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's whole texts, a word once or more."""
    runs = re.compile(f"[{LETTERS}]{{{max(least, 1)},}}")  # a shorter run never makes a word
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            start = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
            text = text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")  # bytes lower-case A-Z alone
            for run, n in Counter(runs.findall(text)).items():
                h = zlib.crc32(run.encode(), start)
                if not h % one_in:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < least:
                        continue
                total[run] += n
            if len(total) >= COUNT_WORDS:
                yield flush()
    if total:
        yield flush()


class Trie:
    """A compact trie over sorted distinct words: nodes in breadth-first order, so that a node's children are neighbours, and
    a single word ends a branch at once.

    labels: a node's letter; first: where its children begin (the next node's begin there it ends); at: the word of a
    leaf, or the one that ends in an inner node, else -1."""

    def __init__(self, words: list[bytes], n: list[int], labels: bytes, first: array, at: array) -> None:
        self.words, self.n, self.labels, self.first, self.at = words, n, labels, first, at

    @classmethod
    def of(cls, words: list[bytes], n: list[int]) -> Trie:
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        lo, hi, depth = np.zeros(1, np.int64), np.full(1, len(words), np.int64), 0
        labels, first, at, placed = [np.zeros(1, np.uint8)], [], [], 1
        while len(lo):
            single = hi - lo == 1
            ends = ~single & (sizes[lo] == depth)  # the first word of a sorted range is the shortest of its prefixes
            at.append(np.where(single | ends, lo, -1))
            lo, hi = lo + ends, np.where(single, lo, hi)
            held = hi - lo
            node = np.repeat(np.arange(len(lo)), held)
            word = np.arange(len(node)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(lo, held)
            letter = text[starts[word] + depth]
            opens = np.ones(len(word), bool)
            opens[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
            cut = np.flatnonzero(opens)
            children = np.bincount(node[cut], minlength=len(lo))
            first.append(placed + np.cumsum(children) - children)
            placed += len(cut)
            labels.append(letter[cut])
            lo = word[cut]
            hi = np.append(word[cut[1:] - 1], word[-1:]) + 1 if len(cut) else lo
            depth += 1
        flat = lambda parts: array("i", np.concatenate(parts).astype(np.int32).tobytes())
        return cls(words, n, np.concatenate(labels).tobytes(), flat([*first, np.array([placed])]), flat(at))

    def packed(self) -> tuple[bytes, ...]:
        return b"\n".join(self.words), np.array(self.n, "<i8").tobytes(), self.labels, self.first.tobytes(), self.at.tobytes()

    @classmethod
    def unpacked(cls, words: bytes, n: bytes, labels: bytes, first: bytes, at: bytes) -> Trie:
        return cls(words.split(b"\n"), np.frombuffer(n, "<i8").tolist(), labels, array("i", first), array("i", at))

    def _rest(self, word: bytes, i: int, node: int, depth: int) -> int:
        """The automaton after its edit: the word that continues `node` with exactly word[i:], or -1."""
        first, labels = self.first, self.labels
        while True:
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                found = self.at[node]
                return found if self.words[found][depth:] == word[i:] else -1
            if i == len(word):
                return self.at[node]
            node = labels.find(word[i], lo, hi)
            if node < 0:
                return -1
            i += 1
            depth += 1

    def near(self, word: bytes) -> set[int]:
        """Indices of the words that one inserted, deleted or replaced letter makes of `word`.

        The automaton's states are (letters read, edits made) and its walk is depth first: along the branch that spells the word
        no edit is made; from each of its nodes one is tried with every child, after which the rest must be spelled exactly."""
        first, labels, at, words = self.first, self.labels, self.at, self.words
        out, node, size = set(), 0, len(word)
        for i in range(size + 1):
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                if one_edit(word, words[at[node]], i):
                    out.add(at[node])
                break
            if i + 1 == size and at[node] >= 0:
                out.add(at[node])  # the last letter is deleted
            elif i + 1 < size:
                out.add(self._rest(word, i + 1, node, i))
            letter, after = word[i] if i < size else -1, word[i + 1] if i + 1 < size else -1
            for child in range(lo, hi):
                below, end = first[child], first[child + 1]
                if below == end:
                    if one_edit(word, words[at[child]], i):
                        out.add(at[child])
                    continue
                if letter < 0 or labels.find(letter, below, end) >= 0:
                    out.add(self._rest(word, i, child, i + 1))  # the child's letter is inserted
                if letter >= 0 and labels[child] != letter and (after < 0 or labels.find(after, below, end) >= 0):
                    out.add(self._rest(word, i + 1, child, i + 1))  # or replaces the word's
            if i == size:
                break
            node = labels.find(letter, lo, hi)
            if node < 0:
                break
        out.discard(-1)
        return out


def one_edit(a: bytes, b: bytes, same: int = 0) -> bool:
    """Whether `a` and `b`, whose first `same` letters are equal, are exactly one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i, most = same, len(a)
    while i < most and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    """A row for each trie over up to `shard_words` consecutive words of a sorted task."""
    words, n = [], []

    def flush() -> pa.RecordBatch:
        made = Trie.of(words, n).packed()
        words.clear()
        n.clear()
        return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in made], ["words", "n", "labels", "first", "at"])

    for batch in batches:
        for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.append(word.encode("latin-1"))
            n.append(count)
            if len(words) == shard_words:
                yield flush()
    if words:
        yield flush()


def _walk(batches: Iterator[pa.RecordBatch], shards: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
    """(word, near, form_n, form): how many words of these shards are near, and the most frequent of them. Shard by shard over
    a batch, so that one trie is unpacked at a time."""
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        found: dict[int, tuple[int, int, bytes]] = {}
        for shard in shards:
            trie = Trie.unpacked(*shard)
            for i, word in enumerate(words):
                if hits := trie.near(word):
                    n, form = min((-trie.n[j], trie.words[j]) for j in hits)
                    count, best, best_form = found.get(i, (0, 1, b""))
                    found[i] = (count + len(hits), *min((n, form), (best, best_form)))
        rows = [(words[i].decode("latin-1"), near, -n, form.decode("latin-1")) for i, (near, n, form) in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, NEAR, strict=True)], schema=NEAR)


def _near_words(words: DataFrame, shard_words: int, broadcast_bytes: int) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have a near word.

    Tries of consecutive words are built in tasks and stored. They are broadcast in rounds of at most `broadcast_bytes`, measured
    before they are fetched, and every word walks every shard; counts add up and best forms compete over the rounds."""
    spark = words.sparkSession
    ordered = words.repartitionByRange("word").sortWithinPartitions("word").select("word", "n")
    shards = ordered.mapInArrow(lambda b: _shards(b, shard_words), "words binary, n binary, labels binary, first binary, at binary")
    shards = checkpointed(shards.withColumn("shard", F.monotonically_increasing_id()))
    size = sum((F.octet_length(c) for c in ("words", "n", "labels", "first", "at")), F.lit(0))
    rounds, room = [[]], 0
    for r in shards.select("shard", size.alias("b")).orderBy("shard").toLocalIterator():  # two numbers a shard
        if rounds[-1] and room + r["b"] > broadcast_bytes:
            rounds.append([])
            room = 0
        rounds[-1].append(r["shard"])
        room += r["b"]
    parts = []
    for ids in filter(None, rounds):
        held = shards.where(F.col("shard").between(ids[0], ids[-1])).select("words", "n", "labels", "first", "at").collect()
        sent = spark.sparkContext.broadcast([tuple(map(bytes, r)) for r in held])
        found = words.select("word").mapInArrow(lambda b, sent=sent: _walk(b, sent.value), "word string, near long, form_n long, form string")
        parts.append(checkpointed(found))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return both.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): forms followed to the last, twice as far in each round. A form has at least
    twice the word's count, so no chain is longer than a long has bits and six rounds reach its end."""
    found = checkpointed(links.select("word", F.col("form").alias("root")))
    for _ in range(6):
        on = found.select(F.col("word").alias("via"), F.col("root").alias("far"))
        longer = found.join(on, F.col("root") == F.col("via"), "left")
        if found.join(on, F.col("root") == F.col("via"), "left_semi").isEmpty():
            break
        found = checkpointed(longer.select("word", F.coalesce("far", "root").alias("root")))
    return found


def spelling_variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, one_in: int = ONE_IN, shard_words: int = SHARD_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the whole texts of `docs` (doc_id, text).

    Runs of letters A-Z, a-z and U+00C0 to U+00FF are lower-cased (A-Z alone); by the crc32 of "doc_id:run" one of `one_in`
    runs of a document loses a letter. What then has `least_letters` and occurs `least_count` times in all is a word. Two
    words are near at exactly one inserted, deleted or replaced letter; n_near counts a word's near words. Its form is the most
    frequent of them (ties: first in code-point order) if that has at least twice its count; root follows forms to the last.

    Words are counted per task before they are shuffled. Tries over consecutive words are broadcast in rounds of bounded size,
    and each word's automaton walks all of them inside its task, which returns a count and a best form, never pairs.

    Null texts have no words; a null doc_id counts as an empty one; repeated rows count each; without words there are no rows;
    words of any length are kept; other columns are left out."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lambda b: _count(b, least_letters, one_in), "word string, n long")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    words = checkpointed(words)
    near = checkpointed(_near_words(words, shard_words, broadcast_bytes))
    joined = words.join(near.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    formed = F.when(F.col("form_n") >= 2 * F.col("n"), F.col("form"))
    joined = checkpointed(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed.alias("form"), F.when(formed.isNotNull(), F.col("form_n")).alias("form_n")))
    roots = _roots(joined.where("form is not null").select("word", "form")).withColumnRenamed("word", "of")
    out = joined.join(roots, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
