"""Removal of repeated and nearly repeated lines: segment-partition edit join over distinct lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, maybe_broadcast
from .memos import claim

#: Lines under this length are left alone.
MIN_CHARS = 10
#: Edits within which a line repeats another, and the characters a line must have for each edit allowed.
MAX_EDITS, CHARS_PER_EDIT = 2, 20
#: Lines per task whose hashes are remembered, so that their keys are sent once.
SEEN_LINES = 200_000
#: Keys and characters of one batch sent on.
BATCH_KEYS, BATCH_CHARS = 50_000, 1_000_000
#: Bits that one edit can flip: of the parities of a whole line, and of those of its stretches around a key.
LINE_FLIPS, FLIPS = 2, 3


def allowed_edits(length: int, max_edits: int) -> int:
    return min(max_edits, length // CHARS_PER_EDIT)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of `parts` even segments of a line, the longer ones last."""
    base, extra = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i >= parts - extra)
        out.append((at, n))
        at += n
    return out


@lru_cache(maxsize=8192)
def places(length: int, max_edits: int) -> tuple[tuple[int, int, int, int, int, bool], ...]:
    """(start, end, left, right, seed, own) of the substrings of a line that can equal a segment of one as long or up to
    `max_edits` shorter; its own segments are among them.

    If some segment survives the edits, one does at a shift that both the edits left of it and those right
    of it allow; only those shifts are probed. `left` and `right` are places half-way to the ends of the shorter line."""
    out = []
    for shorter in range(min(max_edits, length - 1) + 1):
        other = length - shorter
        for i, (at, n) in enumerate(segments(other, max_edits + 1)):
            right = max_edits - i
            for p in range(max(at - i, at + shorter - right, 0), min(at + i, at + shorter + right, length - n) + 1):
                q = p + n
                own = not shorter and p == at
                out.append((p, q, max(p - at // 2, 0), min(q + (other - at - n) // 2, length), other * 8 + i, own))
    return tuple(out)


@lru_cache(maxsize=8192)
def own_places(length: int, max_edits: int) -> tuple[tuple[int, int, int, int, int, bool], ...]:
    return tuple(x for x in places(length, max_edits) if x[-1])


@lru_cache(maxsize=8192)
def spots(length: int, max_edits: int, probe: bool) -> np.ndarray:
    """(left, start, end, right, length) of each of the places."""
    return np.array([(left, p, q, right, length) for p, q, left, right, _, _ in (places if probe else own_places)(length, max_edits)], np.int64)


def parities(codes: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 parity bits, by code point modulo 64, of each whole line, and 16 of each of its four stretches around a key.

    `codes` are the characters of all lines in a row, `at` the spots of each key in them, `start` where its line begins.
    A substitution flips two bits at most. An insertion or deletion flips one, and the character it pushes over the end
    of its stretch one on either side of it."""
    upto = np.zeros(len(codes) + 1, np.uint64)
    np.bitwise_xor.accumulate(np.uint64(1) << (codes & 63).astype(np.uint64), out=upto[1:])
    marks = upto[at]
    stretches = (marks[:, 0] ^ upto[start], marks[:, 1] ^ marks[:, 0], marks[:, 3] ^ marks[:, 2], marks[:, 4] ^ marks[:, 3])
    sides = np.zeros(len(at), np.uint64)
    for x in stretches:
        x = x ^ x >> np.uint64(32)
        sides = sides << np.uint64(16) | (x ^ x >> np.uint64(16)) & np.uint64(0xFFFF)
    return marks[:, 4] ^ upto[start], sides


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of two lines is at most k: common ends are cut off, then a bit-parallel
    automaton runs over the band of k diagonals on either side and stops once the band is empty."""
    if abs(len(a) - len(b)) > k:
        return False
    at, m = 0, min(len(a), len(b))
    while at < m and a[at] == b[at]:
        at += 1
    end = 0
    while end < m - at and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[at : len(a) - end], b[at : len(b) - end]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    states = [(1 << (d + 1)) - 1 for d in range(k + 1)]
    full = (1 << (len(a) + 1)) - 1
    for j, c in enumerate(b, 1):
        band = ((1 << (2 * k + 1)) - 1) << (j - k) if j >= k else (1 << (j + k + 1)) - 1
        band &= full
        eq, new = places.get(c, 0), []
        for d, s in enumerate(states):
            t = (s & eq) << 1
            if d:
                t |= states[d - 1] | states[d - 1] << 1 | new[d - 1] << 1
            new.append(t & band)
        states = new
        if not states[-1]:
            return False
    return bool(states[-1] >> len(a) & 1)


_LAST = (1 << 63) - 1


def _signed(xs: list[int]) -> np.ndarray:
    return np.array(xs, np.uint64).view(np.int64)


def _lines(text: str | None) -> Iterator[tuple[int, str, int, int]]:
    """(line number, line, two hashes) of the lines that count."""
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= MIN_CHARS:
            h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
            yield i, line, h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("lines")
    for batch in batches:
        row, no, h1, h2 = [], [], [], []
        for r, text in enumerate(batch.column("text")):
            for i, _, a, b in _lines(text.as_py()):
                row.append(r)
                no.append(i)
                h1.append(a)
                h2.append(b)
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(no, pa.int64()), pa.array(_signed(h1)), pa.array(_signed(h2))],
            ["doc_id", "key", "line_no", "h1", "h2"],
        )


def _keys(batches: Iterator[pa.RecordBatch], max_edits: int, probe: bool) -> Iterator[pa.RecordBatch]:
    """(k, h, line, sig, o, own): the keys of each wording, its hash, its parities as a whole and around each key, and the document where this task met it."""
    claim("lines")
    seen: set[int] = set()
    digest, which = xxhash.xxh3_64_intdigest, places if probe else own_places
    k, own, h, o, times, lines, at = [], [], [], [], [], [], []

    def flush() -> pa.RecordBatch:
        codes = np.frombuffer(b"".join(lines), "<u4")
        start = np.repeat(np.cumsum([0, *(len(x) // 4 for x in lines[:-1])]), times)
        whole, sides = parities(codes, np.concatenate(at) + start[:, None], start)
        each = [np.repeat(x, times) for x in (_signed(h), np.array(o, np.int64))]
        columns = [_signed(k), each[0], whole.view(np.int64), sides.view(np.int64), each[1]]
        batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(own, pa.bool_())], ["k", "h", "line", "sig", "o", "own"])
        for x in (k, own, h, o, times, lines, at):
            x.clear()
        return batch

    chars = 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for _, line, a, _ in _lines(text.as_py()):
                if a in seen or len(line) < CHARS_PER_EDIT:
                    continue
                if len(seen) > SEEN_LINES:
                    seen.clear()
                seen.add(a)
                data, found = line.encode("utf-32-le", "surrogatepass"), which(len(line), max_edits)
                k += [digest(data[4 * p : 4 * q], seed) for p, q, _, _, seed, _ in found]
                own += [x[-1] for x in found]
                lines.append(data)
                at.append(spots(len(line), max_edits, probe))
                h.append(a)
                o.append(_LAST if doc is None else doc)
                times.append(len(found))
                chars += len(line)
                if len(k) >= BATCH_KEYS or chars >= BATCH_CHARS:
                    chars = 0
                    yield flush()
    if k:
        yield flush()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, out = [], []
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            lines = text.as_py().split("\n")
            for w in wanted:
                h.append(w["h1"])
                out.append(lines[w["line_no"]])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(out, pa.string())], ["h1", "line"])


def _verify(batches: Iterator[pa.RecordBatch], max_edits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist()
        ok = [within(x, y, allowed_edits(min(len(x), len(y)), max_edits)) for x, y in zip(a, b, strict=True)]
        yield batch.select(["late"]).filter(pa.array(ok, pa.bool_()))


def _order(*more: Column | str) -> Column:
    """Corpus order: doc_id with nulls last, then the text's fingerprint, then the line."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), *more)


def repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc_id, key, gone_lines): line numbers to drop of each document, key being xxhash64 of its text.

    A line is dropped if an earlier one equals it, or if the first place of its wording comes after that
    of another wording within the edits allowed: one per 20 characters of the shorter line, `max_edits`
    at most. Order is doc_id, then line number. The rule isn't transitive and looks at the corpus as it
    is, so a line near a line that is itself dropped goes too. Lines under 10 characters stay.

    Candidates are lines of which a probed substring equals a segment of the other and whose character parities
    differ by few bits. First each probe meets only the first wording of its key, which settles most of a group
    of near copies. Pairs of which both lines are known to go need no look. For the rest, the keys with several
    wordings are subdivided by parts of the parities, one of which must agree."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").where("text is not null")
    occ = slim.mapInArrow(_occurrences, "doc_id long, key long, line_no long, h1 long, h2 long")
    first = checkpointed(occ.groupBy("h1", "h2").agg(F.min(_order(F.col("line_no"))).alias("first"), F.count("*").alias("n")))

    keyed = lambda probe: slim.select("doc_id", "text").mapInArrow(lambda b: _keys(b, max_edits, probe), "k long, h long, line long, sig long, o long, own boolean")
    earliest = lambda c: F.min_by(c, "o").alias(c)
    heads = keyed(False).groupBy("k").agg(*map(earliest, ("h", "line", "sig")), (F.min("h") != F.max("h")).alias("several"))
    heads = heads.withColumnsRenamed({"h": "a", "line": "line_a", "sig": "sig_a"})
    probes = keyed(True).select("k", F.col("h").alias("b"), F.col("line").alias("line_b"), F.col("sig").alias("sig_b"), "own")
    met = probes.join(heads, "k").where(_alike(max_edits) | F.col("several"))
    met = checkpointed(met.select("k", "b", "line_b", "sig_b", "own", "a", _alike(max_edits).alias("near"), "several"))
    near = _near(slim, first, _pairs(met.where("near")), max_edits)
    late = checkpointed(near.select("late").distinct())

    known = maybe_broadcast(late.select("late", F.lit(True).alias("known")))
    crowd = met.where("several").select("k", "b", "line_b", "sig_b", "own").distinct().join(known, F.col("b") == F.col("late"), "left")
    crowd = checkpointed(crowd.select("k", "b", "line_b", "sig_b", "own", F.coalesce("known", F.lit(False)).alias("known_b")))
    more, index = _parted(crowd, max_edits), _parted(crowd.where("own"), max_edits)
    index = index.select("part", *[F.col(f"{c}b").alias(f"{c}a") for c in ("", "line_", "sig_", "known_")])
    rest = more.join(index, "part").where(_alike(max_edits) & ~(F.col("known_a") & F.col("known_b")) & _first_equal(F.col("i"), max_edits))
    near = _near(slim, first, _pairs(rest), max_edits)
    late = checkpointed(late.unionByName(near.select("late")).distinct().withColumnRenamed("late", "h1"))

    judged = first.join(maybe_broadcast(late).withColumn("late", F.lit(True)), "h1", "left").where("n > 1 or late")
    judged = judged.select("h1", "h2", "first", F.coalesce("late", F.lit(False)).alias("late"))
    places = occ.join(maybe_broadcast(checkpointed(judged)), ["h1", "h2"])
    gone = places.where(F.col("late") | (_order("line_no") != F.col("first")))
    return gone.groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("gone_lines"))


def _alike(max_edits: int) -> Column:
    """Whether two lines a and b that share a key are different and their parities allow for the edits."""
    few = lambda kind, flips: F.bit_count(F.col(f"{kind}_a").bitwiseXOR(F.col(f"{kind}_b"))) <= flips * max_edits
    return (F.col("a") != F.col("b")) & few("line", LINE_FLIPS) & few("sig", FLIPS)


def _stretches(max_edits: int) -> list[tuple[int, int]]:
    """(first bit, mask) of the parts of a line's parities: one more than bits that the edits can flip."""
    width = -(-64 // (LINE_FLIPS * max_edits + 1))
    return [(at, (1 << width) - 1) for at in range(0, 64, width)]


def _parted(crowd: DataFrame, max_edits: int) -> DataFrame:
    """Rows with a key of each part of their parities within `k`; one part at least agrees where few bits differ."""
    part = lambda i, at, mask: F.xxhash64("k", F.lit(i), F.shiftrightunsigned("line_b", at).bitwiseAND(mask))
    parts = F.array(*[F.struct(F.lit(i).alias("i"), part(i, *x).alias("part")) for i, x in enumerate(_stretches(max_edits))])
    return crowd.select("b", "line_b", "sig_b", "known_b", F.explode(parts).alias("p")).select("b", "line_b", "sig_b", "known_b", "p.*")


def _first_equal(i: Column, max_edits: int) -> Column:
    """Whether part `i` is the first that agrees, so that a pair meets once for each key."""
    d = F.col("line_a").bitwiseXOR(F.col("line_b"))
    return F.coalesce(*[F.when(F.shiftrightunsigned(d, at).bitwiseAND(mask) == 0, F.lit(n)) for n, (at, mask) in enumerate(_stretches(max_edits))]) == i


def _pairs(rows: DataFrame) -> DataFrame:
    return checkpointed(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _near(slim: DataFrame, first: DataFrame, pairs: DataFrame, max_edits: int) -> DataFrame:
    """(late): of each pair of wordings within the edits allowed, the one whose first place is later.

    Texts come from the first place of each wording; equal 64-bit hashes of unequal lines are told apart there."""
    asked = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct()
    places = first.join(maybe_broadcast(checkpointed(asked)), "h1").select("h1", "first.*")
    wanted = checkpointed(places.groupBy("doc_id", "key").agg(F.collect_list(F.struct("h1", "line_no")).alias("wanted")))
    wanted = maybe_broadcast(wanted).withColumnsRenamed({"doc_id": "w_doc", "key": "w_key"})
    held = slim.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("key") == F.col("w_key")))
    lines = held.select("text", "wanted").mapInArrow(_fetch, "h1 long, line string").groupBy("h1").agg(F.min("line").alias("line"))
    when = places.groupBy("h1").agg(F.min(_order("line_no")).alias("at"))
    lines = checkpointed(lines.join(when, "h1"))
    lines = maybe_broadcast(lines)
    both = pairs.join(lines.select(F.col("h1").alias("a"), F.col("line").alias("line_a"), F.col("at").alias("at_a")), "a").join(
        lines.select(F.col("h1").alias("b"), F.col("line").alias("line_b"), F.col("at").alias("at_b")), "b"
    )
    both = both.select("line_a", "line_b", F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("late"))
    return both.mapInArrow(lambda b: _verify(b, max_edits), "late long")


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """`docs` with the lines that `repeated_lines` names taken out of `text`, and n_dropped (long) added.

    Null and empty texts pass unchanged with 0; a null doc_id comes last in the order; rows equal in
    doc_id and text are one document; other columns pass (one named n_dropped is replaced)."""
    gone = maybe_broadcast(checkpointed(repeated_lines(docs, max_edits))).withColumnsRenamed({"doc_id": "gone_doc", "key": "gone_key"})
    base = docs.drop("n_dropped")
    # the columns of docs stay inside a struct, so that none clashes with a helper
    held = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"))
    held = held.join(gone, F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("key") == F.col("gone_key")), "left")
    whole = F.col("row.text")
    stay = lambda lines: F.array_except(F.sequence(F.lit(0).cast("long"), (F.size(lines) - 1).cast("long")), F.col("gone_lines"))
    rest = F.get(F.transform(F.array(F.split(whole, "\n")), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i.cast("int"))), "\n")), F.lit(0))  # split once
    text = F.when(F.col("gone_lines").isNull(), whole).otherwise(rest)
    columns = [(text if c == "text" else F.col("row")[c]).alias(c) for c in base.columns]
    return held.select(*columns, F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_dropped"))
