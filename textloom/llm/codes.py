"""Vector codes by product codebooks, trained by Lloyd rounds that skip work by Yinyang's group bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, maybe_broadcast
from .topk import weights_of

#: Components are held within this bound either way, so that every sum of squares fits a long.
LARGEST = 1 << 24
#: Entries of a Yinyang group, on average.
GROUP_ENTRIES = 8
#: Relative slack of the bounds, which are rounded square roots.
SLACK = 1e-9
#: Whole numbers up to which double arithmetic is exact.
EXACT = 1 << 53
#: Rows that are worked on together.
ROWS = 4096


def _groups(book: np.ndarray) -> np.ndarray:
    """Group of each entry of one codebook: a few rounds of k-means over the entries themselves. Groups change what is
    skipped and never a result."""
    k = max(1, -(-len(book) // GROUP_ENTRIES))
    x = book.astype(np.float64)
    centres, own = x[:: max(1, len(x) // k)][:k].copy(), np.zeros(len(x), np.int64)
    for _ in range(5):
        own = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(len(centres)):
            if (own == g).any():
                centres[g] = x[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, whole numbers: by a product in doubles while that is exact, else in longs."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return reduce(np.add, ((x[:, j, None] - book[None, :, j]) ** 2 for j in range(x.shape[1])))


class Part:
    """One part position: its codebook, groups and how far entries moved since the last assignment."""

    def __init__(self, book: np.ndarray, groups: np.ndarray, before: np.ndarray | None) -> None:
        self.book, self.groups = book, groups
        self.members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
        if before is not None:
            moved = np.sqrt(((book - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
            self.drift = np.array([moved[m].max() for m in self.members])

    def _bounds(self, d2: np.ndarray, members: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Distance to the nearest of `members` but for the assigned entry; endless where there is none."""
        d = np.sqrt(d2.astype(np.float64))
        d[code[:, None] == members[None]] = np.inf
        return d.min(1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, squared distances, lower bounds by group) with every entry looked at; argmin gives ties the lower index."""
        d2 = _distances(x, self.book)
        code = d2.argmin(1)
        low = np.stack([self._bounds(d2[:, m], m, code) for m in self.members], 1)
        return code, d2[np.arange(len(x)), code], low

    def again(self, x: np.ndarray, code: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after entries moved. A group's bound sinks by its largest drift; a group is looked at only where the bound
        doesn't stay clear of the distance to the assigned entry. Whole numbers decide, ties by index."""
        low = low * (1 - SLACK) - self.drift[None]
        at = self.book[code]
        held = ((x - at) ** 2).sum(1)
        best, old, reach = held.copy(), code.copy(), np.sqrt(held.astype(np.float64)) * (1 + SLACK)
        code = code.copy()
        looked = [np.flatnonzero(low[:, g] <= reach) for g in range(len(self.members))]
        seen = []
        for members, rows in zip(self.members, looked, strict=True):
            d2 = _distances(x[rows], self.book[members])
            seen.append(d2)
            j = d2.argmin(1)
            value, index = d2[np.arange(len(rows)), j], members[j]
            better = (value < best[rows]) | (value == best[rows]) & (index < code[rows])
            best[rows[better]], code[rows[better]] = value[better], index[better]
        left = np.flatnonzero(code != old)  # an entry that was left counts for its group, looked at or not
        home = self.groups[old[left]]
        low[left, home] = np.minimum(low[left, home], reach[left] * (1 - 2 * SLACK))
        for g, (members, rows, d2) in enumerate(zip(self.members, looked, seen, strict=True)):
            low[rows, g] = self._bounds(d2, members, code[rows])
        return code, best, low


def _cut(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """Rows x parts x width / parts whole numbers; shorter vectors are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.clip(column.flatten().to_numpy(zero_copy_only=False), -LARGEST, LARGEST).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x
    return out.reshape(len(sizes), parts, -1)


def _assign(batches: Iterator[pa.RecordBatch], books: list[Part], width: int, known: bool) -> Iterator[pa.RecordBatch]:
    """Rows with their codes (a 16-bit number a part), bounds (a double a part and group) and error."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            x, n = _cut(batch.column("w"), width, len(books)), batch.num_rows
            if known:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), "<u2").reshape(n, -1)
                lows = np.frombuffer(b"".join(batch.column("low").to_pylist()), "<f8").reshape(n, -1)
            found, error, at_group = [], np.zeros(n, np.int64), 0
            for p, part in enumerate(books):
                if known:
                    got = part.again(x[:, p], codes[:, p].astype(np.int64), lows[:, at_group : at_group + len(part.members)])
                    at_group += len(part.members)
                else:
                    got = part.first(x[:, p])
                found.append(got)
                error += got[1]
            code = np.stack([f[0] for f in found], 1).astype("<u2")
            low = np.concatenate([f[2] for f in found], 1).astype("<f8")
            binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("w"), binary(code), binary(low), pa.array(error)], ["row", "w", "code", "low", "error"])


def _sums(batches: Iterator[pa.RecordBatch], entries: int, parts: int, width: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, sums) of a task's rows: a row for each entry in use."""
    count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width // parts), np.int64)
    for batch in batches:
        x = _cut(batch.column("w"), width, parts).reshape(batch.num_rows * parts, -1)
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), "<u2").astype(np.int64)
        at = code + np.tile(np.arange(parts) * entries, batch.num_rows)
        count += np.bincount(at, minlength=len(count))
        for j in range(x.shape[1]):
            np.add.at(total[:, j], at, x[:, j])
    used = np.flatnonzero(count)
    values = [pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(values, ["part", "entry", "n", "sums"])


def _means(state: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The next codebooks: floor(sum / count) by component, entries without rows as they were. What reaches the driver
    is one row an entry, whatever the number of vectors."""
    parts, entries = len(books), len(books[0])
    sums = state.select("w", "code").mapInArrow(lambda b: _sums(b, entries, parts, width), "part int, entry int, n long, sums array<long>")
    each = sums.select("part", "entry", "n", F.posexplode("sums").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    new = [b.copy() for b in books]
    for r in each.collect():
        new[r["part"]][r["entry"], r["i"]] = int(r["x"]) // r["n"]
    return new


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of `vectors` (vec_id, embedding, label) whose
    vector is not null and holds no null or non-finite component.

    Components become floor(scale * x); a vector is cut into `parts` equal consecutive parts with a codebook each, which
    begins as that part of the first `entries` rows by vec_id. In each round every part goes to its nearest entry (squared
    distance, ties to the lower index) and entries become the floored means of their parts; at last parts are assigned again.
    code has two hex digits a part (four for codebooks over 256), error sums the final squared distances.

    Entries are clustered into groups of about GROUP_ENTRIES. A row keeps one lower bound a part and group; when entries
    move, bounds sink by the group's drift, and only groups whose bound fails are looked at. Distances that decide are whole
    numbers. Rows stay where they are: an assignment is a pass over stored rows, the means are sums of a bounded number of
    entries, and only the errors by label meet in a join, after an aggregation that combines rows before the shuffle.

    Codebooks start from rows in the order of vec_id (nulls last), then of the vectors; with fewer rows than `entries`
    they have fewer. Vectors of fewer components than the longest, or than a multiple of `parts`, are filled with zeros, also
    empty ones. Components are held within 2^24 either way after scaling, so that errors fit a long. Repeated rows count each;
    null labels are one label; an empty table gives no rows; other columns are left out."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    base = checkpointed(base.withColumn("row", F.monotonically_increasing_id()))
    held = checkpointed(base.select("row", "v").mapInArrow(lambda b: weights_of(b, scale), "vec_id long, w array<double>").withColumnRenamed("vec_id", "row"))
    longest = held.agg(F.max(F.size("w")).alias("d")).first()["d"]
    out = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if longest is None:
        return vectors.sparkSession.createDataFrame([], out)
    width = max(1, -(-longest // parts)) * parts
    first = base.select("row", "vec_id").join(held, "row").orderBy(F.asc_nulls_last("vec_id"), "w", "row").limit(entries).select("w").collect()
    start = _cut(pa.array([r["w"] for r in first], pa.list_(pa.float64())), width, parts)
    books = [start[:, p] for p in range(parts)]
    groups = [_groups(b) for b in books]
    made = [Part(b, g, None) for b, g in zip(books, groups, strict=True)]
    rows = "row long, w array<double>, code binary, low binary, error long"
    state = checkpointed(held.mapInArrow(lambda b: _assign(b, made, width, False), rows))
    for _ in range(rounds):
        before, books = books, _means(state, books, width)
        moved = [Part(b, g, old) for b, g, old in zip(books, groups, before, strict=True)]
        state = checkpointed(state.mapInArrow(lambda b, moved=moved: _assign(b, moved, width, True), rows))
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    digits = 2 if len(books[0]) <= 256 else 4
    number = lambda p: F.concat(F.substring("code", p * 2 + 2, 1), F.substring("code", p * 2 + 1, 1)) if digits == 4 else F.substring("code", p * 2 + 1, 1)
    coded = state.select("row", F.lower(F.hex(F.concat(*[number(p) for p in range(parts)]))).alias("code"), "error")
    coded = base.select("row", "vec_id", "label").join(coded, "row")
    label_sum = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long").alias("label_error")
    by_label = coded.groupBy("label").agg(label_sum).withColumnRenamed("label", "of_label")
    joined = coded.join(maybe_broadcast(checkpointed(by_label)), F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
