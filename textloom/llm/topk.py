"""Exact top-k inner-product search: term-at-a-time accumulation over blocks, then partition selection and merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Candidates and queries of a block; both sides of a task are bounded by them.
BLOCK_ROWS, QUERY_ROWS = 2048, 4096
#: Whole numbers up to which double arithmetic is exact.
EXACT = 1 << 53
LONG = np.iinfo(np.int64)

FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def weights_of(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, w) with the terms floor(scale * x) of each vector, as doubles (whole numbers); rows with a null or
    non-finite component are left out."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        there = vectors.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(there, np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
        ends = np.cumsum(sizes)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # nulls become NaN
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
        keep = there & (bad[ends] == bad[ends - sizes])
        x = x[np.repeat(keep, sizes)]
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[keep]))), pa.int32())
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), pa.ListArray.from_arrays(offsets, pa.array(x))], ["vec_id", "w"])


def _sparse(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, terms, weights) of the rows' terms whose weight isn't zero; a term is a position in the vector."""
    column = table.column("w").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False)
    terms = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows, there = np.repeat(np.arange(len(sizes)), sizes), x != 0
    starts = np.searchsorted(rows[there], np.arange(len(sizes) + 1))
    return starts, terms[there], x[there]


def _postings(block: tuple[np.ndarray, np.ndarray, np.ndarray], kind: type) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """term -> (slots, weights) of a block; a term that all its rows hold takes the whole score array."""
    starts, terms, weights = block
    slots = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(terms, kind="stable")
    terms, slots, weights = terms[order], slots[order], weights[order]
    weights = weights if kind is float else np.array([int(w) for w in weights], object)
    names, at = np.unique(terms, return_index=True)
    out = {}
    for name, lo, hi in zip(names.tolist(), at.tolist(), [*at[1:].tolist(), len(terms)], strict=True):
        out[name] = (slice(None) if hi - lo == len(starts) - 1 else slots[lo:hi], weights[lo:hi])
    return out


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Slots of the k highest scores; of equal ones the first slots. Scores are parted around the k-th, not sorted."""
    if k >= len(score):
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > least)
    return np.concatenate((above, np.flatnonzero(score == least)[: k - len(above)]))


def _score(queries: pa.Table, block: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block for each of its queries."""
    if not block.num_rows or not queries.num_rows:
        return FOUND.empty_table()
    block = block.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # null ids come last
    left, right = _sparse(queries), _sparse(block)
    most = lambda s: float(np.abs(s[2]).max(initial=0))
    length = max(int(left[1].max(initial=0)), int(right[1].max(initial=0))) + 1
    kind = float if most(left) * most(right) * length < EXACT else object  # whole numbers of any size
    postings = _postings(right, kind)
    rows, ids = block.column("row").to_numpy(), block.column("vec_id").to_pylist()
    place = {int(r): i for i, r in enumerate(rows)}
    score = np.zeros(len(rows), kind)
    starts, terms, weights = left
    out: list[tuple] = []
    for q, (row, query_id) in enumerate(zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), strict=True)):
        score[:] = 0
        for t, w in zip(terms[starts[q] : starts[q + 1]].tolist(), weights[starts[q] : starts[q + 1]].tolist(), strict=True):
            if t in postings:
                slots, held = postings[t]
                score[slots] += held * (w if kind is float else int(w))
        own = place.get(row)
        for slot in _best(score, k + (own is not None)).tolist():
            if slot != own:
                out.append((row, query_id, ids[slot], min(max(int(score[slot]), LONG.min), LONG.max)))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND) if out else FOUND.empty_table()


def top_matches(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` (vec_id, embedding) that `is_query`, a condition on
    vec_id, selects, its k best other rows by the inner product of the vectors' terms floor(scale * x).

    Queries and candidates are dealt by hash into blocks of about `query_rows` and `block_rows`, and every block of queries
    meets every block of candidates in one task, whatever the number of either. A block is turned into postings, term ->
    (slot, weight). A query's terms that aren't zero are taken one after the other and add their weighted postings to an array
    with a score for each slot. The block's k best are found by partition around the k-th score; Spark's window keeps k rows
    a query and task before it shuffles and merges them. A candidate is shuffled once per block of queries, which is little
    beside the work it meets there.

    Ties go to the smaller vec_id, null ids last. A row is a candidate of every other row, also of one that repeats it or shares
    its vec_id; each repeated query row has results of its own. A vector that is null or has a null or non-finite component
    takes no part; an empty one has the score 0 with all. Of vectors with different lengths a missing term weighs nothing.
    Products are whole numbers of any size; the score that is returned ends at the bounds of a long. Fewer candidates than k give
    fewer rows; an empty table gives none; other columns are left out."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    held = base.mapInArrow(lambda b: weights_of(b, scale), "vec_id long, w array<double>")
    # numbered once and stored: a row keeps its number when an executor is lost
    held = checkpointed(held.withColumn("row", F.monotonically_increasing_id()).withColumn("asks", F.coalesce(is_query, F.lit(False))))
    sizes = held.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, asking = max(1, -(-sizes["n"] // block_rows)), max(1, -(-sizes["q"] // query_rows))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = held.select("row", "vec_id", "w", deal(blocks, 1).alias("block"), every(asking).alias("asking"))
    queries = held.where("asks").select("row", "vec_id", "w", every(blocks).alias("block"), deal(asking, 2).alias("asking"))
    key = ("block", "asking")
    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(lambda q, c: _score(q, c, k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
