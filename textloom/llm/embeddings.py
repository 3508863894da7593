"""Near-duplicate embeddings by tiles in principal-component order with suffix-norm bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, maybe_broadcast

#: Rows of a tile, and leading components after which pairs are given up by their bound.
TILE_ROWS, LEAD = 2048, 16
#: Pairs of tiles compared in one round: so many a tile, and at least so many in all. A round sends twice as many tiles through the shuffle.
ROUND_PAIRS, LEAST_PAIRS = 2, 128
#: Rounding of products of turned vectors, at most; nearer to the threshold the vectors as given decide.
EDGE = 1e-9


def _moments(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Sum of outer products of a partition's unit vectors, one row."""
    total = np.zeros((dim, dim))
    for batch in batches:
        x = _unit(batch.column(0), dim)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares can overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(a: np.ndarray, b: np.ndarray, least: float, lead: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, columns, sure) of the pairs of unit vectors with cosine of at least `least`, block by block.

    The leading components are multiplied first; the rest of a product is at most the product of the
    suffix norms. A block in which few pairs can still reach the threshold goes on with those alone. What comes
    within EDGE of the threshold is not sure."""
    sa, sb = np.linalg.norm(a[:, lead:], axis=1), np.linalg.norm(b[:, lead:], axis=1)
    for at in range(0, len(a), 512):
        x, s = a[at : at + 512], sa[at : at + 512]
        head = x[:, :lead] @ b[:, :lead].T
        rows, cols = np.nonzero(head + s[:, None] * sb[None, :] >= least - 1e-9)
        if not len(rows):
            continue
        if len(rows) * 8 < head.size:
            dots = head[rows, cols]
            for lo in range(0, len(rows), 65536):
                r, c = rows[lo : lo + 65536], cols[lo : lo + 65536]
                dots[lo : lo + 65536] += np.einsum("ij,ij->i", x[r, lead:], b[c, lead:])
        else:
            dots = (head + x[:, lead:] @ b[:, lead:].T)[rows, cols]
        near = dots >= least - EDGE
        yield at, rows[near], cols[near], dots[near] >= least + EDGE


def _compare(pdf: pd.DataFrame, dim: int, least: float) -> pd.DataFrame:
    """A pair of tiles (or one): link counts of its members (a, null, n), links that connect what all its links
    connect (a, b, 0), and pairs at the threshold (a, b, null)."""
    sides = [pdf[pdf["side"] == k] for k in (0, 1)]
    first, second = sides if len(sides[1]) else (sides[0], sides[0])
    same = not len(sides[1])
    load = lambda t: np.frombuffer(b"".join(t["v"]), np.float64).reshape(-1, dim)
    a, b = load(first), load(second)
    ia, ib, wa, wb = first["rep"].to_numpy(), second["rep"].to_numpy(), first["copies"].to_numpy(), second["copies"].to_numpy()
    na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    root = np.arange(len(a) + (0 if same else len(b)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for at, rows, cols, sure in _links(a, b, least, min(LEAD, dim)):
        rows = rows + at
        out += [(int(ia[i]), int(ib[j]), None) for i, j in zip(rows[~sure].tolist(), cols[~sure].tolist(), strict=True) if not same or i < j]
        rows, cols = rows[sure], cols[sure]
        if same:
            rows, cols = rows[rows != cols], cols[rows != cols]
        na += np.bincount(rows, weights=wb[cols], minlength=len(a)).astype(np.int64)
        if not same:
            nb += np.bincount(cols, weights=wa[rows], minlength=len(b)).astype(np.int64)
        # only links to the first partner of each row and column, and those between what they leave apart
        for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
            if same and i > j:
                continue
            x, y = find(i), find(j if same else len(a) + j)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(ia[i]), int(ib[j]), 0))
    out += [(int(i), None, int(n)) for i, n in zip(ia, na, strict=True) if n]
    if not same:
        out += [(int(i), None, int(n)) for i, n in zip(ib, nb, strict=True) if n]
    return pd.DataFrame({"a": pd.array([o[0] for o in out], "Int64"), "b": pd.array([o[1] for o in out], "Int64"), "n": pd.array([o[2] for o in out], "Int64")})


def near_embeddings(vectors: DataFrame, cosine: float = 0.9, tile_rows: int = TILE_ROWS, least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding).

    Vectors link at a cosine of `cosine` or more in double precision. n_links counts the other vectors
    linked directly, component_id is the smallest vec_id that links reach, kept says it is the row's own.

    Equal vectors collapse to one class first, by aggregation. The rest is turned into the
    principal axes of all vectors (their second moments are summed over the whole table) and cut into
    tiles of `tile_rows` along the first axis. Linked unit vectors differ by at most sqrt(2 - 2 cosine)
    on every axis, so a tile meets only the tiles within that reach; inside a pair of tiles products
    start with the leading components and stop where the suffix norms rule the threshold out. A pair of
    tiles is one task of bounded size; it returns counts and a spanning set of links, not all pairs. Pairs are compared in
    rounds of `least_pairs`, or of `ROUND_PAIRS` a tile where these are more, so that a round's shuffle grows with the
    table and not with its square; when Spark gives its files back is up to its cleaner.

    Vectors of each length are compared among themselves, one length after the other. Each row is a vector, also one that
    repeats another or shares its vec_id: rows of equal vectors link with each other. A vector that is null, empty, zero, or with
    null or non-finite components links with nothing, as does a row with a null vec_id, whose component is null; an empty table
    gives no rows; other columns are left out."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.exists("v", lambda x: x != 0)
    usable = usable & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    base = base.select("vec_id", F.when(usable, F.col("v")).alias("v"))
    classes = base.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # numbered once and stored: a class keeps its number when an executor is lost
    classes = checkpointed(classes.withColumn("rep", F.monotonically_increasing_id()))
    lengths = sorted(r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect())  # a number for each length
    parts = [_linked(classes.where(F.size("v") == d) if len(lengths) > 1 else classes, d, cosine, tile_rows, least_pairs) for d in lengths]
    known = reduce(DataFrame.unionByName, parts) if parts else classes.select("v", F.lit(0).cast("long").alias("n"), F.col("least").alias("component"))
    joined = base.join(known.withColumnRenamed("v", "of"), F.col("v") == F.col("of"), "left")
    out = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(distinct: DataFrame, dim: int, cosine: float, tile_rows: int, least_pairs: int) -> DataFrame:
    """(v, n, component) of distinct vectors of one length (v, least, copies, rep): n other rows are linked with each row of v,
    component is the smallest vec_id of its component."""
    parts = distinct.select("v").mapInArrow(lambda b: _moments(b, dim), "m array<double>")
    moment = parts.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # dim x dim numbers
    axes = np.ascontiguousarray(np.linalg.eigh(np.array([r["x"] for r in moment]).reshape(dim, dim))[1][:, ::-1])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _unit(batch.column("v"), dim) @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), pa.array(y[:, 0], pa.float64()), pa.array([r.tobytes() for r in y], pa.binary())], ["rep", "copies", "y", "v"]
            )

    turned = checkpointed(distinct.select("v", "rep", "copies").mapInArrow(turn, "rep long, copies long, y double, v binary"))
    ordered = _tiled(turned, tile_rows)
    reach = float(np.sqrt(max(2 - 2 * cosine, 0))) + 1e-9
    tiles = ordered.groupBy("tile").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    pairs = _tile_pairs(tiles, reach)
    a_round = max(least_pairs, ROUND_PAIRS * tiles.count())
    rounds = max(1, -(-pairs.count() // a_round))
    found = reduce(DataFrame.unionByName, [_compared(ordered, pairs, k, rounds, dim, cosine) for k in range(rounds)])
    edge = _at_threshold(found.where("b is not null and n is null").select("a", "b"), distinct, cosine)
    comp = connected_components(found.where("b is not null and n = 0").select("a", "b").unionByName(edge.select("a", "b")))
    counts = found.where("b is null").select("a", "n").unionByName(edge.select("a", F.col("copies_b").alias("n"))).unionByName(edge.select(F.col("b").alias("a"), F.col("copies_a").alias("n")))
    counts = counts.groupBy("a").agg(F.sum("n").alias("n"))
    placed = distinct.join(counts, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    placed = checkpointed(placed.select("v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("root")))
    smallest = placed.groupBy(F.col("root").alias("of_root")).agg(F.min("least").alias("component"))
    return placed.join(smallest, F.col("root") == F.col("of_root")).select("v", "n", "component")


def _compared(ordered: DataFrame, pairs: DataFrame, k: int, rounds: int, dim: int, cosine: float) -> DataFrame:
    """What `_compare` finds in the pairs of round `k`, stored. A tile is sent once per tile in reach, which all at once grows with the
    square of the table; between rounds the shuffle's files, which nothing refers to any more, are given back."""
    some = pairs.where(F.pmod(F.xxhash64("first", "second"), F.lit(rounds)) == k) if rounds > 1 else pairs
    left = ordered.join(maybe_broadcast(some), F.col("tile") == F.col("first")).select("first", "second", F.lit(0).alias("side"), "rep", "copies", "v")
    right = ordered.join(maybe_broadcast(some.where("first <> second")), F.col("tile") == F.col("second")).select("first", "second", F.lit(1).alias("side"), "rep", "copies", "v")
    found = checkpointed(left.unionByName(right).groupBy("first", "second").applyInPandas(lambda pdf: _compare(pdf.drop(columns=["first", "second"]), dim, cosine), "a long, b long, n long"))
    if rounds > 1:
        del some, left, right
        ordered.sparkSession._jvm.System.gc()  # Spark removes a shuffle's files once the driver's JVM has collected the plan
    return found


def _at_threshold(pairs: DataFrame, distinct: DataFrame, cosine: float) -> DataFrame:
    """(a, b, copies_a, copies_b) of the pairs whose vectors, as they were given, reach `cosine` in double precision."""
    side = lambda name: distinct.select(F.col("rep").alias(name), F.col("copies").alias(f"copies_{name}"), F.col("v").alias(f"v_{name}"))
    scaled = lambda v: F.transform(F.col(v), lambda x: x / F.array_max(F.transform(F.col(v), F.abs)))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    both = checkpointed(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "copies_a", "copies_b", scaled("v_a").alias("x"), scaled("v_b").alias("y")))
    return both.where(dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))) >= cosine).select("a", "b", "copies_a", "copies_b")


def _tiled(turned: DataFrame, tile_rows: int) -> DataFrame:
    """Rows with a tile number: consecutive runs of at most `tile_rows` along the first axis.

    Rows are dealt into ranges of y by approximate quantiles; a range that holds more is split by hash."""
    n = max(1, -(-turned.count() // tile_rows))
    cuts = np.array(sorted(set(turned.approxQuantile("y", [k / n for k in range(1, n)], 0.001))) if n > 1 else [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.searchsorted(cuts, batch.column("y").to_numpy(), "right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    dealt = checkpointed(turned.mapInArrow(deal, "rep long, copies long, y double, v binary, cell long"))
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("long").alias("slots"))  # a row for each tile at most
    split = dealt.join(maybe_broadcast(sizes), "cell")
    tile = F.col("cell") * 1_000_000 + F.pmod(F.xxhash64("rep"), F.col("slots"))
    return checkpointed(split.select("rep", "copies", "y", "v", tile.alias("tile")))


def _tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """(first, second): tiles whose ranges of y come within `reach`, each pair once, and each tile with itself.

    An equi-join on steps of about `reach`: a tile asks for the steps that its widened range touches and offers
    those of its own range, a handful each as y lies between -1 and 1."""
    tiles = checkpointed(tiles)
    step = lambda y: F.floor(y / max(reach, 0.05)).cast("long")
    asks = tiles.select(F.col("tile").alias("first"), (F.col("lo") - reach).alias("from"), (F.col("hi") + reach).alias("to"), F.explode(F.sequence(step(F.col("lo") - reach), step(F.col("hi") + reach))).alias("step"))
    offers = tiles.select(F.col("tile").alias("second"), "lo", "hi", F.explode(F.sequence(step(F.col("lo")), step(F.col("hi")))).alias("step"))
    near = (F.col("first") <= F.col("second")) & (F.col("lo") <= F.col("to")) & (F.col("hi") >= F.col("from"))
    return checkpointed(asks.join(offers, "step").where(near).select("first", "second").distinct())
