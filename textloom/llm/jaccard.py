"""Exact Jaccard join of word-shingle sets in metric space: pivots, distance regions and windows, recursion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, maybe_broadcast
from .memos import claim
from .shingles import Seeds, overlap, set_key, shingle_set

#: (bands, minima) of the seed cells in each round; the regions of a round that are still large go to the next.
#: A pair at exactly the threshold is in the regions of `SPARE` + 1 of its common cells or more but for a
#: probability of 2e-10, and closer pairs but for much less.
ROUNDS = ((64, 3), (128, 5))
#: Cells a set may leave: those of its farthest pivots (by common cells), and those that a window rules out.
SPARE, WINDOWED = 4, 12
#: Shingles (of all members together) up to which a region or block of one is joined inside one task.
REGION_SHINGLES = 150_000
#: Members that are measured against one copy of their pivot's text.
MEASURED_TOGETHER = 512


def _sketches(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    claim("shingles")
    seeds = Seeds(bands, rows)
    for batch in batches:
        n, k1, k2, keys = [], [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            a, b = set_key(s)
            n.append(len(s))
            k1.append(a)
            k2.append(b)
            keys.append(seeds(s) if len(s) else None)
        sized = [pa.array(c, pa.int64()) for c in (n, k1, k2)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("own", "fp")), *sized, pa.array(keys, pa.list_(pa.int64()))], ["own", "fp", "n_shingles", "k1", "k2", "seeds"])


def _linked(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def _distances(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard distances of rows (pivot, role, x, text) that come sorted: a pivot's own text, role 0, before its members'."""
    claim("shingles")
    p = shingle_set(None)
    for batch in batches:
        pivots, xs, d, link = [], [], [], []
        for pivot, role, x, text in zip(*(batch.column(c).to_pylist() for c in ("pivot", "role", "x")), batch.column("text"), strict=True):
            s = shingle_set(text.as_py())
            if role == 0:
                p = s
                continue
            inter = overlap(s, p)
            pivots.append(pivot)
            xs.append(x)
            d.append(1 - inter / (len(s) + len(p) - inter))
            link.append(_linked(inter, len(s), len(p), percent))
        yield pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(xs, pa.int64()), pa.array(d, pa.float64()), pa.array(link, pa.bool_())], ["pivot", "x", "d", "link"])


def _seeded(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    seeds = Seeds(bands, rows)
    for batch in batches:
        keys = [seeds(shingle_set(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(keys, pa.list_(pa.int64()))], ["x", "seeds"])


def _join_region(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between members of one region that lie in different components so far.

    Every such pair has a member outside the region's largest component, so those members probe the
    postings of all. Of the links that hold, enough are returned to connect what they connect."""
    pdf = pdf.drop_duplicates("x").reset_index(drop=True)
    ids, comp = pdf["x"].to_numpy(), pdf["comp"].to_numpy()
    sets = [shingle_set(t) for t in pdf["text"]]
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    names, counts = np.unique(comp, return_counts=True)
    main = names[counts.argmax()]
    root = dict(zip(names.tolist(), names.tolist(), strict=True))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    lows, highs = np.searchsorted(flat, flat, "left"), np.searchsorted(flat, flat, "right")
    first = lows == np.arange(len(flat))
    places = dict(zip(flat[first].tolist(), zip(lows[first].tolist(), highs[first].tolist(), strict=True), strict=True))
    for i in np.flatnonzero(comp != main):
        spans = [places[s] for s in sets[i].tolist()]
        inter = np.bincount(np.concatenate([owner[a:b] for a, b in spans]), minlength=len(sets))
        for j in np.flatnonzero(100 * inter >= percent * (size[i] + size - inter)):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def jaccard_components(docs: DataFrame, percent: int = 75, rounds: tuple = ROUNDS, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    Texts link when 100 * intersection >= `percent` * union of their sets of distinct 5-word shingles;
    component_id is the smallest doc_id that links reach. The whole of each text counts.

    1. Equal sets collapse to one class by aggregation, however many copies there are. A class has the number of
       its first row as its id.
    2. Pivots: each random order of all shingles lays the classes into seed cells (sets that begin alike under
       it); the first class of a cell is its pivot. Most sets of a corpus are at distance 1 from nearly all
       others, where distances to arbitrary pivots tell nothing; seed cells find the pivots to which a set's
       distance does. The number of common cells estimates the distance.
    3. Voronoi regions: a class belongs to the region of its nearest pivot, from which its exact distance is
       measured; within the threshold it links to it. It is replicated into the regions of its next nearest
       pivots, but for those that hold `SPARE` of its cells at most.
    4. Windows: a class at distance a of its nearest pivot q leaves the region of a pivot p if the triangle
       inequality puts p farther from it than a + 2 eps, that is d(p, q) > 2 a + 2 eps, with eps = 1 - threshold.
    5. Regions whose members links have connected already are done. Each other region is joined exactly inside
       one task of at most `region_shingles` shingles; the classes of larger ones go through the next round's
       finer cells, and what is large after the last round is joined block against block.

    Null or empty texts have n_shingles 0 and link with nothing; a null doc_id has a null component;
    rows with one doc_id are one document (its texts all count); an empty table gives no rows; other
    columns are left out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("fp"), "text")
    sketch = docs.mapInArrow(lambda b: _sketches(b, *rounds[0]), "own long, fp long, n_shingles long, k1 long, k2 long, seeds array<long>")
    sketch = checkpointed(sketch.withColumn("row", F.monotonically_increasing_id()))
    keyed = sketch.where("n_shingles > 0 and own is not null")
    first = F.min(F.struct("own", "row", "fp")).alias("first")
    classes = checkpointed(keyed.groupBy("n_shingles", "k1", "k2").agg(first, F.count("*").alias("copies")).select("n_shingles", "k1", "k2", "copies", "first.*"))
    reps = maybe_broadcast(classes.select("row"))
    cells = keyed.select("row", "seeds").join(reps, "row", "left_semi").select(F.col("row").alias("x"), F.explode("seeds").alias("cell"))
    links = _links(docs, cells, classes.select(F.col("row").alias("x"), "own", "fp", "n_shingles"), percent, rounds, region_shingles)
    # several texts under one doc_id: their classes meet in it
    several = keyed.groupBy("own").agg(F.min(F.struct("k1", "k2", "n_shingles")).alias("lo"), F.max(F.struct("k1", "k2", "n_shingles")).alias("hi")).where("lo <> hi")
    meet = keyed.select("own", "n_shingles", "k1", "k2").join(maybe_broadcast(checkpointed(several.select("own"))), "own")
    meet = checkpointed(meet.join(classes.drop("own", "fp"), ["n_shingles", "k1", "k2"]).select("own", "row").distinct())
    meet = meet.join(meet.groupBy("own").agg(F.min("row").alias("a")), "own").select("a", F.col("row").alias("b"))
    comp = checkpointed(connected_components(links.unionByName(meet)))
    of_class = checkpointed(classes.join(maybe_broadcast(comp), F.col("row") == F.col("node"), "left").where("copies > 1 or component is not null").drop("node"))
    least = checkpointed(of_class.where("component is not null").groupBy("component").agg(F.min("own").alias("least")))
    of_class = checkpointed(of_class.join(maybe_broadcast(least), "component", "left").select("n_shingles", "k1", "k2", F.coalesce("least", "own").alias("component_id")))
    found = sketch.select(F.col("own").alias("doc_id"), "n_shingles", "k1", "k2").join(maybe_broadcast(of_class), ["n_shingles", "k1", "k2"], "left")
    alone = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def _links(docs: DataFrame, cells: DataFrame, classes: DataFrame, percent: int, rounds: tuple, region_shingles: int) -> DataFrame:
    """Links (a, b) that connect the classes as all their links would."""
    members = _members(cells, rounds[0][0])
    active = checkpointed(members.select("x").union(members.select("pivot")).distinct().join(classes, "x"))
    texts = _texts(docs, active)
    links, regions = _regions(members, active, texts, percent)
    for k in range(1, len(rounds) + 1):
        large = checkpointed(regions.where(F.col("weight") > region_shingles))
        fits = regions.where(F.col("weight") <= region_shingles)
        if large.isEmpty():
            return checkpointed(links.unionByName(_joined(fits, texts, percent)))
        if k == len(rounds):
            return checkpointed(links.unionByName(_joined(fits.unionByName(_blocks(large, region_shingles)), texts, percent)))
        again = texts.join(maybe_broadcast(checkpointed(large.select("x").distinct())), "x").select("x", "text")
        seeds = again.mapInArrow(lambda b, k=k: _seeded(b, *rounds[k]), "x long, seeds array<long>")
        finer = _members(seeds.select("x", F.explode("seeds").alias("cell")), rounds[k][0])
        more, regions = _regions(finer, active, texts, percent)
        links = checkpointed(links.unionByName(more).unionByName(_joined(fits, texts, percent)))
    raise ValueError("no rounds")


def _members(cells: DataFrame, bands: int) -> DataFrame:
    """(pivot, x, votes, rank): the pivots with whom a class shares cells, the nearest first, and how many cells.

    The farthest are left out as long as they hold `SPARE` of its cells at most. A class has a row for each of its
    `bands` cells at most."""
    pivots = checkpointed(cells.groupBy("cell").agg(F.min("x").alias("pivot"), F.max("x").alias("last")).where("pivot < last").select("cell", "pivot"))
    votes = cells.join(maybe_broadcast(pivots), "cell").where("x <> pivot").groupBy("x", "pivot").agg(F.count("*").alias("votes"))
    nearest = Window.partitionBy("x").orderBy(F.desc("votes"), "pivot")
    rest = F.sum("votes").over(nearest.rowsBetween(0, Window.unboundedFollowing))
    return checkpointed(votes.select("pivot", "x", "votes", F.row_number().over(nearest).alias("rank"), rest.alias("rest")).where(F.col("rest") > SPARE).drop("rest"))


def _texts(docs: DataFrame, active: DataFrame) -> DataFrame:
    """(x, text): the text of each class that shares a cell with another, once."""
    held = docs.join(maybe_broadcast(active.select("x", "own", "fp")), ["own", "fp"])
    return checkpointed(held.groupBy("x").agg(F.first("text").alias("text")))


def _measured(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(pivot, x, d, link) of (pivot, x): exact distances. A member's text is sent once, a pivot's once for `MEASURED_TOGETHER` of them."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEASURED_TOGETHER).cast("long").alias("parts"))
    xs = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("x"), "parts").alias("part"), F.lit(1).alias("role"), "x")
    ps = parts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("pivot").alias("x"))
    rows = texts.join(maybe_broadcast(checkpointed(xs.unionByName(ps))), "x")
    ordered = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role")
    return checkpointed(ordered.select("pivot", "role", "x", "text").mapInArrow(lambda b: _distances(b, percent), "pivot long, x long, d double, link boolean"))


def _regions(members: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to the nearest pivots, and (region, x, comp, weight): the members of the regions that hold more than one component."""
    eps = 1 - percent / 100
    near = _measured(members.where("rank = 1").select("pivot", "x"), texts, percent).select("x", F.col("pivot").alias("q"), "d", "link")
    links = near.where("link").select(F.col("q").alias("a"), F.col("x").alias("b"))
    others = members.where("rank > 1").join(near.where("link").select("x", "q", F.col("d").alias("a")), "x", "left")
    between = others.where("q is not null and q <> pivot").select("pivot", F.col("q").alias("x")).distinct()
    apart = _measured(checkpointed(between), texts, percent).select("pivot", F.col("x").alias("q"), F.col("d").alias("between"))
    others = others.join(maybe_broadcast(apart), ["pivot", "q"], "left")
    outside = F.coalesce(F.col("between") > 2 * F.col("a") + 2 * eps + 1e-9, F.lit(False))
    fewest = Window.partitionBy("x", outside).orderBy("votes", F.desc("pivot"))
    left = outside & (F.sum("votes").over(fewest) <= WINDOWED)
    others = others.select("pivot", "x", left.alias("gone")).where("not gone")
    kept = others.select("pivot", "x").unionByName(members.where("rank = 1").select("pivot", "x"))
    kept = kept.unionByName(members.select("pivot", F.col("pivot").alias("x")).distinct())

    # what two steps along the links reach names a component so far
    step = maybe_broadcast(checkpointed(near.where("link").select("x", F.col("q").alias("to"))))
    hop = lambda df: df.join(step.withColumnsRenamed({"x": "comp", "to": "next"}), "comp", "left").withColumn("comp", F.coalesce("next", "comp")).drop("next")
    known = hop(hop(hop(kept.withColumn("comp", F.col("x")))))
    known = known.join(maybe_broadcast(sizes.select("x", "n_shingles")), "x").select(F.col("pivot").alias("region"), "x", "comp", "n_shingles")
    known = checkpointed(known)
    todo = known.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n_shingles").alias("weight")).where("lo < hi")
    return links, checkpointed(known.join(maybe_broadcast(checkpointed(todo.select("region", "weight"))), "region").select("region", "x", "comp", "weight"))


def _joined(regions: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    todo = texts.join(maybe_broadcast(checkpointed(regions.select("region", "x", "comp"))), "x")
    return todo.select("region", "x", "comp", "text").groupBy("region").applyInPandas(lambda pdf: _join_region(pdf, percent), "a long, b long")


def _blocks(large: DataFrame, region_shingles: int) -> DataFrame:
    """Each large region as pairs of blocks of about `region_shingles`, every pair of members in one of them."""
    n = F.ceil(F.col("weight") / region_shingles).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    dealt = large.withColumn("block", F.pmod(F.xxhash64("x", F.lit("block")), n)).withColumn("other", other)
    return dealt.select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "x", "comp", "weight")
