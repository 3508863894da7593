"""Pairs of tiles are compared round by round, each of bounded size, with the links of all at once."""

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import embeddings as E


def test_rounds_find_what_one_finds_and_shuffle_a_bounded_part(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6))
    x[100:200] = x[:100] + rng.normal(size=(100, 6)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    at_once = sorted(map(tuple, E.near_embeddings(df, tile_rows=16, least_pairs=100_000).collect()))
    sizes, compared = [], E._compared

    def seen(ordered, pairs, k, rounds, *rest):
        sizes.append((pairs.where(F.pmod(F.xxhash64("first", "second"), F.lit(rounds)) == k).count(), ordered.select("tile").distinct().count()))
        return compared(ordered, pairs, k, rounds, *rest)

    monkeypatch.setattr(E, "_compared", seen)
    assert sorted(map(tuple, E.near_embeddings(df, tile_rows=16, least_pairs=8).collect())) == at_once
    assert len(sizes) > 2 and all(n <= 2 * E.ROUND_PAIRS * tiles for n, tiles in sizes)
    assert sum(n for _, n, _, _ in at_once) > 100
