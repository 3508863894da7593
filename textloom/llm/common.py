"""Shared pieces of the training-data operators: checkpoints, table access, size-checked broadcasts
and connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured bytes up to which a table may be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, read by Spark whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, where intermediate results survive lost executors.

    Where that is unset, a session of one local process (tests, a laptop) gets a folder of its own; a cluster
    fails, as its executors would not see one another's."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if re.fullmatch(r"local(\[[^\]]*\])?", context.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and stored in the shared folder. Spark removes the files of frames no longer used if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` written as Parquet in the shared folder and read again, and where; `discard` removes it."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes what `stored` wrote, in whatever store that is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about as an executor holds it."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return 8 + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)) if isinstance(kind.elementType, T.StringType | T.StructType) else 8 * F.size(c)
        return 16 + F.coalesce(F.greatest(inner, F.lit(0)), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether `df`, stored already and so cheap to read, measures at most `limit` bytes: the check before each broadcast."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8))
    return (df.agg(F.sum(width.cast("long")).alias("b")).first()["b"] or 0) <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its measured size is within `limit`, else as it is (a shuffle join)."""
    return F.broadcast(df) if small_enough(df, limit) else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale and the other scripts in the text."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph as (node, component): the smallest node each node can reach.

    Alternating star contraction: the large star links every larger neighbour of a node to the least
    node of its neighbourhood, the small star does so for the smaller ones. Both are a min-aggregation
    (combined before the shuffle, so a hub costs no more than its partial minima) and a join that
    adaptive execution can split. Each round is checkpointed. Nodes without a link don't appear; self
    links and null ends are ignored; an empty input gives an empty result. The rounds end when the
    edges no longer change, which takes a number of them logarithmic in the longest chain."""
    e = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    e = checkpointed(e)
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        e, before = checkpointed(small), state
        state = _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(e: DataFrame) -> tuple:
    """Row count and two order-free fingerprints of an edge table."""
    row = e.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u", F.lit(7))).alias("y")
    ).first()
    return row["n"], row["x"], row["y"]
