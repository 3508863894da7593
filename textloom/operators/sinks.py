"""Tables of a library that are written: books with refused duplicates, analyses by version, shards, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as T
from .learner import supersede


def read_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the library; empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def overwrite_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions by `keys` that `rows` has, and no others. Spark stages the files and moves them when all are
    written, so a second run after a failure leaves what one run would have left."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_books(spark: SparkSession, folder: str, books: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """Adds new books and their stores (each with book_id), partitioned by book; returns the refused ones.

    A book is refused if one with its content_hash is there under another id, or came before it in this batch. Stores are written
    first and `books` last, each by overwriting the partitions of the books that are new: what a reader finds in `books` is
    complete, and a write that ended between two tables is mended by running it again, without doubled rows. Until then a
    reader joins stores with `books` and so sees no part of an unlisted book."""
    had = read_table(spark, folder, "books", "book_id long, content_hash string").groupBy("content_hash").agg(F.min("book_id").alias("had"))
    first = books.groupBy("content_hash").agg(F.min("book_id").alias("first"))
    judged = books.join(first, "content_hash").join(had, "content_hash", "left")
    listed = F.coalesce(F.col("had") == F.col("book_id"), F.lit(False))
    fresh = (F.col("book_id") == F.col("first")) & F.col("had").isNull()
    taken = judged.where(fresh).select(books.columns).persist()
    refused = judged.where(~fresh & ~listed).select("book_id", "content_hash", F.lit("duplicate").alias("reason")).persist()
    refused.count()  # judged by the books that were there before this write
    for name, rows in stores.items():
        overwrite_partitions(rows.join(taken.select("book_id"), "book_id", "left_semi"), f"{folder}/{name}", ["book_id"])
    overwrite_partitions(taken, f"{folder}/books", ["book_id"])
    taken.unpersist()
    return refused


def delete_books(spark: SparkSession, folder: str, gone: DataFrame, stores: list[str]) -> None:
    """Takes books (book_id) off a library: first `books`, so that no reader sees half of one, then their partitions of the
    stores. A delete that ended in between is finished by running it again."""
    ids = [r["book_id"] for r in gone.select("book_id").distinct().toLocalIterator()]  # the books of one request
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ["books", *stores]:
        for book in ids:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/book_id={book}"), True)


def append_chapters(spark: SparkSession, folder: str, book_id: int, chapters: DataFrame, schema: str) -> None:
    """Adds chapters behind those a book has; their numbers go on."""
    last = read_table(spark, folder, "chapters", schema).where(F.col("book_id") == book_id).agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("m")).first()["m"]
    chapters.withColumns({"book_id": F.lit(book_id), "idx": (F.col("idx") + last + 1).cast("int")}).write.mode("append").partitionBy("book_id").parquet(f"{folder}/chapters")


def write_analyses(old: DataFrame, new: DataFrame, scope: list[str], forced: Column | None = None) -> DataFrame:
    """The versioned table after `new` is written; with `forced`, the rows of the scopes' last version that it names go instead of being superseded."""
    if forced is not None:
        last = old.groupBy(*scope).agg(F.max("version").alias("last"))
        old = old.join(last, scope, "left").where(~((F.col("version") == F.col("last")) & forced)).drop("last")
    return supersede(old, new, scope)


def rewrite_analyses(spark: SparkSession, folder: str, schema: str, new: DataFrame, scope: list[str], forced: Column | None = None) -> None:
    """Writes `new` as the next version of its scopes in the stored table `analyses`: only partitions of those scopes are read,
    superseded and replaced. The same `new` once more is recognised by its tag (a column of `new`): nothing is written twice."""
    old = read_table(spark, folder, "analyses", schema).join(new.select(*scope).distinct(), scope, "left_semi")
    last = old.groupBy(*scope).agg(F.max_by("tag", "version").alias("tag")).withColumn("done", F.lit(True))
    todo = new.join(last, [*scope, "tag"], "left").where("done is null").drop("done")
    rewritten = write_analyses(old.join(todo.select(*scope).distinct(), scope, "left_semi"), todo, scope, forced).persist()
    rewritten.count()  # computed before the partitions it was read from are replaced
    overwrite_partitions(rewritten, f"{folder}/analyses", scope)
    rewritten.unpersist()


#: Bytes of a shard at most, and letters of a prefix at most.
SHARD_BYTES, DEPTH = 300_000, 6


def shard_prefixes(index: DataFrame, limit: int = SHARD_BYTES, depth: int = DEPTH) -> DataFrame:
    """(shard, bytes, whole): the prefixes that deal `index` (key and other columns) into shards of at most `limit` bytes.

    A trie over loose keys, split from the root by measured bytes: a prefix whose rows weigh more gives way to its children,
    down to `depth` letters. Each level is one aggregation over the rows that are still too heavy, combined before its shuffle.
    A key that ends at a split prefix has a shard of its own, the prefix and `$` (whole is true there)."""
    rows = index.select(T.loose_key(F.col("key")).alias("k"), F.octet_length(F.to_json(F.struct("*"))).cast("long").alias("b")).groupBy("k").agg(F.sum("b").alias("b"))
    found, open_ = [], None
    for n in range(1, depth + 1):
        level = rows if open_ is None else rows.join(open_, F.left("k", F.lit(n - 1)) == F.col("heavy"), "left_semi")
        ends = F.length("k") < n
        sized = level.groupBy(F.when(ends, F.concat("k", F.lit("$"))).otherwise(F.left("k", F.lit(n))).alias("shard"), ends.alias("whole")).agg(F.sum("b").alias("bytes")).persist()
        stays = sized.where(F.col("whole") | (F.col("bytes") <= limit) | F.lit(n == depth))
        found.append(stays.select("shard", "bytes", "whole"))
        open_ = sized.where(~F.col("whole") & (F.col("bytes") > limit) & F.lit(n < depth)).select(F.col("shard").alias("heavy"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def with_shard(keys: DataFrame, prefixes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`keys` with the shard of each: the longest prefix of its loose key that is one. Keys of no shard have null."""
    k = T.loose_key(F.col("key"))
    tries = F.transform(F.sequence(F.lit(1), F.least(F.length(k), F.lit(depth))), lambda i: F.struct(F.left(k, i).alias("p"), i.alias("size")))
    tries = F.concat(F.when(F.length(k) > 0, tries).otherwise(F.array().cast("array<struct<p:string,size:int>>")), F.array(F.struct(F.concat(k, F.lit("$")).alias("p"), F.lit(depth + 1).alias("size"))))
    asked = keys.select("key").distinct().select("key", F.explode(tries).alias("t")).join(prefixes.select("shard"), F.col("t.p") == F.col("shard"))
    best = asked.groupBy("key").agg(F.max_by("shard", "t.size").alias("shard"))
    return keys.join(best, "key", "left")


def write_shards(index: DataFrame, path: str, limit: int = SHARD_BYTES, depth: int = DEPTH) -> DataFrame:
    """The form index as partitions by size-bounded prefix; returns the prefixes, which a reader needs, stored beside it."""
    prefixes = shard_prefixes(index, limit, depth).persist()
    with_shard(index, prefixes, depth).repartition("shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").mode("overwrite").parquet(f"{path}/forms")
    prefixes.write.mode("overwrite").parquet(f"{path}/prefixes")
    return prefixes


def read_shards(spark: SparkSession, path: str, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """The rows of a few `keys`: their shards are resolved by longest prefix, and only those partitions are read."""
    asked = with_shard(spark.createDataFrame([(k,) for k in keys], "key string"), spark.read.parquet(f"{path}/prefixes"), depth)
    shards = [r["shard"] for r in asked.select("shard").distinct().collect() if r["shard"] is not None]  # one a key at most
    loose = [r[0] for r in asked.select(T.loose_key(F.col("key"))).distinct().collect()]
    return spark.read.parquet(f"{path}/forms").where(F.col("shard").isin(shards) & T.loose_key(F.col("key")).isin(loose))


def write_corpus(works: DataFrame, english: DataFrame, path: str) -> DataFrame:
    """Works as JSON by slug; returns the index with has_english as the parallels that are there say, whatever the works claim."""
    works.drop("has_english").repartition("slug").write.mode("overwrite").partitionBy("slug").json(f"{path}/works")
    there = english.select("slug").distinct().withColumn("has_english", F.lit(True))
    return works.drop("has_english").join(there, "slug", "left").select("slug", "title", F.coalesce("has_english", F.lit(False)).alias("has_english"))


def write_report(counts: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    counts.coalesce(1).write.mode("overwrite").json(path)
