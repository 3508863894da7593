"""The corpus pipeline: stages of training-data operators, each on what the one before it kept.

Every stage but the last returns the columns of `documents`. A stage's decisions take effect: rejected
documents go, repeated lines leave their text (a document of which nothing is left goes), of each group of
near-duplicates the smallest doc_id stays, documents that hold benchmark items go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import checkpointed, discard, maybe_broadcast, stored, table
from textloom.llm.decontaminate import find_leaks
from textloom.llm.jaccard import jaccard_components
from textloom.llm.linededup import dedup_lines
from textloom.llm.packing import pack_documents
from textloom.llm.quality import classify
from textloom.llm.queries import vocabulary_path


def _row(docs: DataFrame):
    """All columns as one struct, so that none of them clashes with a helper."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps. `source` stands in for the host and `lang` for the path, as documents have no URL."""
    judged = classify(docs.select("doc_id", "text", "source", "lang", _row(docs)), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return judged.where("keep").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without their repeated lines; one of which nothing is left goes, unless it was blank before. n_chars follows."""
    out = dedup_lines(docs.select("doc_id", "text", _row(docs))).where("n_dropped = 0 or trim(text) <> ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest doc_id (nulls last), also of rows repeated as a whole and of rows without an id.

    Texts are told apart by their fingerprint, so one doc_id can have several; null and blank texts stay."""
    keyed = docs.select(_row(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    found = jaccard_components(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).where("n_shingles > 0")
    groups = checkpointed(found.select(F.col("doc_id").alias("key"), "component_id").distinct())
    at = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("key").alias("key"))
    places = checkpointed(keyed.groupBy("id", "key").agg(F.count("*").alias("n")).join(maybe_broadcast(groups), "key").select("component_id", "n", at.alias("at")))
    first = places.groupBy("component_id").agg(F.min("at").alias("first"))
    judged = checkpointed(places.join(first, "component_id").where("at <> first or n > 1").select("at.*", (F.col("at") == F.col("first")).alias("stays")))
    judged = maybe_broadcast(judged.select(F.col("id").alias("of_id"), F.col("key").alias("of_key"), "stays"))
    marked = keyed.join(judged, keyed["id"].eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    once = marked.where("stays is null").select("row")
    return once.unionByName(marked.where("stays").dropDuplicates(["id", "key"]).select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, with or without a doc_id."""
    keyed = docs.select(_row(docs), F.xxhash64("text").alias("key"))
    texts = keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))
    leaks = checkpointed(find_leaks(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct())
    return keyed.join(maybe_broadcast(leaks), "key", "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Trained models, pivots and tokenizers are beyond SQL; tests/llm/test_pipeline_urls_chat.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are stored once, and dropped when the next stage's are."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
