"""Learner state from an event log: encounters, lookups, promotion, drills, versions and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_status(events: DataFrame, key: str, promote_after: int = 6) -> DataFrame:
    """key, status, encounters, lookups, first_seen, last_seen from (key, at, event_id, kind read | lookup).

    The first event makes the row: new for a read, seen for a lookup. A later read promotes to known when
    encounters - 2 * lookups reaches `promote_after` (0 turns that off); a lookup makes new seen and known
    recognizing. Between two lookups the state can only rise, so blocks of events by the number of lookups
    so far decide it: running counts and one aggregation, and no key's log is ever gathered."""
    w = Window.partitionBy(key).orderBy("at", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    read = (F.col("kind") == "read").cast("int")
    e = events.select(key, "at", "kind", F.row_number().over(w).alias("rn"), F.sum(read).over(run).alias("enc"), F.sum(1 - read).over(run).alias("lk"))
    rises = (F.col("kind") == "read") & (F.col("rn") > 1) & (F.col("enc") - 2 * F.col("lk") >= promote_after) & F.lit(promote_after > 0)
    block = F.when(F.col("kind") == "read", F.col("lk")).otherwise(F.col("lk") - 1)
    blocks = e.groupBy(key, block.alias("block")).agg(
        F.max(rises).alias("known"), F.count_if(F.col("kind") == "read").alias("reads"), F.count_if(F.col("kind") == "lookup").alias("looks"),
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
    )
    total = blocks.groupBy(key).agg(
        F.sum("reads").alias("encounters"), F.sum("looks").alias("lookups"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("known", "block").alias("last_known"), F.max(F.col("known") & (F.col("looks") > 0)).alias("fell"), F.max_by("looks", "block").alias("last_looks"),
    )
    known = F.col("last_known") & (F.col("last_looks") == 0)
    status = F.when(known, "known").when(F.col("fell"), "recognizing").when(F.col("lookups") > 0, "seen").otherwise("new")
    return total.select(key, status.alias("status"), "encounters", "lookups", "first_seen", "last_seen")


def drill_scores(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, interval_days, correct, wrong of (keys, at, event_id, right): a moving average of answers.

    A right answer moves the score by 0.35 of what is missing, a wrong one halves it. The interval starts at
    half a day (a day if the last answer was a day ago or more), grows by 2.2 up to 60 and falls to 0."""
    w = Window.partitionBy(*keys).orderBy("at", "event_id")
    seconds = F.col("at").cast("timestamp").cast("double")
    gap = F.coalesce((seconds - F.lag(seconds).over(w)) / 86400, F.lit(0.0))
    log = answers.select(*keys, "at", "event_id", "right", gap.alias("gap"))
    steps = log.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "right", "gap"))).alias("x"))
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("interval"))

    def step(s: Column, a: Column) -> Column:
        grown = F.when(s["interval"] == 0, F.when(a["gap"] >= 1, F.lit(1.0)).otherwise(F.lit(0.5))).otherwise(F.least(F.lit(60.0), s["interval"] * 2.2))
        return F.struct(
            F.when(a["right"], s["score"] + (1 - s["score"]) * 0.35).otherwise(s["score"] * 0.5).alias("score"),
            F.when(a["right"], grown).otherwise(F.lit(0.0)).alias("interval"),
        )

    out = steps.select(*keys, F.aggregate("x", zero, step).alias("s"), F.size(F.filter("x", lambda a: a["right"])).alias("correct"), F.size("x").alias("n"))
    return out.select(*keys, F.round("s.score", 6).alias("score"), F.round("s.interval", 6).alias("interval_days"), F.col("correct").cast("long").alias("correct"), (F.col("n") - F.col("correct")).cast("long").alias("wrong"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def overlay(base: DataFrame, corrections: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Active corrections laid over a table field by field; corrected rows have confidence 1."""
    c = corrections.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__c"))
    out = base.join(c, base[key] == c["__k"], "left")
    out = out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields} | {"confidence": F.when(F.col("__c"), 1.0).otherwise(F.col("confidence"))})
    return out.drop("__k", "__c", *[f"__{f}" for f in fields])


def supersede(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of a versioned table after `new` (scope, payload columns) is written: nothing is deleted, older rows of the
    scopes written are superseded, new ones get the next version."""
    last = old.groupBy(*scope).agg(F.max("version").alias("last"))
    fresh = new.join(last, scope, "left").withColumn("version", F.coalesce("last", F.lit(0)) + 1).withColumn("superseded", F.lit(False)).drop("last")
    written = new.select(*scope).distinct().withColumn("__w", F.lit(True))
    kept = old.join(written, scope, "left").withColumn("superseded", F.col("superseded") | F.coalesce("__w", F.lit(False))).drop("__w")
    return kept.unionByName(fresh.select(*kept.columns))


def encounter_stats(log: DataFrame) -> DataFrame:
    """lexeme, reads, lookups, the number of forms read and of chapters met, from (lexeme, kind, form, chapter)."""
    read = F.col("kind") == "read"
    return log.groupBy("lexeme").agg(
        F.count_if(read).alias("reads"), F.count_if(F.col("kind") == "lookup").alias("lookups"), F.count_distinct(F.when(read, F.col("form"))).alias("forms"), F.count_distinct("chapter").alias("chapters")
    )


def due_symbols(skills: DataFrame, core: list[str], now: int, limit: int = 12) -> DataFrame:
    """symbol, due: the letters of which a core skill is due by `now`, the most overdue first, `limit` at most: a lesson."""
    due = skills.where(F.col("skill").isin(core)).groupBy("symbol").agg(F.min("due").alias("due"))
    return due.where(F.col("due") <= now).orderBy("due", "symbol").limit(limit)
