"""Queries over the learner log and versioned annotations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learner as L
from .corpus import read
from .lexicon import PICK, Projected

Q: dict = {}
SQL: dict = {}


def query(sql):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _log(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    return e.select(F.col("user_id").alias("lexeme"), F.col("ts").alias("at"), "event_id", F.when(F.col("event_type") == "view", "read").otherwise("lookup").alias("kind"))


_LOG = "log AS (SELECT user_id AS lexeme, ts AS seen_at, event_id, CASE event_type WHEN 'view' THEN 'read' ELSE 'lookup' END AS kind FROM events WHERE event_type IN ('view', 'click')), num AS (SELECT *, row_number() OVER (PARTITION BY lexeme ORDER BY seen_at, event_id) AS rn FROM log)"
_FOLD = f"""WITH RECURSIVE {_LOG},
f AS (SELECT lexeme, rn, CASE kind WHEN 'read' THEN 'new' ELSE 'seen' END AS status, CASE kind WHEN 'read' THEN 1 ELSE 0 END AS enc, CASE kind WHEN 'read' THEN 0 ELSE 1 END AS lk FROM num WHERE rn = 1
UNION ALL SELECT n.lexeme, n.rn, CASE WHEN n.kind = 'lookup' AND f.status = 'new' THEN 'seen' WHEN n.kind = 'lookup' AND f.status = 'known' THEN 'recognizing'
    WHEN n.kind = 'read' AND f.status <> 'known' AND f.enc + 1 - 2 * f.lk >= 6 THEN 'known' ELSE f.status END,
  f.enc + CASE n.kind WHEN 'read' THEN 1 ELSE 0 END, f.lk + CASE n.kind WHEN 'read' THEN 0 ELSE 1 END FROM f JOIN num n ON n.lexeme = f.lexeme AND n.rn = f.rn + 1)"""


@query(f"{_FOLD} SELECT f.lexeme, f.status, CAST(f.enc AS BIGINT) AS encounters, CAST(f.lk AS BIGINT) AS lookups FROM f JOIN (SELECT lexeme, max(rn) AS rn FROM num GROUP BY 1) m USING (lexeme, rn)")
def learner_status_fold(spark, sf_dir):
    return L.word_status(_log(spark, sf_dir), "lexeme").select("lexeme", "status", "encounters", "lookups")


@query(f"{_FOLD} SELECT f.status, count(*) AS n FROM f JOIN (SELECT lexeme, max(rn) AS rn FROM num GROUP BY 1) m USING (lexeme, rn) GROUP BY 1")
def status_histogram(spark, sf_dir):
    return L.word_status(_log(spark, sf_dir), "lexeme").groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_FOLD} SELECT f.lexeme, CASE WHEN f.lk = 0 AND f.status <> 'known' THEN 'known' ELSE f.status END AS status, f.lk = 0 AND f.status <> 'known' AS marked FROM f JOIN (SELECT lexeme, max(rn) AS rn FROM num GROUP BY 1) m USING (lexeme, rn)")
def mark_unlooked_known(spark, sf_dir):
    mark = (F.col("lookups") == 0) & (F.col("status") != "known")
    return L.word_status(_log(spark, sf_dir), "lexeme").select("lexeme", F.when(mark, "known").otherwise(F.col("status")).alias("status"), mark.alias("marked"))


@query("""WITH RECURSIVE a AS (SELECT user_id AS symbol, event_type IN ('view', 'purchase') AS ok, row_number() OVER w AS rn, coalesce(epoch(ts) - lag(epoch(ts)) OVER w, 0) / 86400 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT symbol, 0::BIGINT AS rn, 0.0::DOUBLE AS score, 0.0::DOUBLE AS iv, 0::BIGINT AS c, 0::BIGINT AS w FROM (SELECT DISTINCT symbol FROM a)
UNION ALL SELECT a.symbol, a.rn, CASE WHEN ok THEN score + (1 - score) * 0.35::DOUBLE ELSE score * 0.5::DOUBLE END,
  CASE WHEN NOT ok THEN 0 WHEN iv = 0 THEN CASE WHEN gap >= 1 THEN 1 ELSE 0.5 END ELSE least(60::DOUBLE, iv * 2.2::DOUBLE) END, c + CAST(ok AS BIGINT), w + CAST(NOT ok AS BIGINT)
  FROM f JOIN a ON a.symbol = f.symbol AND a.rn = f.rn + 1)
SELECT f.symbol, round(score, 6) AS score, round(iv, 6) AS interval_days, c AS correct, w AS wrong FROM f JOIN (SELECT symbol, max(rn) AS rn FROM a GROUP BY 1) m USING (symbol, rn)""")
def drill_ema_fold(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("ts").alias("at"), "event_id", F.col("event_type").isin("view", "purchase").alias("right"))
    return L.drill_scores(e, ["symbol"])


#: A reading log and skills of letters, of the shapes that the operators take.
READING = Projected("reading", "lexeme string, kind string, form string, chapter int", f"SELECT 'u' || CAST(user_id AS STRING) AS lexeme, CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'lookup' END AS kind, 'f' || CAST(event_id % 7 AS STRING) AS form, event_id % 50 AS chapter FROM {{events}}", [
    ("noun:дом", "read", "дом", 1), ("noun:дом", "read", "дома", 1), ("noun:дом", "lookup", "доме", 2), ("noun:дом", "read", "дом", 3), ("verb:идти", "lookup", "шёл", 1), ("noun:кот", "read", "кот", 2), ("noun:кот", "read", "кот", 2),
])
SKILLS = Projected("skills", "symbol string, skill string, due int", f"SELECT CAST(user_id AS STRING) AS symbol, {PICK('symbol_to_sound sound_to_symbol visual cursive word', 'event_id')} AS skill, CASE WHEN event_id % 13 <> 0 THEN event_id % 1009 END AS due FROM {{events}}", [
    (s, k, d) for i, s in enumerate("АБВГДЕЖЗИКЛМНОП") for k, d in (("symbol_to_sound", 10 + i), ("sound_to_symbol", 40 - 2 * i), ("visual", 25), ("cursive", 0), ("word", 0 if i % 2 else None))
])
CORE_SKILLS = ["symbol_to_sound", "sound_to_symbol", "visual", "word"]


@query(f"WITH {READING.sql} SELECT lexeme, count(*) FILTER (WHERE kind = 'read') AS reads, count(*) FILTER (WHERE kind = 'lookup') AS lookups, count(DISTINCT form) FILTER (WHERE kind = 'read') AS forms, count(DISTINCT chapter) AS chapters FROM reading GROUP BY 1")
def encounter_stats(spark, sf_dir):
    return L.encounter_stats(READING.df(spark, sf_dir))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def continue_reading(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return L.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(f"WITH {SKILLS.sql} SELECT symbol, min(due) AS due FROM skills WHERE skill IN ({', '.join(repr(k) for k in CORE_SKILLS)}) GROUP BY 1 HAVING min(due) <= 22 ORDER BY due, symbol LIMIT 12")
def due_symbols(spark, sf_dir):
    return L.due_symbols(SKILLS.df(spark, sf_dir), CORE_SKILLS, 22)


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'junk' END, d.lang) AS lang, CASE WHEN l.quality = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality = 0) l USING (doc_id)")
def correction_overlay(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(0.5).alias("confidence"))
    fixes = read(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("junk").alias("lang")).distinct()
    return L.overlay(docs, fixes, "doc_id", ["lang"])


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 3 + 1 AS version, false AS superseded FROM events WHERE event_type = 'view'),
n AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
SELECT user_id, event_id, version, user_id IN (SELECT user_id FROM n) AS superseded FROM o
UNION ALL SELECT user_id, 0, coalesce((SELECT max(version) FROM o WHERE o.user_id = n.user_id), 0) + 1, false FROM n""")
def version_supersede(spark, sf_dir):
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    old = e.where("event_type = 'view'").select("user_id", "event_id", (rn % 3 + 1).cast("long").alias("version"), F.lit(False).alias("superseded"))
    new = e.where("event_type = 'signup'").select("user_id", F.lit(0).cast("long").alias("event_id")).distinct()
    return L.supersede(old, new, ["user_id"])
