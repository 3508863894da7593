"""Paragraph markup with its ranges, and the functions for users of SQL, over the given tables."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from ..functions import sql as registered
from ..functions import text as T
from ..operators import exports as E
from ..sources import fragments as G
from .corpus import _q, read, sql_loose, sql_tokens

Q: dict = {}
SQL: dict = {}

#: Words of `pages` that stand for markup its paragraphs lack: emphasis that nests or stays open, notes, references.
MARKUP = {" the ": "&nbsp;<i>the</i>\n", " in ": " <SUP class=n>1 <i>no</i></sup>in&shy; ", " an ": " </b><em>an <Strong>", " of ": "&#32;of</EM>&#x2014;", " de ": " </sup>&de;<b>de </strong>", " ": "  "}


def _replaced(c: str) -> str:
    for word, markup in MARKUP.items():
        c = f"replace({c}, {_q(word)}, {_q(markup)})"
    return c


def page_fragments(spark, sf_dir):
    """Text and emphasis of each paragraph of `pages`."""
    parts = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("fragment", "part")).where("fragment > 0")
    markup = F.split_part("part", F.lit("</p>"), F.lit(1))
    for word, put in MARKUP.items():
        markup = F.replace(markup, F.lit(word), F.lit(put))
    found = G.fragments(parts, ["page_id", "fragment"], markup)
    shown = F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"), r["kind"])), ",")
    return found.select("page_id", "fragment", "text", shown.alias("ranges"))


Q["page_fragments"] = page_fragments
_NAMED = " ".join(f"WHEN '{n}' THEN {_q(html5[n + ';'])}" for n in G.ENTITIES)
_KIND = " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in G.EMPHASIS.items())
_IN = "PARTITION BY page_id, fragment"
_AT = "length(regexp_replace(left(raw, {}), '[\\x{{09}}-\\x{{0D}} \\x{{A0}}\\x{{AD}}]+', ' ', 'g')) - lead"
SQL["page_fragments"] = f"""
WITH part AS (SELECT page_id, generate_subscripts(p, 1) - 1 AS fragment, unnest(p) AS part FROM (SELECT page_id, string_split(html, '<p>') AS p FROM pages)),
frag AS (SELECT page_id, fragment::INT AS fragment, {_replaced("split_part(part, '</p>', 1)")} AS f FROM part WHERE fragment > 0),
piece AS (SELECT page_id, fragment, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT *, regexp_extract_all(f, {_q(G.PIECE)}) AS p FROM frag)),
tagged AS (SELECT *, CASE WHEN s LIKE '<_%' THEN lower(regexp_extract(s, '^</?([a-zA-Z0-9]+)', 1)) END AS tag, s LIKE '</%' AS ends FROM piece),
summed AS (SELECT *, sum(CASE WHEN tag = 'sup' THEN CASE WHEN ends THEN -1 ELSE 1 END ELSE 0 END) OVER ({_IN} ORDER BY i) AS d FROM tagged),
shown AS (SELECT * FROM (SELECT *, d - least(0, min(d) OVER ({_IN} ORDER BY i)) AS depth FROM summed) WHERE depth = 0 AND tag IS DISTINCT FROM 'sup'),
said AS (SELECT *, CASE tag {_KIND} END AS kind, CASE WHEN tag IN ({', '.join(map(_q, G.BREAKS))}) THEN ' ' WHEN tag IS NOT NULL THEN ''
  WHEN regexp_matches(s, '^&#[xX]') THEN chr(('0x' || regexp_extract(s, '([0-9a-fA-F]+);', 1))::INT) WHEN s LIKE '&#%' THEN chr(regexp_extract(s, '[0-9]+')::INT)
  WHEN s LIKE '&_%;' THEN CASE substr(s, 2, length(s) - 2) {_NAMED} ELSE s END ELSE s END AS o FROM shown),
placed AS (SELECT *, coalesce(sum(length(o)) OVER ({_IN} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM said),
whole AS (SELECT f.page_id, f.fragment, coalesce(t.raw, '') AS raw, CASE WHEN regexp_matches(t.raw, '^[\\x{{09}}-\\x{{0D}} \\x{{A0}}\\x{{AD}}]') THEN 1 ELSE 0 END AS lead,
  trim(regexp_replace(coalesce(t.raw, ''), '[\\x{{09}}-\\x{{0D}} \\x{{A0}}\\x{{AD}}]+', ' ', 'g')) AS text
  FROM frag f LEFT JOIN (SELECT page_id, fragment, string_agg(o, '' ORDER BY i) AS raw FROM placed GROUP BY ALL) t USING (page_id, fragment)),
steps AS (SELECT *, sum(CASE WHEN ends THEN -1 ELSE 1 END) OVER ({_IN}, kind ORDER BY i) AS n FROM placed WHERE kind IS NOT NULL),
levels AS (SELECT *, n - least(0, min(n) OVER ({_IN}, kind ORDER BY i)) AS level FROM steps),
spans AS (SELECT a.page_id, a.fragment, a.kind, a.i, a.pos AS s, (SELECT min(b.pos) FROM levels b WHERE b.page_id = a.page_id AND b.fragment = a.fragment AND b.kind = a.kind AND b.ends AND b.i > a.i AND b.level = a.level - 1) AS e
  FROM levels a WHERE NOT a.ends),
kept AS (SELECT w.page_id, w.fragment, kind, s, coalesce(e, length(raw)) AS e, i, greatest(0, least(length(text), {_AT.format('s::BIGINT')})) AS ns,
  greatest(0, least(length(text), {_AT.format('coalesce(e, length(raw))::BIGINT')})) AS ne FROM spans JOIN whole w USING (page_id, fragment)),
listed AS (SELECT page_id, fragment, string_agg(ns || ':' || ne || ':' || kind, ',' ORDER BY s, e, kind) AS ranges FROM kept WHERE ne > ns GROUP BY ALL)
SELECT page_id, fragment, text, coalesce(ranges, '') AS ranges FROM whole LEFT JOIN listed USING (page_id, fragment)"""


def sql_functions(spark, sf_dir):
    """Tokens and distinct keys by language and kind, asked for in SQL through the registered functions; English is read as Cyrillic."""
    registered.register(spark)
    docs = read(spark, sf_dir, "documents").select("lang", F.when(F.col("lang") == "en", T.cyrillic_projection(F.col("text"))).otherwise(F.col("text")).alias("text"))
    return spark.sql(
        """SELECT lang, kind, sum(n) AS tokens, count(DISTINCT loose_key(surface)) AS keys
        FROM (SELECT lang, t.kind, t.surface, count(*) AS n FROM (SELECT lang, tokens(text) AS found FROM {docs}) LATERAL VIEW inline(found) t GROUP BY ALL) GROUP BY ALL""",
        docs=docs,
    )


Q["sql_functions"] = sql_functions
_READ = f"CASE WHEN lang = 'en' THEN translate(text, {_q(T.LATIN_52)}, {_q(T.CYRILLIC_52)}) ELSE text END"
SQL["sql_functions"] = f"WITH {sql_tokens(_READ)} SELECT lang, kind, count(*) AS tokens, count(DISTINCT {sql_loose('surface')}) AS keys FROM tok GROUP BY ALL"


def export_import(spark, sf_dir):
    """`events` and `labels` after the import of an export into older copies: events without values and without those of type
    error, labels without the toxic ones and with the quality unknown."""
    events, labels = read(spark, sf_dir, "events"), read(spark, sf_dir, "labels")
    rows = E.export({"events": events.where("event_type <> 'view'"), "labels": labels.withColumn("quality", F.when(F.col("toxic") == 0, F.col("quality")))}, {"events": ["props"]})
    older = {
        "events": events.where("event_type <> 'error'").withColumn("value", F.lit(None).cast("double")),
        "labels": labels.where("toxic = 0").withColumn("quality", F.lit(7).cast(labels.schema["quality"].dataType)),
    }
    after = E.import_all(older, rows, {"events": ["event_id"], "labels": ["doc_id"]})
    of_event = after["events"].select(F.lit("events").alias("table_name"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value", "props", F.col("user_id").alias("n"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    of_label = after["labels"].select(
        F.lit("labels").alias("table_name"), F.col("doc_id").alias("id"), none("long", "at"), none("string", "event_type"), F.col("quality").cast("double").alias("value"), none("string", "props"), F.col("toxic").cast("long").alias("n")
    )
    return of_event.unionByName(of_label)


Q["export_import"] = export_import
SQL["export_import"] = """
SELECT 'events' AS table_name, event_id AS id, epoch_us(ts) AS at, event_type, CASE WHEN event_type <> 'view' THEN value END AS value,
  CASE WHEN event_type <> 'error' THEN props END AS props, user_id AS n FROM events
UNION ALL SELECT 'labels', doc_id, NULL, NULL, CASE WHEN toxic = 0 THEN coalesce(quality, 7) ELSE NULL END, NULL, toxic FROM labels"""
