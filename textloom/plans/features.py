"""Queries over feature codes, chapter preparation and verdict shares, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import drills as D
from ..operators import features as X
from ..operators import segment as S
from ..sources import english as EN
from .corpus import _docs, _known, _KNOWN, _paragraphs, _PARA, sql_loose, sql_tokens
from .lexicon import PICK, Fixture, Projected

Q: dict = {}
SQL: dict = {}


def query(sql):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


CODES = Projected("codes", "code string", f"""SELECT DISTINCT CASE l_partkey % 6 WHEN 0 THEN 'n:' || {PICK('sg pl', 'l_linenumber')} || ':' || {PICK('nom gen dat acc inst prep', 'l_suppkey')}
    WHEN 1 THEN 'a:' || {PICK('m f n', 'l_linenumber')} || ':sg:' || {PICK('nom gen dat acc inst prep', 'l_suppkey')} WHEN 2 THEN 'a:pl:' || {PICK('nom gen dat acc inst prep', 'l_suppkey')}
    WHEN 3 THEN {PICK('a:short:f a:short:m a:short:pl a:comp a:sup v:inf v:imp:sg v:imp:pl x', 'l_suppkey + l_linenumber')} WHEN 4 THEN 'v:pf:' || {PICK('sg1 sg2 sg3 pl1 pl2 pl3', 'l_suppkey')}
    ELSE {PICK('v:past:m v:past:f v:past:n v:past:pl p:1:sg:nom p:2:pl:dat p:3:sg:inst', 'l_suppkey + l_linenumber')} END AS code FROM {{lineitem}}""")


@query(f"""WITH {CODES.sql}, p AS (SELECT code, split_part(code, ':', 1) AS a, split_part(code, ':', 2) AS b, split_part(code, ':', 3) AS c, split_part(code, ':', 4) AS d FROM codes)
SELECT code, CASE WHEN a = 'n' THEN b WHEN a = 'a' AND b IN ('comp', 'sup') THEN NULL WHEN b IN ('short', 'past') THEN CASE WHEN c = 'pl' THEN 'pl' ELSE 'sg' END WHEN a = 'a' AND b = 'pl' THEN 'pl' WHEN b = 'pf' THEN left(c, 2) WHEN c <> '' THEN c END AS number,
  CASE WHEN a = 'n' OR a = 'a' AND b = 'pl' THEN c WHEN a = 'a' AND length(b) = 1 OR a = 'p' THEN d END AS gcase, CASE WHEN a = 'a' AND length(b) = 1 THEN b WHEN b IN ('short', 'past') AND c <> 'pl' THEN c END AS gender,
  CASE WHEN b = 'pf' THEN CAST(right(c, 1) AS INTEGER) WHEN a = 'p' THEN CAST(b AS INTEGER) END AS person, CASE b WHEN 'pf' THEN 'present-future' WHEN 'past' THEN 'past' WHEN 'imp' THEN 'imperative' WHEN 'inf' THEN 'infinitive' END AS verb_form,
  CASE b WHEN 'short' THEN 'short' WHEN 'comp' THEN 'comparative' WHEN 'sup' THEN 'superlative' END AS degree FROM p""")
def feature_decode(spark, sf_dir):
    return CODES.df(spark, sf_dir).select("code", X.decode_features(F.col("code")).alias("d")).select("code", "d.*")


@query(f"""WITH paras AS ({_PARA}), {sql_tokens('para', 'doc_id, lang, source, chapter', 'paras')}, {_KNOWN},
c AS (SELECT lang, chapter, CASE WHEN regexp_matches(surface, '^\\p{{Lu}}') THEN 'name' ELSE 'word' END AS kind, {sql_loose('surface')} AS key, count(*) AS n FROM tok WHERE kind IN ('word', 'latin') GROUP BY ALL),
f AS (SELECT *, min(chapter) OVER (PARTITION BY lang, kind, key) AS first FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, chapter, kind ORDER BY n DESC, key) AS rn FROM f WHERE chapter = first AND key NOT IN (SELECT key FROM known))
SELECT lang, CAST(chapter AS BIGINT) AS chapter, kind, key, n FROM r WHERE rn <= CASE kind WHEN 'word' THEN 14 ELSE 10 END""")
def chapter_prep(spark, sf_dir):
    t = S.surface_counts(_paragraphs(spark, sf_dir), ["lang", "chapter"], "para").where("kind in ('word', 'latin')").withColumnRenamed("n", "times")
    kind = F.when(F.col("surface").rlike(r"^\p{Lu}"), "name").otherwise("word")
    counts = t.groupBy("lang", F.col("chapter").cast("long").alias("chapter"), kind.alias("kind"), T.loose_key(F.col("surface")).alias("key")).agg(F.sum("times").alias("n"))
    return X.chapter_prep(counts, _known(spark, sf_dir), ["lang"], {"word": 14, "name": 10}).select("lang", "chapter", "kind", "key", "n")


@query(f"""WITH {sql_tokens()}, {_KNOWN}, v AS (SELECT lang, CASE WHEN {sql_loose('surface')} IN (SELECT key FROM known) THEN 'dictionary' WHEN length({sql_loose('surface')}) <= 3 THEN 'closed'
  WHEN regexp_matches({sql_loose('surface')}, '(?:ly|ing)$') THEN 'rule' ELSE 'guess' END AS producer FROM tok WHERE kind IN ('word', 'latin'))
SELECT lang, count(*) AS tokens, round(count(*) FILTER (WHERE producer = 'dictionary') / count(*), 6) AS dictionary, round(count(*) FILTER (WHERE producer = 'closed') / count(*), 6) AS closed,
  round(count(*) FILTER (WHERE producer = 'rule') / count(*), 6) AS rule, round(count(*) FILTER (WHERE producer = 'guess') / count(*), 6) AS guess, 0.0::DOUBLE AS none FROM v GROUP BY ROLLUP (lang)""")
def verdict_shares(spark, sf_dir):
    forms = C.form_counts(S.surface_counts(_docs(spark, sf_dir, False), ["lang"]), "lang")
    hit = forms.join(_known(spark, sf_dir).withColumn("hit", F.lit(True)), "key", "left")
    producer = F.when(F.col("hit"), "dictionary").when(F.length("key") <= 3, "closed").when(F.col("key").rlike("(?:ly|ing)$"), "rule").otherwise("guess")
    return X.verdict_shares(hit.withColumn("producer", producer), "lang")


#: Letters of the alphabet by kind, and pairs a learner confuses.
LETTERS = Fixture("letters", "symbol string, kind string", [(c, "vowel" if c in "АЕЁИОУЫЭЮЯ" else "sign" if c in "ЪЬ" else "consonant") for c in "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"])
PAIRS = [("Ш", "Щ"), ("Ц", "Щ"), ("Ь", "Ъ"), ("Е", "Э"), ("О", "А"), ("Б", "В"), ("П", "Н"), ("Г", "Ч"), ("Х", "Ж"), ("Р", "В")]
CONFUSABLE = Fixture("confusable", "symbol string, other string", PAIRS + [(b, a) for a, b in PAIRS])


@query(f"""WITH {LETTERS.sql}, {CONFUSABLE.sql}, p AS (SELECT a.symbol, b.symbol AS other, row_number() OVER (PARTITION BY a.symbol ORDER BY CASE WHEN c.other IS NULL THEN 1 ELSE 0 END, md5(a.symbol || '|' || b.symbol || '|0'), b.symbol) AS rn
  FROM letters a JOIN letters b ON a.kind = b.kind AND a.symbol <> b.symbol LEFT JOIN confusable c ON c.symbol = a.symbol AND c.other = b.symbol),
o AS (SELECT symbol, other FROM p WHERE rn <= 3 AND symbol IN (SELECT symbol FROM p GROUP BY 1 HAVING count(*) >= 2) UNION ALL SELECT DISTINCT symbol, symbol FROM p WHERE symbol IN (SELECT symbol FROM p GROUP BY 1 HAVING count(*) >= 2))
SELECT symbol, string_agg(other, ' ' ORDER BY md5('0#' || other)) AS options FROM o GROUP BY 1""")
def drill_options(spark, sf_dir):
    return D.distractors(LETTERS.df(spark), CONFUSABLE.df(spark)).select("symbol", F.array_join("options", " ").alias("options"))


_BOOKS = {
    "plain": "title page\n\nCHAPTER I\n\nOne line\nand more\n\nnext\n\nII.\ntext\n\nIII\n\nthree\n\nI\n\nanother work",
    "parts": "PART ONE\nlost\nI\n\nalpha\n\nPART TWO\nI\n\nbeta\n\nII\n\n\nIII\ngamma",
    "letters": "x *** START OF THE PROJECT GUTENBERG EBOOK Z ***\nApril 8th\nDear\n\nJune 1st.\nYours\n*** END OF THE PROJECT GUTENBERG EBOOK Z *** y",
}
BOOKS = Fixture("books", "book string, text string", list(_BOOKS.items()))


@query("""SELECT * FROM (VALUES ('plain', 0::BIGINT, NULL, 'CHAPTER I', 0::BIGINT, 'One line and more'), ('plain', 0, NULL, 'CHAPTER I', 1, 'next'), ('plain', 1, NULL, 'II.', 0, 'text'), ('plain', 2, NULL, 'III', 0, 'three'),
('parts', 0, 'PART ONE', 'I', 0, 'alpha'), ('parts', 1, 'PART TWO', 'I', 0, 'beta'), ('parts', 2, 'PART TWO', 'III', 0, 'gamma'), ('letters', 0, NULL, 'April 8th', 0, 'Dear'), ('letters', 1, NULL, 'June 1st.', 0, 'Yours')) v(book, idx, part, title, paragraph, text)""")
def english_chapters(spark, sf_dir):
    out = EN.english_chapters(BOOKS.df(spark), "book")
    return out.withColumn("idx", F.col("idx").cast("long")).withColumn("paragraph", F.col("paragraph").cast("long"))
