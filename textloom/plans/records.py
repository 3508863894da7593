"""Queries over stored books, analyses, corrections and learner records: the given tables in the operators' own shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as R
from .corpus import _q, sql_loose
from .lexicon import Fixture, Projected

Q: dict = {}
SQL: dict = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_TURN = "conv_id * 1000 + turn"
RUNS = Projected("runs", "chapter long, version long, tag string", "SELECT user_id AS chapter, event_id AS version, CASE event_id % 3 WHEN 0 THEN '6+r1' WHEN 1 THEN '6+r2' ELSE '7+r1' END AS tag FROM {events}")
ANALYSES = Projected("analyses", "token_id long, rank int, version int, superseded boolean, key string", """SELECT l_orderkey AS token_id, l_linenumber - 1 AS rank, 1 + l_partkey % 2 AS version, l_suppkey % 3 = 0 AS superseded,
    CASE WHEN l_partkey % 5 = 0 THEN '?' ELSE '' END || 'noun:' || CAST(l_partkey AS STRING) AS key FROM {lineitem}""")
LOG = Projected("log", "id long, target_type string, target_id long, lemma string, book_id long, revokes long", """SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'token' WHEN 1 THEN 'lexeme' ELSE 'sentence' END END AS target_type,
    CASE WHEN event_id % 11 <> 0 THEN user_id END AS target_id, event_type AS lemma, user_id % 4 AS book_id, CASE WHEN event_id % 11 = 0 THEN event_id - 7 END AS revokes FROM {events}""")
PARAS = Projected("paras", "chapter long, i int, kind string, text string, title string, part string", """SELECT conv_id AS chapter, turn AS i, CASE WHEN turn < 3 THEN 'heading' ELSE 'text' END AS kind, 'Talk ' || CAST(conv_id AS STRING) AS title,
    CASE WHEN conv_id % 4 <> 0 THEN 'Part ' || CAST(conv_id % 5 AS STRING) END AS part,
    CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN ' TALK   ' || CAST(conv_id AS STRING) WHEN turn = 1 AND conv_id % 2 = 0 THEN 'part  ' || CAST(conv_id % 5 AS STRING) WHEN turn = 2 THEN 'Talk ' || CAST(conv_id AS STRING) ELSE text END AS text FROM {conversations}""")
SENSES = Projected("senses", "lexeme_id string, lemma string, pos string, gloss string, n int", "SELECT 'noun:' || CAST(p_partkey AS STRING) AS lexeme_id, p_name AS lemma, lower(p_type) AS pos, p_brand AS gloss, 1 + p_size % 9 AS n FROM {part}")
INDEX = Projected("idx", "key string, lexeme_id string, code string", "SELECT DISTINCT 'f' || CAST(l_suppkey AS STRING) AS key, 'noun:' || CAST(l_partkey AS STRING) AS lexeme_id, l_returnflag AS code FROM {lineitem}")
WORK = Projected("work", "key string", "SELECT 'f' || CAST(s_suppkey AS STRING) AS key FROM {supplier} WHERE s_acctbal > 5000")
CHAPTERS = Projected("chapters", "work long, idx int, chapter_id long, title string, body string", f"SELECT conv_id AS work, turn AS idx, {_TURN} AS chapter_id, role AS title, text AS body FROM {{conversations}}")
PARALLEL = Projected("parallel", "work long, idx int, confidence double, body string", "SELECT conv_id AS work, turn AS idx, CASE (turn + conv_id) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.6 END AS confidence, role AS body FROM {conversations}")
EXISTING = Projected("existing", "chapter_id long", f"SELECT {_TURN} AS chapter_id FROM {{conversations}} WHERE role = 'system' OR turn = 3")
TOKENS = Projected("toks", "sentence_id long, book string, kind string, surface string, key string", """SELECT l_orderkey AS sentence_id, l_returnflag || l_linestatus AS book, CASE WHEN l_linenumber = 7 THEN 'note' ELSE 'text' END AS kind,
    CASE WHEN l_suppkey % 2 = 0 THEN 'Form' ELSE 'form' END || CAST(l_suppkey % 7 AS STRING) AS surface, CASE WHEN l_partkey % 7 = 0 THEN '?' ELSE '' END || 'noun:' || CAST(l_partkey % 60 AS STRING) AS key FROM {lineitem}""")
_TENTH = lambda c: f"CAST({c} % 11 AS DOUBLE) / 10"
SKILLS = Projected("skills", "symbol string, reading double, hearing double, writing double, recall double", f"SELECT CAST(p_partkey AS STRING) AS symbol, {_TENTH('p_size')} AS reading, {_TENTH('p_partkey')} AS hearing, {_TENTH('(p_partkey * 3)')} AS writing, {_TENTH('(p_size + p_partkey)')} AS recall FROM {{part}}")
CALLS = Projected("calls", "call long, text string", f"SELECT {_TURN} AS call, text FROM {{conversations}}")
INTRODUCED = Projected("introduced", "symbol string, day long", "SELECT substr('ABCDEFGHIKLMNOPQRSTUVWXY', CAST(1 + user_id % 24 AS INT), 1) AS symbol, (event_id * 7) % 4001 AS day FROM {events}")
COMPUTED = Projected("computed", "key string, status string", "SELECT CAST(c_custkey AS STRING) AS key, CASE c_nationkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'known' ELSE 'seen' END AS status FROM {customer}")
MANUAL = Projected("manual", "event_id long, key string, status string", "SELECT event_id, CAST(user_id * 2 AS STRING) AS key, CASE event_type WHEN 'view' THEN 'known' WHEN 'click' THEN 'mastered' ELSE 'ignored' END AS status FROM {events}")
PASSED = Projected("passed", "chapter long, paragraph long", "SELECT user_id AS chapter, (event_id * 13) % 97 AS paragraph FROM {events}")
SIZES = Projected("sizes", "chapter long, paragraphs long", "SELECT c_custkey AS chapter, 97 + c_nationkey AS paragraphs FROM {customer}")
_NAME = f"translate(p_name, {_q(T.LATIN_52)}, {_q(T.CYRILLIC_52)})"
SPELLINGS = Projected("spellings", "a string, b string", f"SELECT a, CASE k WHEN 0 THEN replace(a, 'е', 'ё') WHEN 1 THEN replace(a, 'е', 'ѣ') WHEN 2 THEN a || 'ъ' WHEN 3 THEN replace(a, 'о', 'а') ELSE a END AS b FROM (SELECT {_NAME} AS a, p_partkey % 5 AS k FROM {{part}}) x")
ALIGNED = Projected("aligned", "work long, idx long, confidence double", "SELECT o_custkey AS work, o_orderkey AS idx, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END AS confidence FROM {orders}")
LIBRARY = Projected("library", "shelf int, slug string, level int, position long", "SELECT s_nationkey AS shelf, 's' || CAST(s_suppkey AS STRING) AS slug, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 5 END AS level, s_suppkey AS position FROM {supplier}")
CAST = Projected("cast_", "book int, canonical string", "SELECT c_nationkey AS book, split_part('Ёлкин Ежов Жуков Елагин Ёж', ' ', CAST(1 + c_custkey % 5 AS INT)) || CAST(c_custkey AS STRING) AS canonical FROM {customer}")
VOCAB = Projected("vocab", "key string, last_seen int, forms string", "SELECT p_name || CAST(p_partkey AS STRING) AS key, p_size AS last_seen, p_brand || ' ' || p_type AS forms FROM {part}")
COURSE = Fixture("course", "stage int, letters string", [(1, "ANTOE"), (2, "VNRSI")])
FREQUENT = Projected("frequent", "letter string, n long", "SELECT substr('AKMOTVNRSEI', CAST(1 + user_id % 11 AS INT), 1) AS letter, count(*) AS n FROM {events} GROUP BY substr('AKMOTVNRSEI', CAST(1 + user_id % 11 AS INT), 1)")


@query(f"WITH {RUNS.sql} SELECT chapter, CAST(CASE WHEN arg_max(tag, version) = '6+r2' THEN max(version) ELSE max(version) + 1 END AS INTEGER) AS version FROM runs GROUP BY 1")
def analysis_version(spark, sf_dir):
    return R.version_of(RUNS.df(spark, sf_dir), ["chapter"], F.lit("6+r2"))


@query(f"WITH {ANALYSES.sql} SELECT token_id, key FROM analyses WHERE NOT superseded AND rank = 0")
def current_analyses(spark, sf_dir):
    return ANALYSES.df(spark, sf_dir).where("not superseded and rank = 0").select("token_id", "key")


@query(f"""WITH {LOG.sql} SELECT id, target_type, target_id, lemma, book_id, NOT EXISTS (SELECT 1 FROM log b WHERE b.target_type = a.target_type AND b.target_id = a.target_id AND b.id > a.id)
  AND id NOT IN (SELECT revokes FROM log WHERE revokes IS NOT NULL) AS active FROM log a WHERE revokes IS NULL""")
def correction_states(spark, sf_dir):
    return R.corrections(LOG.df(spark, sf_dir))


@query(f"WITH {LOG.sql} SELECT max(id) AS id, target_type, target_id FROM log WHERE revokes IS NULL AND book_id = 1 GROUP BY 2, 3 HAVING max(id) NOT IN (SELECT revokes FROM log WHERE revokes IS NOT NULL)")
def active_corrections_of_book(spark, sf_dir):
    return R.corrections(LOG.df(spark, sf_dir)).where("active and book_id = 1").select("id", "target_type", "target_id")


_SPACED = lambda c: f"lower(trim(regexp_replace({c}, '[\\x{{0009}}-\\x{{000D}} \\x{{00A0}}\\x{{00AD}}]+', ' ', 'g')))"


@query(f"""WITH {PARAS.sql}, r AS (SELECT *, kind = 'heading' AND coalesce({_SPACED('text')} = {_SPACED('title')} OR {_SPACED('text')} = {_SPACED("coalesce(part, '')")}, false) AS same FROM paras)
SELECT chapter, i, kind, text FROM r QUALIFY NOT bool_and(same) OVER (PARTITION BY chapter ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def title_repeats(spark, sf_dir):
    return R.without_title_repeats(PARAS.df(spark, sf_dir), ["chapter"]).select("chapter", "i", "kind", "text")


def _lexemes(spark, sf_dir):
    return SENSES.df(spark, sf_dir).withColumn("senses", F.transform(F.sequence(F.lit(1), "n"), lambda i: F.concat("gloss", i.cast("string"))))


@query(f"WITH {SENSES.sql}, {INDEX.sql}, {WORK.sql} SELECT lexeme_id, lemma, pos, gloss, CAST(least(n, 6) AS INTEGER) AS senses, gloss || least(n, 6) AS last_sense FROM senses WHERE lexeme_id IN (SELECT lexeme_id FROM idx WHERE key IN (SELECT key FROM work))")
def work_bundle(spark, sf_dir):
    _, lexemes = R.bundle(INDEX.df(spark, sf_dir), _lexemes(spark, sf_dir), WORK.df(spark, sf_dir))
    return lexemes.withColumns({"last_sense": F.element_at("senses", -1), "senses": F.size("senses")})


@query(f"WITH {INDEX.sql}, {WORK.sql} SELECT key, lexeme_id, code FROM idx WHERE key IN (SELECT key FROM work)")
def work_bundle_forms(spark, sf_dir):
    return R.bundle(INDEX.df(spark, sf_dir), _lexemes(spark, sf_dir), WORK.df(spark, sf_dir))[0]


@query(f"WITH {CHAPTERS.sql}, {PARALLEL.sql}, {EXISTING.sql} SELECT c.work, c.idx, c.chapter_id, p.confidence, p.body FROM chapters c JOIN parallel p ON p.work = c.work AND p.idx = c.idx WHERE p.confidence > 0 AND c.chapter_id NOT IN (SELECT chapter_id FROM existing)")
def parallel_chapters(spark, sf_dir):
    return R.parallels(CHAPTERS.df(spark, sf_dir).drop("body"), PARALLEL.df(spark, sf_dir), EXISTING.df(spark, sf_dir), "work")


@query(f"WITH {TOKENS.sql} SELECT book, count(*) AS tokens, count(*) FILTER (WHERE NOT starts_with(key, '?')) AS resolved, round(1 - count(*) FILTER (WHERE NOT starts_with(key, '?')) / count(*), 6) AS guess_share FROM toks WHERE kind <> 'note' GROUP BY 1")
def resolved_shares(spark, sf_dir):
    return R.resolved_shares(TOKENS.df(spark, sf_dir), "book")


@query(f"WITH {TOKENS.sql} SELECT book, lower(surface) AS form, count(*) AS n FROM toks WHERE key = 'noun:1' GROUP BY 1, 2")
def form_occurrences(spark, sf_dir):
    return TOKENS.df(spark, sf_dir).where("key = 'noun:1'").groupBy("book", F.lower("surface").alias("form")).agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS.sql} SELECT key, count(*) AS n FROM toks WHERE NOT starts_with(key, '?') GROUP BY 1")
def lemma_counts(spark, sf_dir):
    return TOKENS.df(spark, sf_dir).where(~F.col("key").startswith("?")).groupBy("key").agg(F.count("*").alias("n"))


@query(f"WITH {CHAPTERS.sql} SELECT work, CAST(sum(len(regexp_extract_all(body, '\\p{{L}}+(?:-\\p{{L}}+)*'))) AS BIGINT) AS words FROM chapters GROUP BY 1")
def chapter_words(spark, sf_dir):
    words = F.size(F.regexp_extract_all("body", F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0)))
    return CHAPTERS.df(spark, sf_dir).groupBy("work").agg(F.sum(words).alias("words"))


@query(f"WITH {SKILLS.sql} SELECT symbol, CAST(round(100 * (reading + hearing + writing + recall) / 4) AS INTEGER) AS percent, least(reading, hearing, writing, recall) >= 0.8 AS mastered FROM skills")
def letter_mastery(spark, sf_dir):
    return R.mastery(SKILLS.df(spark, sf_dir))


@query(f"WITH {CALLS.sql}, {INTRODUCED.sql}, l AS (SELECT DISTINCT call, upper(unnest(regexp_extract_all(text, '\\p{{L}}'))) AS symbol FROM calls) SELECT symbol, round(least(1.0, count(*) * 0.05::DOUBLE), 6) AS context FROM l WHERE symbol IN (SELECT symbol FROM introduced) GROUP BY 1")
def context_exposure(spark, sf_dir):
    return R.exposures(CALLS.df(spark, sf_dir), INTRODUCED.df(spark, sf_dir))


@query(f"WITH {INTRODUCED.sql} SELECT symbol, min(day) AS day FROM introduced GROUP BY 1")
def letter_introductions(spark, sf_dir):
    return R.introductions(INTRODUCED.df(spark, sf_dir))


@query(f"WITH {COMPUTED.sql}, {MANUAL.sql}, m AS (SELECT key, arg_max(status, event_id) AS by_hand FROM manual GROUP BY 1) SELECT key, coalesce(by_hand, status) AS status FROM computed FULL JOIN m USING (key)")
def manual_statuses(spark, sf_dir):
    return R.manual_status(COMPUTED.df(spark, sf_dir), MANUAL.df(spark, sf_dir))


@query(f"WITH {PASSED.sql}, {SIZES.sql} SELECT chapter, count(DISTINCT paragraph) AS read, max(paragraph) AS furthest, CAST(round(100 * count(DISTINCT paragraph) / any_value(paragraphs)) AS INTEGER) AS percent FROM passed JOIN sizes USING (chapter) GROUP BY 1")
def reading_progress(spark, sf_dir):
    return R.reading_progress(PASSED.df(spark, sf_dir), SIZES.df(spark, sf_dir))


@query(f"WITH {SPELLINGS.sql} SELECT a, b, {sql_loose('a')} = {sql_loose('b')} AND length(a) = length(b) AND a <> b AS variant FROM spellings")
def spelling_variants(spark, sf_dir):
    return R.orthographic_variants(SPELLINGS.df(spark, sf_dir))


@query(f"WITH {ALIGNED.sql}, w AS (SELECT work, avg(confidence) AS c FROM aligned GROUP BY 1) SELECT CASE WHEN c = 1 THEN 'full' WHEN c > 0 THEN 'partial' ELSE 'none' END AS kind, count(*) AS works FROM w GROUP BY 1")
def alignment_summary(spark, sf_dir):
    per = ALIGNED.df(spark, sf_dir).groupBy("work").agg(F.avg("confidence").alias("c"))
    return per.groupBy(F.when(F.col("c") == 1, "full").when(F.col("c") > 0, "partial").otherwise("none").alias("kind")).agg(F.count("*").alias("works"))


@query(f"WITH {LIBRARY.sql} SELECT shelf, slug, CAST(row_number() OVER (PARTITION BY shelf ORDER BY level NULLS LAST, position) AS INTEGER) AS place FROM library")
def library_order(spark, sf_dir):
    order = Window.partitionBy("shelf").orderBy(F.asc_nulls_last("level"), "position")
    return LIBRARY.df(spark, sf_dir).select("shelf", "slug", F.row_number().over(order).alias("place"))


@query(f"WITH {CAST.sql} SELECT book, canonical, CAST(row_number() OVER (PARTITION BY book ORDER BY replace(replace(canonical, 'ё', 'е'), 'Ё', 'Е'), canonical) AS INTEGER) AS place FROM cast_")
def names_collated(spark, sf_dir):
    order = Window.partitionBy("book").orderBy(F.translate("canonical", "ёЁ", "еЕ"), "canonical")
    return CAST.df(spark, sf_dir).select("book", "canonical", F.row_number().over(order).alias("place"))


@query(f"WITH {VOCAB.sql} SELECT key, last_seen FROM vocab WHERE contains(lower(forms), 'k') OR contains(key, 'd') ORDER BY last_seen DESC, key LIMIT 400")
def vocabulary_search(spark, sf_dir):
    hit = F.exists(F.split("forms", " "), lambda f: F.lower(f).contains("k")) | F.col("key").contains("d")
    return VOCAB.df(spark, sf_dir).where(hit).orderBy(F.desc("last_seen"), "key").limit(400).select("key", "last_seen")


@query(f"WITH {COURSE.sql}, {FREQUENT.sql} SELECT stage, letter, CAST(row_number() OVER (PARTITION BY stage ORDER BY n DESC, letter) AS INTEGER) AS place FROM course JOIN frequent ON contains(letters, letter)")
def stage_letters(spark, sf_dir):
    letters = COURSE.df(spark, sf_dir).select("stage", F.explode(F.filter(F.split("letters", ""), lambda c: c != "")).alias("letter")).join(FREQUENT.df(spark, sf_dir), "letter")
    return letters.select("stage", "letter", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("n"), "letter")).alias("place"))


@query(f"WITH {COURSE.sql}, {INTRODUCED.sql} SELECT symbol FROM introduced UNION SELECT unnest(string_split(letters, '')) FROM course WHERE stage = 1")
def known_letters(spark, sf_dir):
    course = COURSE.df(spark, sf_dir).where("stage = 1").select(F.explode(F.filter(F.split("letters", ""), lambda c: c != "")).alias("symbol"))
    return INTRODUCED.df(spark, sf_dir).select("symbol").union(course).distinct()


FEATURES = Projected("features", "features string", """SELECT 'case=' || split_part('nom gen dat acc inst prep odd', ' ', CAST(1 + l_partkey % 7 AS INT)) || CASE WHEN l_suppkey % 2 = 0 THEN ';gender=m' ELSE '' END || ';number=' || CASE WHEN l_linenumber % 2 = 0 THEN 'pl' ELSE 'sg' END
    || CASE WHEN l_partkey % 3 = 0 THEN ';aspect=perfective;verb_form=past' ELSE ';x' END AS features FROM {lineitem}""")
STRESSED = Projected("stressed", "form string, stress int, printed string, known string", f"SELECT a AS form, s % 9 - 1 AS stress, a AS printed, CASE k WHEN 0 THEN replace(a, 'е', 'ё') WHEN 1 THEN replace(lower(a), 'е', 'ё') WHEN 2 THEN a || 'ё' ELSE replace(replace(a, 'е', 'ё'), 'о', 'а') END AS known FROM (SELECT {_NAME} AS a, p_size AS s, p_partkey % 4 AS k FROM {{part}}) x")
VARIANTS = Projected("variants", "work long, i int, kind string, text string", """SELECT conv_id AS work, turn AS i, CASE WHEN (turn + conv_id) % 2 = 0 THEN 'heading' ELSE 'text' END AS kind,
    CASE WHEN turn >= 1 + conv_id % 4 AND role = 'assistant' THEN 'Стр. ' || CAST(turn AS STRING) || ', строка 3' ELSE role END AS text FROM {conversations}""")
_WORDS = ", ".join(f"'{k}': '{v}'" for k, v in R.FEATURE_WORDS.items())


@query(f"WITH {FEATURES.sql} SELECT features, array_to_string(list_filter(list_transform(string_split(features, ';'), lambda f: MAP {{{_WORDS}}}[f]), lambda w: w IS NOT NULL), ', ') AS label FROM features")
def feature_labels(spark, sf_dir):
    return FEATURES.df(spark, sf_dir).select("features", R.described(F.col("features")).alias("label"))


@query(f"""WITH {STRESSED.sql} SELECT CASE WHEN stress >= 0 AND length(regexp_replace(lower(form), '[^аеёиоуыэюя]', '', 'g')) > 1 AND NOT contains(lower(form), 'ё') THEN left(form, stress + 1) || '́' || substr(form, stress + 2) ELSE form END AS marked,
  CASE WHEN length(printed) = length(known) AND replace(lower(known), 'ё', 'е') = replace(lower(printed), 'ё', 'е') THEN array_to_string(list_transform(list_zip(string_split(printed, ''), string_split(known, '')),
    lambda p: CASE WHEN lower(p[2]) = 'ё' AND p[1] = 'е' THEN 'ё' WHEN lower(p[2]) = 'ё' AND p[1] = 'Е' THEN 'Ё' ELSE p[1] END), '') ELSE printed END AS shown FROM stressed""")
def stress_and_yo(spark, sf_dir):
    return STRESSED.df(spark, sf_dir).select(R.with_stress_mark(F.col("form"), F.col("stress")).alias("marked"), R.with_yo(F.col("printed"), F.col("known")).alias("shown"))


@query(f"""WITH {VARIANTS.sql}, h AS (SELECT work, min(i) AS hit FROM variants WHERE regexp_matches(text, '^Стр\\. \\d+, строка') GROUP BY 1),
c AS (SELECT h.work, coalesce((SELECT max(i) FROM variants v WHERE v.work = h.work AND kind = 'heading' AND i <= hit), hit) AS cut FROM h) SELECT v.* FROM variants v LEFT JOIN c USING (work) WHERE cut IS NULL OR i < cut""")
def variant_cut(spark, sf_dir):
    return R.without_apparatus(VARIANTS.df(spark, sf_dir), ["work"])
