"""Queries over a small authored lexicon, written once as rows for Spark and as VALUES for SQL, and over the corpus vocabulary."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import lexicon as X
from ..operators import segment as S
from .corpus import _CYR_SQL, _docs, _q, read, sql_loose, sql_tokens

Q: dict = {}
SQL: dict = {}


def query(sql):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def lit(v) -> str:
    return "NULL" if v is None else _q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)


class Fixture:
    """Rows as a DataFrame and as a SQL table."""

    def __init__(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, rows
        cols = [c.split() for c in schema.split(", ")]
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
        body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
        self.sql = f"{name} AS (SELECT {', '.join(f'CAST({c} AS {kinds[t]}) AS {c}' for c, t in cols)} FROM (VALUES {body}) v({', '.join(c for c, _ in cols)}))"

    def df(self, spark, sf_dir=None):
        return spark.createDataFrame(self.rows, self.schema)


_LATER_WORDS = f"(WITH {sql_tokens(_CYR_SQL)} SELECT DISTINCT lower(surface) AS w FROM tok WHERE kind = 'word' AND regexp_matches(surface, '^[а-яА-Я]{{4,}}$'))"


def vocabulary(spark, sf_dir):
    """Distinct words w of four letters or more of `documents`, projected onto Cyrillic and lower-cased."""
    words = S.surface_counts(_docs(spark, sf_dir, True), []).where("kind = 'word'")
    return words.where(F.col("surface").rlike("^[а-яА-Я]{4,}$")).select(F.lower("surface").alias("w")).distinct()


class Projected:
    """Rows of given tables in an operator's own shape: one SELECT, tables in braces, that Spark and DuckDB read alike, and
    some authored rows beside them. {words} stands for the vocabulary of `documents`."""

    def __init__(self, name: str, schema: str, select: str, extra: list[tuple] | None = None) -> None:
        self.name, self.select, self.schema, self.extra = name, select, schema, extra or []
        self.cols = [c.split() for c in schema.split(", ")]
        tables = {t: _LATER_WORDS if t == "words" else t for t in self.tables()}
        kinds = {"string": "VARCHAR", "long": "BIGINT"}
        typed = f" UNION ALL SELECT {self._cast(kinds)} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in self.extra)}) v({', '.join(c for c, _ in self.cols)})" if extra else ""
        self.sql = f"{name} AS (SELECT {self._cast(kinds)} FROM ({select.format(**tables)}){typed})"

    def tables(self) -> set[str]:
        return {f for _, f, _, _ in string.Formatter().parse(self.select) if f}

    def _cast(self, names: dict[str, str]) -> str:
        return ", ".join(f"CAST({c} AS {names.get(t, t)}) AS {c}" for c, t in self.cols)

    def df(self, spark, sf_dir):
        tables = {t: vocabulary(spark, sf_dir) if t == "words" else read(spark, sf_dir, t) for t in self.tables()}
        rows = spark.sql(f"SELECT {self._cast({'long': 'bigint'})} FROM ({self.select})", **tables)
        return rows.unionByName(spark.createDataFrame(self.extra, self.schema)) if self.extra else rows


#: Parts' names in Cyrillic letters, and a vocabulary word's first letters as numbers, for arithmetic that spreads over all cases.
NAME = f"translate(p_name, {_q(T.LATIN_52)}, {_q(T.CYRILLIC_52)})"
L1, L2, L3 = (f"instr({_q(T.CYRILLIC_52)}, substr(w, {i}, 1))" for i in (1, 2, 3))
PICK = lambda words, by: f"split_part({_q(words)}, ' ', CAST(1 + ({by}) % {len(words.split(' '))} AS INT))"
DIGIT = lambda c, i: f"CAST(substr(lpad(CAST({c} AS STRING), 6, '0'), {7 - i}, 1) AS INT)"


WORDS = Projected("words", "w string", f"SELECT CASE {L1} % 6 WHEN 0 THEN replace(w, 'е', 'ѣ') || 'ъ' WHEN 1 THEN replace(w, 'о', 'ò') WHEN 2 THEN replace(w, 'е', 'ё') WHEN 3 THEN replace(upper(w), 'И', 'І') WHEN 4 THEN replace(w, 'а', 'á') ELSE w END AS w FROM {{words}} v", [(w,) for w in ("Ёлка", "чтò", "бо́льшая", "миръ", "ѳеатръ", "исторія", "вѣра", "объ", "подъѣздъ", "И’мя", "слово", "ъ", "хлѣбъ", "сто́йте", "Свѣтъ", "кот")])
ACCENTED = Projected("accented", "form string", f"SELECT substr(w, 1, CAST({L1} % 7 AS INT)) || chr(39) || substr(w, CAST({L1} % 7 + 1 AS INT)) AS form FROM {{words}} v", [("молоко'",), ("до'м",), ("город",), ("за'мок",), ("стол'",), ("а'",)])
ROMANS = Projected("romans", "s string", f"SELECT DISTINCT upper({PICK(' c cc ccc cd d dc dcc dccc cm', DIGIT('o_orderkey', 3))} || {PICK(' x xx xxx xl l lx lxx lxxx xc', DIGIT('o_orderkey', 2))} || {PICK(' i ii iii iv v vi vii viii ix', DIGIT('o_orderkey', 1))}) || CASE o_orderkey % 5 WHEN 0 THEN '.' WHEN 1 THEN ' ' WHEN 2 THEN 'q' ELSE '' END AS s FROM {{orders}}", [(s,) for s in ("I", "iv", "IX.", "XL II", "MCMXC", "abc", "", "IIX", "D", "XIV.")])
CHAPTERS = Projected("chapters", "work string, idx int, title string", f"SELECT 'c' || CAST(conv_id AS STRING) AS work, turn AS idx, CASE WHEN conv_id % 2 = 0 THEN 'CHAPTER ' ELSE '' END || {PICK('I II III IV V II VI Preface I VII', 'turn + conv_id % 4')} AS title FROM {{conversations}}", [(w, i, t) for w, ts in {"a": ["CHAPTER I", "II.", "III", "I", "II"], "b": ["I", "I", "II"], "c": ["Preface", "CHAPTER V", "IV", "X"]}.items() for i, t in enumerate(ts)])
NOUNS = Projected("nouns", "lexeme_id string, lemma string, sg_nom string, sg_gen string, sg_dat string, pl_nom string", f"SELECT 'noun:' || w AS lexeme_id, w AS lemma, CASE WHEN {L1} % 9 <> 0 THEN substr(w, 1, 2) || chr(39) || substr(w, 3) END AS sg_nom, CASE WHEN {L1} % 3 = 0 THEN w || 'а' || chr(39) || ', ' || w || 'у' WHEN {L1} % 9 <> 1 THEN w || 'а' || chr(39) ELSE ' ' END AS sg_gen, CASE WHEN {L2} % 4 <> 0 THEN w || 'у' END AS sg_dat, CASE WHEN {L2} % 3 <> 0 THEN w || 'ы' ELSE '' END AS pl_nom FROM {{words}} v", [
    ("noun:кот", "кот", "ко'т", "кота'", "коту'", "коты'"), ("noun:дом", "дом", "до'м", "до'ма", "до'му", "дома'"),
    ("noun:замок", "замок", "за'мок, замо'к", "за'мка", "за'мку", "за'мки"), ("noun:кофе", "кофе", "ко'фе", "", None, " "), ("noun:пальто", "пальто", None, None, None, None),
])
CODES = {"sg_nom": "n:sg:nom", "sg_gen": "n:sg:gen", "sg_dat": "n:sg:dat", "pl_nom": "n:pl:nom"}
LEXEMES = Projected("lexemes", "src int, lexeme_id string, lemma string, pos string, partner string", f"SELECT p_partkey + 100 AS src, {PICK('verb noun adjective', 'p_size')} || ':' || CAST(p_partkey AS STRING) AS lexeme_id, CASE WHEN p_partkey % 2 = 0 THEN replace({NAME}, 'е', 'ё') ELSE {NAME} END AS lemma, {PICK('verb noun adjective', 'p_size')} AS pos, CASE WHEN p_partkey % 3 <> 0 THEN replace({NAME}, 'цолд', 'хот') END AS partner FROM {{part}}", [
    (1, "verb:читать", "читать", "verb", "прочитать"), (2, "verb:прочитать", "прочитать", "verb", "читать"), (3, "verb:думать", "думать", "verb", None), (4, "verb:вернуться", "вернуться", "verb", "возвращаться"),
    (5, "adjective:новый", "новый", "adjective", None), (6, "adjective:синий", "синий", "adjective", None), (7, "noun:ёлка", "ёлка", "noun", None), (8, "verb:говорить", "говорить", "verb", "сказать"),
    (9, "verb:прочитать#2", "прочитать", "verb", None), (10, "adverb:тихо", "тихо", "adverb", None), (11, "verb:сделать", "сделать", "verb", "делать"),
])
FREQ = Projected("freq", "word string, rank int", f"SELECT {NAME} AS word, p_size * 7 + p_partkey AS rank FROM {{part}}", [("читать", 5), ("елка", 9), ("думать", 3), ("думать", 8), ("новый", 1), ("ёж", 4)])
OVERRIDES = Projected("overrides", "lexeme_id string, pos string, partner string, drop boolean", f"SELECT {PICK('verb noun adjective', 'p_size')} || ':' || CAST(p_partkey AS STRING) AS lexeme_id, CASE WHEN p_partkey % 4 = 0 THEN 'particle' END AS pos, CASE WHEN p_partkey % 6 = 1 THEN 'x' END AS partner, CASE WHEN p_partkey % 5 = 0 THEN true WHEN p_partkey % 5 = 1 THEN false END AS drop FROM {{part}}", [("verb:думать", None, "подумать", None), ("adverb:тихо", "particle", None, False), ("verb:прочитать#2", None, None, True), ("noun:нет", None, None, True)])
SURFACES = Fixture("surfaces", "surface string", [(w,) for w in ("вернувшись", "Думая", "говоря", "новее", "синей", "читал", "сделав", "прочитали", "ново", "странно", "думала", "лампа", "ала")])
GUESSES = Fixture("guesses", "w string", [(w,) for w in ("радостью", "радости", "радость", "петь", "нести", "новыми", "странного", "быстро", "море", "лампа", "стол", "Иван", "ость")])
SEGMENTS = Projected("segs", "surface string, lemma string, pos string, reflexive boolean", f"SELECT CASE WHEN {L1} % 5 = 0 THEN substr(w, 1, 1) ELSE substr(w, 1, length(w) - 2) END || {PICK('ами ого лся лась ешь ы', L2)} AS surface, CASE WHEN {L1} % 3 = 0 THEN w || 'ться' WHEN {L1} % 3 = 1 THEN w || 'ый' ELSE w END AS lemma, {PICK('verb adjective noun', L1)} AS pos, {L2} % 2 = 0 AND {L1} % 3 = 0 AS reflexive FROM {{words}} v", [
    ("читаю", "читать", "verb", False), ("вернулась", "вернуться", "verb", True), ("шёл", "идти", "verb", False), ("новыми", "новый", "adjective", False), ("кота", "кот", "noun", False), ("дома", "дом", "noun", False), ("люди", "человек", "noun", False),
])
CANDS = Projected("cands", "token_id int, lexeme_id string, confidence double, source_order int, rank int, chosen boolean", "SELECT l_orderkey + 10 AS token_id, 'x' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS lexeme_id, CAST(l_suppkey % 3 AS DOUBLE) / 2 AS confidence, l_linenumber % 3 AS source_order, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END AS rank, l_linenumber = 2 AS chosen FROM {lineitem}", [
    (1, "a", 1.0, 1, 7, False), (1, "b", 1.0, 1, 3, False), (1, "c", 1.0, 0, None, False), (1, "d", 0.5, 2, 1, True), (1, "e", 0.9, 2, None, False), (2, "f", 0.4, 0, None, True), (2, "g", 0.4, 0, 2, False),
])
EDGES = Projected("edges", "sentence_id int, dependent int, head int, relation string, priority int, ord int", "SELECT l_orderkey + 10 AS sentence_id, l_linenumber % 4 AS dependent, l_suppkey AS head, CASE l_suppkey % 3 WHEN 0 THEN 'subject' WHEN 1 THEN 'object' ELSE 'modifier' END AS relation, l_partkey % 3 AS priority, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS ord FROM {lineitem}", [
    (1, 2, None, "predicate", 0, 0), (1, 2, 5, "modifier", 8, 1), (1, 0, 2, "subject", 1, 0), (1, 3, 4, "modifier", 7, 2), (1, 3, 2, "object", 2, 9), (2, 1, 0, "apposition", 7, 1), (2, 1, 0, "modifier", 7, 0),
])
AGREE = Projected("agree", "id int, s_gender string, v_gender string, s_number string, v_number string, s_person int, v_person int", f"SELECT l_orderkey * 10 + l_linenumber + 100 AS id, CASE WHEN l_partkey % 5 <> 0 THEN {PICK('m f n', 'l_partkey')} END AS s_gender, CASE WHEN l_suppkey % 3 <> 0 THEN {PICK('m f n', 'l_partkey * 3 + l_suppkey')} END AS v_gender, CASE WHEN l_linenumber % 3 <> 0 THEN {PICK('sg pl', 'l_partkey')} END AS s_number, CASE WHEN l_linenumber % 4 <> 0 THEN {PICK('sg pl', 'l_suppkey + l_partkey')} END AS v_number, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 3 + 1 END AS s_person, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey % 3 + 1 END AS v_person FROM {{lineitem}}", [
    (1, "m", "m", "sg", "sg", None, None), (2, "f", "m", "sg", "sg", None, None), (3, None, "m", None, "sg", None, None), (4, None, None, "pl", "pl", 3, 3), (5, None, None, "sg", "sg", 1, 3),
])
#: Prepositions and the cases they govern, in order.
PREPOSITIONS = Fixture("preps", "form string, case_order int, governed string", [
    (f, i, c) for f, cs in {
        "в": "prep acc", "во": "prep acc", "на": "prep acc", "с": "inst gen", "со": "inst gen", "за": "inst acc", "под": "inst acc", "между": "inst gen", "у": "gen", "для": "gen", "без": "gen",
        "из": "gen", "из-за": "gen", "из-под": "gen", "от": "gen", "до": "gen", "к": "dat", "ко": "dat", "о": "prep", "об": "prep", "обо": "prep", "про": "acc", "через": "acc", "чрез": "acc", "при": "prep", "над": "inst", "перед": "inst",
    }.items() for i, c in enumerate(cs.split())
])
PHRASES = Fixture("phrases", "sentence_id int, i int, w string, pos string, readings string", [
    (1, 0, "в", "preposition", ""), (1, 1, "доме", "noun", "nom,prep"), (2, 0, "к", "preposition", ""), (2, 1, "старому", "adjective", "dat"), (2, 2, "другу", "noun", "dat,acc"), (3, 0, "с", "preposition", ""),
    (3, 1, "крыши", "noun", "nom,gen"), (4, 0, "для", "preposition", ""), (4, 1, "и", "conjunction", ""), (5, 0, "у", "preposition", ""), (5, 1, "кот", "noun", "nom"),
])


@query(f"WITH {WORDS.sql} SELECT w, {sql_loose('w')} AS key FROM words")
def loose_key_fixture(spark, sf_dir):
    return WORDS.df(spark, sf_dir).select("w", T.loose_key(F.col("w")).alias("key"))


_DEC = "replace(replace(replace(replace(w, 'ò', 'о' || chr(768)), 'ó', 'о' || chr(769)), 'á', 'а' || chr(769)), 'ѐ', 'е' || chr(768))"


@query(f"WITH {WORDS.sql}, d AS (SELECT w, {_DEC} AS d FROM words) SELECT w, CAST(CASE WHEN regexp_matches(d, '[\\x{{0300}}\\x{{0301}}]') THEN length(regexp_extract(d, '^([^\\x{{0300}}\\x{{0301}}]*)', 1)) - 1 ELSE -1 END AS INTEGER) AS stress FROM d")
def source_stress_fixture(spark, sf_dir):
    return WORDS.df(spark, sf_dir).select("w", T.source_stress(F.col("w")).alias("stress"))


@query(f"WITH {ACCENTED.sql} SELECT form, replace(form, '''', '') AS bare, CAST(CASE WHEN strpos(form, '''') > 1 THEN strpos(form, '''') - 2 ELSE -1 END AS INTEGER) AS stress FROM accented")
def accent_split_fixture(spark, sf_dir):
    return ACCENTED.df(spark, sf_dir).withColumn("a", T.split_accent(F.col("form"))).select("form", F.col("a.form").alias("bare"), F.col("a.stress").alias("stress"))


@query(f"""WITH {ROMANS.sql}, c AS (SELECT s, lower(regexp_replace(s, '[.\\s]', '', 'g')) AS r FROM romans),
d AS (SELECT s, r, unnest(string_split(r, '')) AS ch, generate_subscripts(string_split(r, ''), 1) AS i FROM c WHERE regexp_matches(r, '^[ivxlcdm]+$')),
v AS (SELECT s, i, CASE ch WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END AS v FROM d),
t AS (SELECT s, CASE WHEN v < lead(v) OVER (PARTITION BY s ORDER BY i) THEN -v ELSE v END AS v FROM v)
SELECT c.s, CAST((SELECT sum(v) FROM t WHERE t.s = c.s) AS INTEGER) AS n FROM c""")
def roman_numeral_fixture(spark, sf_dir):
    return ROMANS.df(spark, sf_dir).select("s", T.roman_to_int(F.col("s")).alias("n"))


@query(f"""WITH {CHAPTERS.sql}, n AS (SELECT *, CASE upper(regexp_replace(replace(title, '.', ''), '^CHAPTER +', '')) {' '.join(f"WHEN '{r}' THEN {i}" for i, r in enumerate('I II III IV V VI VII VIII IX X'.split(), 1))} END AS num FROM chapters),
t AS (SELECT *, max(num) OVER (PARTITION BY work ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM n) SELECT work, idx, title FROM t QUALIFY NOT coalesce(max(CASE WHEN num <= top AND top >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY idx ROWS UNBOUNDED PRECEDING) = 1, false)""")
def bundled_work_cut(spark, sf_dir):
    return C.restart_cut(CHAPTERS.df(spark, sf_dir), "work")


_CELLS = f"cells AS (SELECT * FROM (UNPIVOT (SELECT lexeme_id, sg_nom, sg_gen, sg_dat, pl_nom FROM nouns) ON sg_nom, sg_gen, sg_dat, pl_nom INTO NAME slot VALUE cell) WHERE trim(cell) <> '')"


def _cells(spark, sf_dir):
    return X.paradigm_cells(NOUNS.df(spark, sf_dir), ["lexeme_id"], list(CODES))


@query(f"WITH {NOUNS.sql}, {_CELLS} SELECT * FROM cells")
def paradigm_unpivot(spark, sf_dir):
    return _cells(spark, sf_dir)


_INDEX = f"""alts AS (SELECT lexeme_id, CASE slot {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items())} END AS code, trim(unnest(string_split(cell, ','))) AS form FROM cells),
idx AS (SELECT DISTINCT {sql_loose("replace(form, '''', '')")} AS key, lexeme_id, code, CAST(CASE WHEN strpos(form, '''') > 1 THEN strpos(form, '''') - 2 ELSE -1 END AS INTEGER) AS stress FROM alts)"""


@query(f"WITH {NOUNS.sql}, {_CELLS}, {_INDEX} SELECT * FROM idx UNION ALL SELECT {sql_loose('lemma')}, lexeme_id, 'x', -1 FROM nouns WHERE lexeme_id NOT IN (SELECT lexeme_id FROM idx)")
def form_index(spark, sf_dir):
    return X.with_citation_forms(X.form_index(_cells(spark, sf_dir), CODES), NOUNS.df(spark, sf_dir))


@query(f"WITH {NOUNS.sql}, {_CELLS}, c AS (SELECT lexeme_id, min(lower(cell)) AS lo, max(lower(cell)) AS hi FROM cells GROUP BY 1) SELECT lexeme_id, substr(lo, 1, (SELECT max(n) FROM range(0, 40) r(n) WHERE n <= least(length(lo), length(hi)) AND substr(lo, 1, n) = substr(hi, 1, n))) AS stem FROM c")
def paradigm_stem_lcp(spark, sf_dir):
    return X.stems(_cells(spark, sf_dir))


@query(f"WITH {LEXEMES.sql}, {FREQ.sql}, f AS (SELECT word, min(rank) AS rank FROM freq GROUP BY 1) SELECT lexeme_id, coalesce(a.rank, b.rank) AS rank FROM lexemes LEFT JOIN f a ON a.word = lemma LEFT JOIN f b ON b.word = replace(lemma, 'ё', 'е')")
def lexeme_rank_fallback(spark, sf_dir):
    return X.ranks(LEXEMES.df(spark, sf_dir), FREQ.df(spark, sf_dir)).select("lexeme_id", "rank")


@query(f"WITH {LEXEMES.sql} SELECT l.lexeme_id, (SELECT arg_min(p.lexeme_id, p.src) FROM lexemes p WHERE p.pos = l.pos AND p.lemma = l.partner) AS partner_id FROM lexemes l")
def lexeme_partner(spark, sf_dir):
    return X.partners(LEXEMES.df(spark, sf_dir)).select("lexeme_id", "partner_id")


@query(f"WITH {LEXEMES.sql}, {OVERRIDES.sql} SELECT l.lexeme_id, coalesce(o.pos, l.pos) AS pos, coalesce(o.partner, l.partner) AS partner FROM lexemes l LEFT JOIN overrides o USING (lexeme_id) WHERE NOT coalesce(o.drop, false)")
def lexicon_overrides(spark, sf_dir):
    return X.apply_overrides(LEXEMES.df(spark, sf_dir), OVERRIDES.df(spark, sf_dir), ["pos", "partner"]).select("lexeme_id", "pos", "partner")


@query(f"""WITH {SEGMENTS.sql}, b AS (SELECT surface, CASE WHEN reflexive THEN regexp_extract(surface, '(с[яь])$', 1) ELSE '' END AS postfix, CASE pos WHEN 'verb' THEN regexp_replace(regexp_replace(lemma, 'с[яь]$', ''), '(ть|ти|чь)$', '') WHEN 'adjective' THEN regexp_replace(lemma, '(ый|ий|ой)$', '') ELSE lemma END AS base FROM segs),
c AS (SELECT *, substr(lower(surface), 1, length(surface) - length(postfix)) AS body FROM b),
d AS (SELECT *, (SELECT max(n) FROM range(0, 40) r(n) WHERE n <= least(length(body), length(base)) AND substr(body, 1, n) = substr(base, 1, n)) AS n FROM c)
SELECT surface, CASE WHEN n >= 2 THEN substr(body, 1, n) ELSE '' END AS stem, CASE WHEN n >= 2 THEN substr(body, n + 1) ELSE body END AS ending, postfix FROM d""")
def segment_forms(spark, sf_dir):
    d = SEGMENTS.df(spark, sf_dir).withColumn("s", T.segment_form(F.col("surface"), T.lemma_base(F.col("lemma"), F.col("pos")), F.col("reflexive")))
    return d.select("surface", "s.stem", "s.ending", "s.postfix")


_RULES = Fixture("rules", "rule string, priority int, cut string, put string, base_order int, pos string, confidence double", [(n, p, c, b, k, pos, f) for n, p, c, bs, pos, f in X.BASE_RULES for k, b in enumerate(bs)])


@query(f"""WITH {SURFACES.sql}, {LEXEMES.sql}, {_RULES.sql}, m AS (SELECT surface, rule, priority, base_order, r.pos, confidence, left({sql_loose('surface')}, length(surface) - length(cut)) || put AS base FROM surfaces JOIN rules r ON ends_with({sql_loose('surface')}, cut) AND length(surface) > length(cut) + 1),
h AS (SELECT m.*, l.lexeme_id, l.lemma, row_number() OVER (PARTITION BY surface ORDER BY priority, base_order, lexeme_id) AS rn FROM m JOIN lexemes l ON {sql_loose('l.lemma')} = m.base AND l.pos = m.pos)
SELECT surface, rule, lexeme_id, lemma, pos, confidence FROM h WHERE rn = 1""")
def rule_candidates(spark, sf_dir):
    lex = LEXEMES.df(spark, sf_dir)
    index = X.with_citation_forms(X.form_index(_cells(spark, sf_dir), CODES), lex).select("key", "lexeme_id")
    return X.rule_readings(SURFACES.df(spark, sf_dir), index, lex)


def _sql_guess(w: str) -> str:
    out = f"CASE WHEN ends_with(lower({w}), 'остью') AND length({w}) > 5 THEN 'noun|' || left({w}, length({w}) - 5) || 'ость|0.55' WHEN ends_with(lower({w}), 'ости') AND length({w}) > 4 THEN 'noun|' || left({w}, length({w}) - 4) || 'ость|0.55'"
    out += f" WHEN ends_with(lower({w}), 'ость') AND length({w}) > 4 THEN 'noun|' || {w} || '|0.55' WHEN ends_with(lower({w}), 'ть') OR regexp_matches(lower({w}), '[сзй]ти$') THEN 'verb|' || {w} || '|0.5'"
    for e, *_ in X.ADJECTIVE_ENDINGS:
        out += f" WHEN ends_with(lower({w}), '{e}') AND length({w}) > {len(e) + 1} THEN 'adjective|' || lower(left({w}, length({w}) - {len(e)})) || 'ый|0.5'"
    return out + f" WHEN ends_with(lower({w}), 'о') OR ends_with(lower({w}), 'е') THEN 'adverb|' || left({w}, length({w}) - 1) || 'ый|0.4' ELSE 'noun|' || {w} || '|0.4' END"


@query(f"""WITH {sql_tokens(_CYR_SQL)}, {GUESSES.sql}, v AS (SELECT DISTINCT {sql_loose('surface')} AS w FROM tok WHERE kind = 'word' UNION SELECT w FROM guesses)
SELECT w, split_part(g, '|', 1) AS pos, split_part(g, '|', 2) AS lemma, CAST(split_part(g, '|', 3) AS DOUBLE) AS confidence FROM (SELECT w, {_sql_guess('w')} AS g FROM v)""")
def ending_guess(spark, sf_dir):
    words = S.surface_counts(_docs(spark, sf_dir, True), []).where("kind = 'word'").select(T.loose_key(F.col("surface")).alias("w")).union(GUESSES.df(spark, sf_dir)).distinct()
    return words.select("w", X.ending_guess(F.col("w")).alias("g")).select("w", "g.pos", "g.lemma", "g.confidence")


@query(f"""WITH {CANDS.sql}, r AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY confidence DESC, source_order, rank NULLS LAST, lexeme_id) - 1 AS p FROM cands)
SELECT token_id, lexeme_id, CAST(CASE WHEN chosen THEN 0 ELSE p + 1 END AS INTEGER) AS rank_no FROM r WHERE p < 3 OR chosen""")
def candidate_ranking(spark, sf_dir):
    return X.rank_candidates(CANDS.df(spark, sf_dir)).select("token_id", "lexeme_id", "rank_no")


@query(f"WITH {EDGES.sql} SELECT sentence_id, dependent, head, relation FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id, dependent ORDER BY priority, ord) AS rn FROM edges) WHERE rn = 1")
def dependency_priority(spark, sf_dir):
    return X.dependency_edges(EDGES.df(spark, sf_dir)).select("sentence_id", "dependent", "head", "relation")


@query(f"""WITH {AGREE.sql} SELECT id, CASE WHEN s_gender <> v_gender OR s_number <> v_number OR s_person <> v_person THEN false WHEN s_gender = v_gender OR s_number = v_number OR s_person = v_person THEN true END AS matches FROM agree""")
def agreement_three_valued(spark, sf_dir):
    return X.agreement(AGREE.df(spark, sf_dir)).select("id", "matches")


@query(f"""WITH {PHRASES.sql}, {PREPOSITIONS.sql}, h AS (SELECT p.sentence_id, p.w AS prep, (SELECT min(q.i) FROM phrases q WHERE q.sentence_id = p.sentence_id AND q.i > p.i AND q.pos = 'noun'
    AND NOT EXISTS (SELECT 1 FROM phrases x WHERE x.sentence_id = p.sentence_id AND x.i > p.i AND x.i < q.i AND x.pos NOT IN ('adjective', 'numeral', 'pronoun'))) AS head FROM phrases p WHERE p.pos = 'preposition')
SELECT h.sentence_id, h.prep, n.w AS head, arg_min(g.governed, g.case_order) AS governed FROM h JOIN phrases n ON n.sentence_id = h.sentence_id AND n.i = h.head JOIN preps g ON g.form = h.prep AND list_contains(string_split(n.readings, ','), g.governed) GROUP BY 1, 2, 3""")
def preposition_government(spark, sf_dir):
    from ..operators.syntax import preposition_heads

    return preposition_heads(PHRASES.df(spark, sf_dir), PREPOSITIONS.df(spark, sf_dir))
