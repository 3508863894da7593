"""Queries that build the lexicon: verbs, adjectives, other words, declensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as D
from .lexicon import L1, L2, L3, NAME, PICK, Fixture, Projected

Q: dict = {}
SQL: dict = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


VERBS = Projected("verbs", "bare string, accented string, translations string, aspect string, imperative_sg string, past_m string, past_pl string, presfut_sg1 string, presfut_pl3 string", f"SELECT w || {PICK('ать ить ться', L1)} AS bare, CASE WHEN {L1} % 4 <> 0 THEN substr(w, 1, 3) || chr(39) || substr(w, 4) || {PICK('ать ить ться', L1)} END AS accented, {PICK('one;two one;;three  one', L2)} AS translations, {PICK('perfective imperfective biaspectual other', L2)} AS aspect, CASE WHEN {L1} % 2 = 0 THEN w || 'ай' END AS imperative_sg, w || 'ал' AS past_m, CASE {L1} % 3 WHEN 0 THEN ' ' WHEN 1 THEN w || 'али' END AS past_pl, CASE WHEN {L3} % 2 = 0 THEN w || 'аю' END AS presfut_sg1, CASE WHEN {L3} % 3 = 0 THEN w || 'ают' ELSE '' END AS presfut_pl3 FROM {{words}} v", [
    ("читать", "чита'ть", "read; peruse", "imperfective", "чита'й", "чита'л", "чита'ли", "чита'ю", "чита'ют"), ("вернуться", "верну'ться", "return", "perfective", None, "верну'лся", " ", "верну'сь", None), ("мочь", None, "", "other", "", None, None, "могу'", "мо'гут"),
])
ADJECTIVES = Projected("adjs", "bare string, accented string, translations string, decl_m_nom string, decl_f_gen string, short_m string, comparative string", f"SELECT w || 'ый' AS bare, CASE WHEN {L1} % 4 <> 0 THEN substr(w, 1, 2) || chr(39) || substr(w, 3) || 'ый' END AS accented, {PICK('new;old red  ', L2)} AS translations, CASE WHEN {L1} % 2 = 0 THEN w || 'ый' END AS decl_m_nom, CASE WHEN {L2} % 2 = 0 THEN w || 'ой' END AS decl_f_gen, CASE WHEN {L3} % 2 = 0 THEN w END AS short_m, CASE WHEN {L3} % 3 = 0 THEN w || 'ее' END AS comparative FROM {{words}} v", [
    ("новый", "но'вый", "new", "но'вый", "но'вой", "нов", "нове'е"), ("который", None, "which; that", "кото'рый", None, None, None), ("беж", None, None, None, None, None, None),
])
PRONOUNS = Projected("prons", "lemma string", f"SELECT w || 'ый' AS lemma FROM {{words}} v WHERE {L1} = {L2}", [("который",), ("такой",)])
OTHERS = Projected("others", "bare string, accented string, translations string", f"SELECT w || {PICK('о е т', L1)} AS bare, CAST(NULL AS STRING) AS accented, 'x; y' AS translations FROM {{words}} v", [(w, None, "x; y") for w in ("и", "в", "надо", "быстро", "вдруг", "меня", "то", "да", "пять", "по-русски")])
CLOSED = Projected("closed", "form string, pos string, ord int", f"SELECT w || 'о' AS form, {PICK('preposition conjunction numeral particle', L2)} AS pos, {L2} % 4 AS ord FROM {{words}} v WHERE {L1} % 3 = 0 AND {L3} % 4 = 0", [("в", "preposition", 1), ("и", "conjunction", 2), ("да", "conjunction", 2), ("пять", "numeral", 3), ("надо", "predicative", 4), ("да", "particle", 5), ("то", "particle", 5)])
SKIPPED = Projected("skipped", "form string", f"SELECT w || {PICK('о е т', L1)} AS form FROM {{words}} v WHERE {L2} = {L3}", [("меня",), ("тебя",)])
STEMS = Projected("stems", "stem string, declension string, animate boolean", f"SELECT w AS stem, {PICK('hard stressed velar hard', L1)} AS declension, {L2} % 2 = 0 AS animate FROM {{words}} v", [("нов", "hard", False), ("больш", "stressed", True), ("русск", "velar", False), ("мо", "мой", True), ("наш", "наш", False), ("мамин", "мамин", False)])
_ENDINGS = Fixture("endings", D.ENDING_SCHEMA, D.ending_rows())
_SENSES = "list_filter(list_transform(string_split(coalesce(translations, ''), ';'), lambda s: trim(s)), lambda s: s <> '')"


@query(f"WITH {VERBS.sql} SELECT 'verb:' || bare AS lexeme_id, bare AS lemma, coalesce(accented, bare) AS acc, coalesce({_SENSES}[1], bare) AS gloss, CAST(len({_SENSES}) AS INTEGER) AS senses, CASE WHEN aspect IN ('imperfective', 'perfective', 'biaspectual') THEN aspect END AS aspect, regexp_matches(bare, 'с[яь]$') AS reflexive FROM verbs")
def verb_lexemes(spark, sf_dir):
    lexemes, _ = D.verbs(VERBS.df(spark, sf_dir))
    return lexemes.select("lexeme_id", "lemma", "acc", "gloss", F.size("senses").alias("senses"), "aspect", "reflexive")


@query(f"WITH {VERBS.sql}, v AS (SELECT 'verb:' || bare AS lexeme_id, coalesce(accented, bare) AS infinitive, * FROM verbs) SELECT lexeme_id, slot, cell FROM (UNPIVOT (SELECT lexeme_id, infinitive, imperative_sg, past_m, past_pl, presfut_sg1, presfut_pl3 FROM v) ON infinitive, imperative_sg, past_m, past_pl, presfut_sg1, presfut_pl3 INTO NAME slot VALUE cell) WHERE trim(cell) <> ''")
def verb_cells(spark, sf_dir):
    return D.verbs(VERBS.df(spark, sf_dir))[1]


_ADJ = f"a AS (SELECT *, CASE WHEN bare IN (SELECT lemma FROM prons) THEN 'pronoun' ELSE 'adjective' END AS pos, {_SENSES} AS senses FROM adjs)"


@query(f"WITH {ADJECTIVES.sql}, {PRONOUNS.sql}, {_ADJ} SELECT pos || ':' || bare AS lexeme_id, pos, coalesce(senses[1], bare) AS gloss, CASE WHEN pos = 'pronoun' THEN 'determinative' END AS pronoun_type FROM a")
def adjective_lexemes(spark, sf_dir):
    return D.adjectives(ADJECTIVES.df(spark, sf_dir), PRONOUNS.df(spark, sf_dir))[0].select("lexeme_id", "pos", "gloss", "pronoun_type")


@query(f"WITH {ADJECTIVES.sql}, {PRONOUNS.sql}, {_ADJ} SELECT lexeme_id, slot, cell FROM (UNPIVOT (SELECT pos || ':' || bare AS lexeme_id, decl_m_nom, decl_f_gen, short_m, comparative FROM a) ON decl_m_nom, decl_f_gen, short_m, comparative INTO NAME slot VALUE cell)")
def adjective_cells(spark, sf_dir):
    return D.adjectives(ADJECTIVES.df(spark, sf_dir), PRONOUNS.df(spark, sf_dir))[1]


@query(f"WITH {OTHERS.sql}, {CLOSED.sql}, {SKIPPED.sql}, k AS (SELECT form, arg_min(pos, ord) AS known FROM closed GROUP BY 1), o AS (SELECT bare, coalesce(known, CASE WHEN regexp_matches(bare, '[оеи]$') THEN 'adverb' ELSE 'particle' END) AS pos, known IS NULL AS guessed FROM others LEFT JOIN k ON form = bare WHERE bare NOT IN (SELECT form FROM skipped)) SELECT pos || ':' || bare AS lexeme_id, pos, guessed FROM o")
def other_lexemes(spark, sf_dir):
    return D.others(OTHERS.df(spark, sf_dir), CLOSED.df(spark, sf_dir), SKIPPED.df(spark, sf_dir)).select("lexeme_id", "pos", "guessed")


@query(f"WITH {STEMS.sql}, {_ENDINGS.sql} SELECT stem, gender, case_, stem || CASE WHEN animate THEN of_animate ELSE ending END AS form FROM stems JOIN endings USING (declension)")
def declensions(spark, sf_dir):
    return D.declined(STEMS.df(spark, sf_dir))
