"""Queries of the word analyser and its generators, over an authored lexicon and over the corpus vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import generate as G
from ..operators.closed import closed_classes, closed_rows
from ..operators import segment as S
from ..operators.lexicon import ADJECTIVE_ENDINGS
from .corpus import _CYR_SQL, _docs, _q, sql_loose, sql_tokens
from .lexicon import L1, L2, L3, PICK, Fixture, Projected, lit

Q: dict = {}
SQL: dict = {}

#: Forms of a vocabulary word as a verb, an adjective or a noun, so that each generator meets bases that the lexicon knows.
MIXED = f"{L2} * 3 + {L3} + length(w)"
_FORM = (
    f"CASE {L1} % 4 WHEN 0 THEN {PICK('пере вы  ', L3)} || w || {PICK('ати ал ала ались ано ающий авшего авшийся анный атая ав авшись ая аясь ает ать', MIXED)} WHEN 1 THEN CASE WHEN {L3} % 7 = 0 THEN 'по-' || w || 'ски' ELSE w || {PICK('ою ее ей ейший ейшими ого ыми о е енький еньк', MIXED)} END "
    f"WHEN 2 THEN w || {PICK('ою ин ина иными очка очку ечка ушка остью ости', MIXED)} ELSE w || {PICK('ов ова чик ик ушкой ти ого а', MIXED)} END"
)

LEXICON = Projected("lexicon", "lexeme_id string, lemma string, pos string, aspect string, rank int", f"SELECT p || ':' || lemma AS lexeme_id, lemma, p AS pos, aspect, rank FROM (SELECT w || {PICK('ать ый а ', L1)} AS lemma, {PICK('verb adjective noun noun', L1)} AS p, CASE WHEN {L1} % 4 = 0 THEN {PICK('perfective imperfective', L2)} END AS aspect, length(w) + 100 AS rank FROM {{words}} v) x", [
    (f"{p}:{w}", w, p, a, r) for r, (p, a, ws) in enumerate([
        ("verb", "imperfective", "читать говорить думать видеть гулять писать любить вести мыть чувствовать улыбаться терпеть стелить звать"), ("verb", "perfective", "сделать сказать решить вернуться взять прочитать нести спасти велеть"),
        ("adjective", None, "новый синий большой быстрый прежний милый собачий умный русский"), ("noun", None, "мама соня дом ёлка коробка хозяйка рука сестра книга река"), ("numeral", None, "одна"),
    ]) for w in ws.split()
])
READINGS = Projected("readings", "key string, lexeme_id string, code string, features string", f"SELECT w || {PICK('ать ый а ', L1)} AS key, {PICK('verb adjective noun noun', L1)} || ':' || w || {PICK('ать ый а ', L1)} AS lexeme_id, {PICK('v:inf a:m:sg:nom n:sg:nom n:sg:nom', L1)} AS code, {PICK('verb_form=infinitive case=nom;gender=m;number=sg case=nom;number=sg case=nom;number=sg', L1)} AS features FROM {{words}} v UNION ALL SELECT w || {PICK('ают ой ой ', L1)} AS key, {PICK('verb adjective noun noun', L1)} || ':' || w || {PICK('ать ый а ', L1)} AS lexeme_id, {PICK('v:pf:pl3 a:f:sg:inst n:sg:inst n:sg:acc', L1)} AS code, {PICK('number=pl;person=3;verb_form=present-future case=inst;gender=f;number=sg case=inst;gender=f;number=sg case=acc;number=sg', L1)} AS features FROM {{words}} v", [
    *[(w.replace("ё", "е"), i, "v:inf" if p == "verb" else "a:m:sg:nom" if p == "adjective" else "n:sg:nom", G.feats(verb_form="infinitive") if p == "verb" else G.feats(case="nom", number="sg", gender="m" if p == "adjective" else None)) for i, w, p, _, _ in LEXICON.extra],
    ("рукой", "noun:рука", "n:sg:inst", G.feats(case="inst", number="sg", gender="f")), ("рекой", "noun:река", "n:sg:inst", G.feats(case="inst", number="sg", gender="f")), ("новой", "adjective:новый", "a:f:sg:inst", G.feats(case="inst", number="sg", gender="f")),
    ("новой", "adjective:новый", "a:f:sg:gen", G.feats(case="gen", number="sg", gender="f")), ("читает", "verb:читать", "v:pf:sg3", G.feats(number="sg", person="3", verb_form="present-future")),
    ("чувствуют", "verb:чувствовать", "v:pf:pl3", G.feats(number="pl", person="3", verb_form="present-future")), ("книгу", "noun:книга", "n:sg:acc", G.feats(case="acc", number="sg")), ("рукой", "noun:рука", "n:sg:inst", G.feats(case="inst", number="sg", gender="f")),
])
#: One list of surfaces for each generator, and some that several could claim.
FORMS = Projected("forms", "surface string", f"SELECT DISTINCT {_FORM} AS surface FROM {{words}} v", [(w,) for w in (
    "рукою новою рекою чужою гуляти читати видети новти по-русски по-своему по-нашему по-новгородски по-дому сказано решено велено взято знано читал читала вернулся вернулись гнул стол думало прыгнул "
    "новейший быстрейшими умнейшая прошлейший новее быстрей синей прошлее большого собачьего собачьими прежнего читающий говорящая вернувшийся сделавший спасший решенная прочитанные взятый любимый читаемое улыбающимся плывущий "
    "сделав вернувшись прочитавши упав говоря думая чувствуя улыбаясь видя лампа прочитает переписать выгулять мамин Сонин мамина сониной дядиными отцов Иванов Пушкин коробочка домик новенький сеструшка рученькой ножик "
    "ново быстро славно море дождь радостью радости радость грызть ползти странного лампою окно Кто ад а"
).split()])
CLOSED = Fixture("closed", "form string, key string, lemma string, pos string, features string", [
    ("и", "conjunction:и", "и", "conjunction", ""), ("не", "particle:не", "не", "particle", ""), ("в", "preposition:в", "в", "preposition", "case=prep"), ("в", "preposition:в", "в", "preposition", "case=acc"),
    ("он", "pronoun:он", "он", "pronoun", "case=nom;gender=m;number=sg;person=3"), ("нельзя", "predicative:нельзя", "нельзя", "predicative", ""), ("два", "numeral:два", "два", "numeral", "case=nom"), ("новой", "pronoun:новой", "новой", "pronoun", ""),
])
NAMES = Projected("names", "form string, canonical string", f"SELECT w || {PICK('ал ого ою ин', L1)} AS form, 'Ю' || w AS canonical FROM {{words}} v WHERE {L2} = {L3}", [("соня", "Софья"), ("сони", "Софья"), ("родя", "Родион"), ("соня", "Соня"), ("мамин", "Мамин")])
TEXT = Projected("texts", "surface string", f"SELECT DISTINCT CASE {L3} % 4 WHEN 0 THEN {_FORM} || {PICK('-то -ка -де -таки', L1)} WHEN 1 THEN {PICK('И он Не нельзя', L1)} WHEN 2 THEN w || {PICK('ать ый а ', L1)} ELSE {_FORM} END AS surface FROM {{words}} v", [(w,) for w in "И он не новой Соня книгу-то пришёл-таки читает-ка по-русски-то в-с два Нельзя рукой Родя мамин кто-то чтение-де СОНЯ -то".split()])


def query(sql: str | None, name: str | None = None):
    def put(f):
        Q[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def _sql_merged(a: str, b: str) -> str:
    names = f"list_transform(string_split({b}, ';'), lambda y: split_part(y, '=', 1))"
    kept = f"list_filter(string_split({a}, ';'), lambda x: x <> '' AND NOT list_contains({names}, split_part(x, '=', 1)))"
    return f"array_to_string(list_sort(list_concat({kept}, list_filter(string_split({b}, ';'), lambda x: x <> ''))), ';')"


def _sql_rules() -> str:
    cols = [c.split(" ")[0] for c in G.RULE_SCHEMA.split(", ")]
    flat = [tuple("|".join(v) if isinstance(v, list) else v for v in r) for r in G.rules()]
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in flat)
    return f"rules({', '.join(cols)}) AS (SELECT * FROM (VALUES {body}) v)"


def _sql_readings(words: str) -> str:
    """CTEs that end in `best`: the readings by rules of the table or subquery `words` (surface)."""
    ends = ", ".join(f"({lit(e)}, {lit(G.feats(case=c, gender=g, number=n))})" for e, g, n, c in ADJECTIVE_ENDINGS)
    has = lambda c: f"FROM ends WHERE ends_with({c}, ends.e) AND length({c}) > length(ends.e) + 1"
    none = "CAST(NULL AS VARCHAR)"
    return f"""{_sql_rules()}, ends(e, given) AS (VALUES {ends}),
w AS (SELECT DISTINCT surface, lower(surface) AS w FROM {words}),
c AS (SELECT surface, w, (SELECT e {has('w')}) AS e, CASE WHEN ends_with(w, 'ся') AND length(w) > 4 THEN left(w, length(w) - 2) END AS core FROM w),
parts AS (SELECT surface, w, 'word' AS part, w AS body, '' AS given FROM c
  UNION ALL SELECT surface, w, 'adjective', left(w, length(w) - length(ends.e)), given FROM c JOIN ends ON ends.e = c.e
  UNION ALL SELECT surface, w, 'reflexive', left(core, length(core) - length(ends.e)), given FROM c JOIN ends ON ends_with(core, ends.e) AND length(core) > length(ends.e) + 1
  UNION ALL SELECT surface, w, 'stripped', CASE WHEN length(w) > 2 THEN regexp_replace(w, '[ауыоеийя]$', '') ELSE w END, '' FROM c WHERE e IS NULL
  UNION ALL SELECT surface, w, 'noun', regexp_replace(w, '{G.NOUN_END}', ''), '' FROM c WHERE regexp_matches(w, '.{G.NOUN_END}')),
cut AS (SELECT p.surface, p.given, left(body, length(body) - length(suffix)) AS stem, r.* FROM parts p JOIN rules r ON r.part = p.part AND ends_with(body, suffix)),
made AS (SELECT * FROM cut WHERE length(stem) >= least_stem AND (stem_like = '' OR regexp_matches(stem, stem_like))),
known AS (SELECT r.key, r.lexeme_id, r.code, l.lemma, l.pos, l.aspect FROM readings r JOIN lexicon l USING (lexeme_id)),
bases AS (SELECT *, stem || put AS base FROM (SELECT *, unnest(string_split(puts, '|')) AS put, generate_subscripts(string_split(puts, '|'), 1) AS put_order FROM made WHERE generator <> 'ending')),
hits AS (SELECT b.surface, b.gen_order, b.rule_order, b.pos, b.stem, b.put_order, k.lexeme_id, k.lemma, k.aspect FROM bases b JOIN known k ON k.key = b.base AND k.pos = b.pos
  WHERE CASE b.code WHEN 'inst' THEN regexp_matches(k.code, '^n:sg:inst$|:f:sg:inst$') WHEN 'inf' THEN k.code = 'v:inf' ELSE true END),
hit1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY surface, gen_order, rule_order, pos, stem ORDER BY put_order, lexeme_id) AS rn FROM hits) WHERE rn = 1),
both_ AS (SELECT m.*, h.lexeme_id, h.lemma AS known_lemma, h.aspect, coalesce(h.lemma, m.stem || guess_put) AS new_lemma FROM made m LEFT JOIN hit1 h USING (surface, gen_order, rule_order, pos, stem)
  WHERE h.lexeme_id IS NOT NULL OR guess_confidence IS NOT NULL),
heads(prefix, rule_order) AS (VALUES {', '.join(f"({lit(p)}, {i})" for i, p in enumerate(G.VERB_PREFIXES))}),
pre AS (SELECT surface, rule_order, prefix, arg_min(k.lemma, k.lexeme_id) AS base FROM w JOIN heads ON starts_with(w, prefix) AND length(w) >= length(prefix) + 3 JOIN known k ON k.key = substr(w, length(prefix) + 1) AND k.pos = 'verb' GROUP BY ALL),
found AS (SELECT surface, generator, gen_order, rule_order, alt, coalesce(lexeme_id, '?' || reading || ':' || new_lemma) AS key, new_lemma AS lemma, reading AS pos,
    {_sql_merged(_sql_merged('given', 'features'), "CASE WHEN aspect IS NOT NULL THEN 'aspect=' || aspect WHEN generator = 'past' AND ends_with(stem, 'ну') THEN 'aspect=perfective' ELSE '' END")} AS features,
    CASE WHEN lexeme_id IS NOT NULL THEN 'rule' ELSE 'statistical' END AS source,
    CASE WHEN lexeme_id IS NULL THEN guess_confidence WHEN generator = 'possessive' AND regexp_matches(surface, '^\\p{{Lu}}') THEN 0.55 ELSE confidence END AS confidence FROM both_
  UNION ALL SELECT surface, 'prefixed-verb', {G.GENERATORS.index('prefixed-verb')}, rule_order, 0, '?verb:' || prefix || base, prefix || base, 'verb', 'aspect=perfective', 'rule', 0.6 FROM pre
  UNION ALL SELECT surface, 'manner-adverb', {G.GENERATORS.index('manner-adverb')}, 0, 0, 'adverb:' || w, w, 'adverb', '', 'rule', 0.95 FROM w WHERE starts_with(w, 'по-') AND (length(w) > 6 AND ends_with(w, 'ски') OR substr(w, 4) IN ({', '.join(map(_q, G.MANNER))}))),
best AS (SELECT DISTINCT surface, generator, key, lemma, pos, features, source, CAST(confidence AS DOUBLE) AS confidence, CAST(alt AS INTEGER) AS alt FROM found
  QUALIFY dense_rank() OVER (PARTITION BY surface ORDER BY gen_order, rule_order) = 1)"""


def _readings(spark, sf_dir, words):
    return G.rule_readings(words, READINGS.df(spark, sf_dir), LEXICON.df(spark, sf_dir))


def _generator(name: str):
    @query(f"WITH {FORMS.sql}, {READINGS.sql}, {LEXICON.sql}, {_sql_readings('forms')} SELECT * FROM best WHERE generator = {_q(name)}", "readings_" + name.replace("-", "_"))
    def run(spark, sf_dir):
        return _readings(spark, sf_dir, FORMS.df(spark, sf_dir)).where(F.col("generator") == name)


for _name in G.GENERATORS:
    _generator(_name)


@query(f"WITH {sql_tokens(_CYR_SQL)}, v AS (SELECT DISTINCT surface FROM tok WHERE kind = 'word'), {READINGS.sql}, {LEXICON.sql}, {_sql_readings('v')} SELECT generator, pos, source, count(*) AS n, CAST(sum(length(lemma)) AS BIGINT) AS chars, min(key) AS first_key, max(features) AS last_features FROM best GROUP BY 1, 2, 3")
def readings_of_vocabulary(spark, sf_dir):
    words = S.surface_counts(_docs(spark, sf_dir, True), []).where("kind = 'word'").select("surface")
    found = _readings(spark, sf_dir, words)
    return found.groupBy("generator", "pos", "source").agg(F.count("*").alias("n"), F.sum(F.length("lemma")).cast("long").alias("chars"), F.min("key").alias("first_key"), F.max("features").alias("last_features"))


_KNOWN = """SELECT surface, c.key, c.lemma, c.pos, c.features, 'closed' AS source, CAST(1 AS DOUBLE) AS confidence, 0 AS source_order, CAST(NULL AS INTEGER) AS frank FROM {0} JOIN closed c ON c.form = {0}.w
  UNION ALL SELECT surface, r.lexeme_id, l.lemma, l.pos, r.features, 'dictionary', CAST(1 AS DOUBLE), 1, l.rank FROM {0} JOIN readings r ON r.key = {0}.w JOIN lexicon l USING (lexeme_id)"""
_TAIL = "regexp_extract(surface, '[^-]*$')"


@query(f"""WITH {TEXT.sql}, {CLOSED.sql}, {NAMES.sql}, {READINGS.sql}, {LEXICON.sql}, s AS (SELECT DISTINCT surface, {sql_loose('surface')} AS w FROM texts),
direct AS ({_KNOWN.format('s')}), rest AS (SELECT surface FROM s WHERE surface NOT IN (SELECT surface FROM direct)),
dashed AS (SELECT surface, CASE WHEN NOT starts_with(lower(surface), 'по-') AND contains(surface, '-') AND lower({_TAIL}) IN ({', '.join(map(_q, G.CLITICS))}) AND length(surface) > length({_TAIL}) + 1 THEN {_TAIL} END AS clitic FROM rest),
bare AS (SELECT surface, clitic, CASE WHEN clitic IS NULL THEN surface ELSE left(surface, length(surface) - length(clitic) - 1) END AS bare FROM dashed),
b AS (SELECT DISTINCT bare AS surface, {sql_loose('bare')} AS w FROM bare WHERE clitic IS NOT NULL), cutk AS ({_KNOWN.format('b')}),
unk AS (SELECT DISTINCT bare AS surface FROM bare WHERE bare NOT IN (SELECT surface FROM cutk)), {_sql_readings('unk').replace('cut AS (', 'cut_ AS (').replace('FROM cut WHERE', 'FROM cut_ WHERE').replace(', w AS (', ', w_ AS (')},
of_bare AS (SELECT * FROM cutk UNION ALL SELECT surface, key, lemma, pos, features, source, confidence, alt + 100, NULL FROM best),
every AS (SELECT *, CAST(NULL AS VARCHAR) AS clitic FROM direct UNION ALL SELECT b.surface, o.key, o.lemma, o.pos, o.features, o.source, o.confidence, o.source_order, o.frank, b.clitic FROM of_bare o JOIN bare b ON b.bare = o.surface
  UNION ALL SELECT surface, 'proper:' || canonical, canonical, 'proper', '', 'dictionary', 0.95, 500, NULL, NULL FROM s JOIN (SELECT lower(form) AS form, min(canonical) AS canonical FROM names GROUP BY 1) n ON n.form = lower(surface)),
d AS (SELECT DISTINCT * FROM every)
SELECT surface, CAST(row_number() OVER (PARTITION BY surface ORDER BY confidence DESC, source_order, coalesce(frank, 1000000000), key, features, lemma, pos, source, clitic) - 1 AS INTEGER) AS rank, key, lemma, pos, features, source, confidence, clitic FROM d""")
def word_analysis(spark, sf_dir):
    """ANA: closed classes, dictionary, rules, names and clitics of each word, ranked."""
    return G.analyse(TEXT.df(spark, sf_dir), READINGS.df(spark, sf_dir), LEXICON.df(spark, sf_dir), CLOSED.df(spark), NAMES.df(spark, sf_dir))


ASKED = Projected("asked", "surface string", f"SELECT DISTINCT {PICK('Мною ней моей нашего тем всё двух пятью сорока за что чтоб нельзя Были дом ни Которого себя нами этому', 'l_partkey')} AS surface FROM {{lineitem}}")
_TABLE = Fixture("classes", "form string, key string, lemma string, pos string, features string", closed_rows())


@query(f"WITH {ASKED.sql}, {_TABLE.sql} SELECT surface, key, features FROM asked JOIN classes ON form = {sql_loose('surface')}")
def closed_class_readings(spark, sf_dir):
    """JN-3: words against all closed-class tables in one join by loose key."""
    words = ASKED.df(spark, sf_dir).withColumn("w", T.loose_key(F.col("surface")))
    return words.join(closed_classes(spark), F.col("w") == F.col("form")).select("surface", "key", "features")
