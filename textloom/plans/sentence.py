"""Queries over constructions, stores and activity windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constructions as K
from ..operators import store as ST
from ..streaming import activity as A
from .corpus import _q, read
from .lexicon import Fixture

Q: dict = {}
SQL: dict = {}


def query(sql):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_COLS = "w pos lemma gcase number gender person verb_form tense aspect motion reflexive pronoun_type".split()


def _tokens() -> Fixture:
    v = lambda w, lemma, form, **k: dict(w=w, pos="verb", lemma=lemma, verb_form=form, **k)
    t = lambda w, pos, **k: dict(w=w, pos=pos, lemma=k.pop("lemma", w.lower()), **k)
    sentences = [
        [t("Я", "pronoun", pronoun_type="personal"), v("буду", "быть", "present-future", tense="future"), v("читать", "читать", "infinitive", aspect="imperfective"), t("книгу", "noun", lemma="книга", gcase="acc")],
        [t("Никто", "pronoun", pronoun_type="negative"), t("не", "particle"), v("читал", "читать", "past", aspect="imperfective"), t("книги", "noun", lemma="книга", gcase="gen")],
        [t("Он", "pronoun", pronoun_type="personal"), t("не", "particle"), v("шёл", "идти", "past", aspect="imperfective", motion="uni"), t("к", "preposition"), t("старому", "adjective", gcase="dat"), t("другу", "noun", lemma="друг", gcase="dat")],
        [t("Мне", "pronoun", lemma="я", gcase="dat", pronoun_type="personal"), t("надо", "predicative"), v("вернуться", "вернуться", "infinitive", aspect="perfective", reflexive=True)],
        [t("Ни", "particle"), t("рыба", "noun", gcase="nom"), t("ни", "particle"), t("мясо", "noun", gcase="nom")],
        [t("Пять", "numeral"), t("новых", "adjective", gcase="gen"), t("домов", "noun", lemma="дом", gcase="gen")],
        [t("У", "preposition"), t("меня", "pronoun", lemma="я", gcase="gen", pronoun_type="personal"), t("Иван", "proper"), t("Иван", "proper"), v("пришёл", "прийти", "past", aspect="perfective", motion="uni"), t("бы", "particle")],
        [t("чтобы", "conjunction"), v("жить", "жить", "infinitive"), t("лучше", "comparative"), t(",", "punct"), t("чем", "conjunction"), v("думая", "думать", "gerund-pres")],
    ]
    rows = [(s, i, *[x.get(c) for c in _COLS]) for s, xs in enumerate(sentences) for i, x in enumerate(xs)]
    schema = "sentence_id int, i int, " + ", ".join(f"{c} {'int' if c == 'person' else 'boolean' if c == 'reflexive' else 'string'}" for c in _COLS)
    return Fixture("toks", schema, rows)


TOKENS = _tokens()
_AT = lambda test, lo, hi, back=False: f"(SELECT {'max' if back else 'min'}(x.i) FROM toks x WHERE x.sentence_id = t.sentence_id AND x.i BETWEEN t.i + ({lo}) AND t.i + ({hi}) AND {test})"


def _sql(order: int, when: str, pattern: str, members: list[str], confidence: float) -> str:
    return f"SELECT sentence_id, {order} AS finder, {pattern} AS pattern, i AS head, array_to_string(list_sort(list_distinct([x FOR x IN [{', '.join(members)}] IF x IS NOT NULL])), ',') AS members, {confidence}::DOUBLE AS confidence FROM toks t WHERE {when}"


_AUX = "(pos = 'verb' AND lemma = 'быть' AND tense = 'future' AND EXISTS (SELECT 1 FROM toks x WHERE x.sentence_id = t.sentence_id AND x.i = t.i + 1 AND x.pos = 'verb' AND x.verb_form = 'infinitive'))"
_USED = "EXISTS (SELECT 1 FROM toks y JOIN toks x ON x.sentence_id = y.sentence_id AND x.i = y.i + 1 WHERE y.sentence_id = t.sentence_id AND t.i IN (y.i, x.i) AND y.pos = 'verb' AND y.lemma = 'быть' AND y.tense = 'future' AND x.pos = 'verb' AND x.verb_form = 'infinitive')"
_NEG = _AT("x.pronoun_type = 'negative'", -3, -1, True)
_GEN = _AT("x.gcase = 'gen' AND x.pos IN ('noun', 'proper', 'pronoun')", 1, 3)
_NOUN = _AT("x.pos IN ('noun', 'proper')", 1, 4)
_HEAD = _AT("(x.pos NOT IN ('adjective', 'numeral', 'pronoun') OR x.pronoun_type = 'personal')", 1, 6)
_VERB = f"coalesce({_AT(chr(120) + '.pos = ' + _q('verb'), -4, -1, True)}, {_AT(chr(120) + '.pos = ' + _q('verb'), 1, 4)})"
_PARTS = [
    _sql(0, _AUX, "'future:analytic'", ["i", "i + 1"], 0.9),
    _sql(1, f"pos = 'verb' AND verb_form IN ('past', 'present-future', 'imperative', 'infinitive') AND NOT {_USED}", "'aspect:' || coalesce(aspect, 'unknown')", ["i"], 0.85),
    _sql(2, "pos = 'verb' AND motion IS NOT NULL", "'motion:' || motion", ["i"], 0.85),
    _sql(3, "pos = 'predicative'", "'impersonal:' || lemma", ["i", _AT("x.gcase = 'dat'", -2, -1, True), _AT("x.verb_form = 'infinitive'", 1, 2)], 0.85),
    _sql(4, "lower(w) = 'у' AND pos = 'preposition' AND EXISTS (SELECT 1 FROM toks x WHERE x.sentence_id = t.sentence_id AND x.i = t.i + 1 AND x.gcase = 'gen')", "'possession:у'", ["i", "i + 1"], 0.8),
    _sql(5, "pos = 'verb' AND reflexive", "'reflexive:general'", ["i"], 0.55),
    _sql(6, "lower(w) = 'не' AND EXISTS (SELECT 1 FROM toks x WHERE x.sentence_id = t.sentence_id AND x.i = t.i + 1 AND x.pos <> 'punct')", f"CASE WHEN {_NEG} IS NOT NULL THEN 'negation:double' WHEN {_GEN} IS NOT NULL THEN 'negation:genitive-object' ELSE 'negation:plain' END", [_NEG, "i", "i + 1", _GEN], 0.85),
    _sql(7, f"lower(w) = 'ни' AND {_AT('lower(x.w) = ' + _q('ни'), 1, 8)} IS NOT NULL", "'negation:ni-ni'", ["i", _AT("lower(x.w) = 'ни'", 1, 8)], 0.8),
    _sql(8, f"pos = 'numeral' AND {_NOUN} IS NOT NULL", "'numeral:' || lemma", ["i", _NOUN], 0.85),
    _sql(9, f"pos = 'preposition' AND (SELECT x.pos FROM toks x WHERE x.sentence_id = t.sentence_id AND x.i = {_HEAD}) IN ('noun', 'proper', 'pronoun')", "'pp:' || lower(w)", ["i", _HEAD], 0.85),
    _sql(10, "starts_with(verb_form, 'participle')", "'participle:' || verb_form", ["i"], 0.7),
    _sql(11, "starts_with(verb_form, 'gerund')", "'gerund:' || verb_form", ["i"], 0.7),
    _sql(12, f"lower(w) IN ('бы', 'б') AND {_VERB} IS NOT NULL", "'conditional:бы'", ["i", _VERB], 0.8),
    _sql(13, "lower(w) IN ('чтобы', 'чтоб')", "'purpose:чтобы'", ["i", _AT("x.pos = 'verb'", 1, 6)], 0.85),
    _sql(14, "pos = 'comparative'", "'comparative'", ["i", _AT("lower(x.w) = 'чем'", 1, 3)], 0.8),
    "SELECT sentence_id, 15, 'name:' || lemma, min(i), string_agg(i, ',' ORDER BY i), 0.9::DOUBLE FROM (SELECT *, i - row_number() OVER (PARTITION BY sentence_id ORDER BY i) AS island FROM toks WHERE pos = 'proper') GROUP BY sentence_id, lemma, island",
]


@query(f"WITH {TOKENS.sql} " + " UNION ALL ".join(_PARTS))
def constructions(spark, sf_dir):
    return K.find_constructions(TOKENS.df(spark)).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def activity_windows(spark, sf_dir):
    return A.activity(read(spark, sf_dir, "events"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM m ORDER BY user_id, ts, b DESC))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def activity_sessions(spark, sf_dir):
    return A.sessions(read(spark, sf_dir, "events"))


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.n, a.n) AS n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.user_id = b.user_id")
def progress_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    counts = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    return ST.merge_progress(counts("view"), counts("click"), ["user_id"])


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS book_id FROM documents WHERE lang = 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0') GROUP BY 1")
def duplicate_refusal(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.sha2("text", 256).alias("content_hash"), "lang", "source")
    return ST.new_books(d.where("lang = 'en'"), d.where("source = 'src0'"))


@query("SELECT doc_id, turn_count FROM (SELECT doc_id, length(text) AS turn_count FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def cascade_delete(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("turn_count"))
    gone = read(spark, sf_dir, "labels").where("quality = 0")
    return ST.cascade_delete({"documents": docs}, gone, "doc_id")["documents"]
