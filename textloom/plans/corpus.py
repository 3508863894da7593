"""Queries over the corpus tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import segment as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CYR_SQL = f"translate(text, {_q(T.LATIN_52)}, {_q(T.CYRILLIC_52)})"


def sql_kind(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '^{T._START}') THEN 'word' WHEN regexp_matches({c}, '^[{T._LAT}]') THEN 'latin' "
        f"WHEN regexp_matches({c}, '^[0-9]') THEN 'number' WHEN regexp_matches({c}, '^{T.SPACE}') THEN 'space' ELSE 'punct' END"
    )


def sql_loose(c: str) -> str:
    for x, y in T.MARKED_PAIRS.items():
        c = f"replace({c}, '{x}', '{y}')"
    c = f"translate({c}, 'ѐѝЀЍ', 'еиЕИ')"
    c = f"translate(regexp_replace({c}, '[{T.ACUTE}{T.GRAVE}]', '', 'g'), '’ʼ`´', '''''''''')"
    return f"regexp_replace(translate(lower({c}), 'ёѣіѳѵї', 'ееифии'), '([^аеиоуыэюяь])ъ$', '\\1')"


def sql_tokens(text: str = "text", cols: str = "doc_id, lang, source", source: str = "documents") -> str:
    return f"""pieces AS (SELECT {cols}, unnest(p) AS surface, generate_subscripts(p, 1) - 1 AS pos
      FROM (SELECT {cols}, regexp_extract_all({text}, {_q(T.PIECE)}) AS p FROM {source})),
    alltok AS (SELECT *, {sql_kind('surface')} AS kind FROM pieces), tok AS (SELECT * FROM alltok WHERE kind <> 'space')"""


def _docs(spark: SparkSession, sf_dir: str, cyr: bool) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.withColumn("text", T.cyrillic_projection(F.col("text"))) if cyr else docs


def _word_sql(c: str = "kind") -> str:
    return f"{c} IN ('word', 'latin')"


Q: dict = {}
SQL: dict = {}


def query(sql: str | None, name: str | None = None):
    def put(f):
        Q[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def _kinds(cyr: bool):
    def run(spark, sf_dir):
        found = S.surface_counts(_docs(spark, sf_dir, cyr), ["lang"])
        return found.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.sum(F.length("surface") * F.col("n")).alias("chars"))

    return run


for _c in (False, True):
    query(
        f"WITH {sql_tokens(_CYR_SQL if _c else 'text')} SELECT lang, kind, count(*) AS n, CAST(sum(length(surface)) AS BIGINT) AS chars FROM tok GROUP BY 1, 2",
        "token_kind_counts" + "_cyr" * _c,
    )(_kinds(_c))


@query(f"""WITH {sql_tokens()}, placed AS (SELECT doc_id, pos, kind, surface, sum(length(surface)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM alltok)
SELECT doc_id, count(*) AS n_tokens, CAST(sum(e - length(surface)) AS BIGINT) AS sum_start, CAST(max(e) AS BIGINT) AS max_end,
  CAST(sum(e * (pos % 97)) AS BIGINT) AS mixed FROM placed WHERE kind <> 'space' GROUP BY 1""")
def token_offsets(spark, sf_dir):
    t = S.tokenize(read(spark, sf_dir, "documents"), ["doc_id"])
    return t.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.sum("start").cast("long").alias("sum_start"), F.max("end").cast("long").alias("max_end"),
        F.sum(F.col("end") * (F.col("pos") % 97)).cast("long").alias("mixed"),
    )


_CL, _OP = _q(f"^(?:{S.CLOSERS})$"), _q(f"^(?:{S.OPENERS})$")


def sql_sentences(text: str) -> str:
    back = "OVER (PARTITION BY doc_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{sql_tokens(text)}, f AS (SELECT *, kind = 'punct' AND regexp_matches(surface, {_CL}) AS closer, kind = 'punct' AND regexp_matches(surface, {_OP}) AS opener,
      kind = 'number' OR regexp_matches(surface, '^\\p{{Lu}}') AS capital FROM tok),
    g AS (SELECT *, last_value(CASE WHEN NOT closer THEN pos END IGNORE NULLS) {back} AS next_pos, last_value(CASE WHEN NOT closer THEN opener END IGNORE NULLS) {back} AS next_opens,
      last_value(CASE WHEN kind <> 'punct' THEN capital END IGNORE NULLS) {back} AS next_capital FROM f),
    b AS (SELECT DISTINCT doc_id, next_pos AS pos FROM g WHERE kind = 'punct' AND regexp_matches(surface, '^[.!?…]+$') AND next_pos IS NOT NULL AND (next_opens OR coalesce(next_capital, true))),
    sent AS (SELECT g.doc_id, g.lang, g.pos, g.kind, g.surface, CAST(count(b.pos) OVER (PARTITION BY g.doc_id ORDER BY g.pos) AS BIGINT) AS sentence FROM g LEFT JOIN b USING (doc_id, pos))"""


def _sentence_counts(cyr: bool):
    def run(spark, sf_dir):
        t = S.sentences(_docs(spark, sf_dir, cyr), ["doc_id"])
        return t.groupBy("doc_id").agg((F.max("sentence") + 1).cast("long").alias("sentences"), F.count("*").alias("tokens"), F.sum(F.col("sentence") * (F.col("pos") % 89)).cast("long").alias("mixed"))

    return run


for _c in (False, True):
    query(
        f"WITH {sql_sentences(_CYR_SQL if _c else 'text')} SELECT doc_id, max(sentence) + 1 AS sentences, count(*) AS tokens, CAST(sum(sentence * (pos % 89)) AS BIGINT) AS mixed FROM sent GROUP BY 1",
        "sentence_counts" + "_cyr" * _c,
    )(_sentence_counts(_c))


@query(f"""WITH {sql_sentences('text')}, per AS (SELECT doc_id, any_value(lang) AS lang, sentence, count(*) FILTER (WHERE kind IN ('word', 'latin')) AS words FROM sent GROUP BY doc_id, sentence)
SELECT lang, count(*) AS sentences, CAST(sum(words) AS BIGINT) AS words, max(words) AS longest FROM per GROUP BY lang""")
def sentence_length_stats(spark, sf_dir):
    t = S.sentences(_docs(spark, sf_dir, False), ["doc_id", "lang"])
    per = t.groupBy("doc_id", "lang", "sentence").agg(F.count_if(F.col("kind").isin("word", "latin")).alias("words"))
    return per.groupBy("lang").agg(F.count("*").alias("sentences"), F.sum("words").alias("words"), F.max("words").alias("longest"))


_FORMS = f"forms AS (SELECT lang, source, {sql_loose('surface')} AS key FROM tok WHERE {_word_sql()})"
_KNOWN = f"known AS (SELECT DISTINCT {sql_loose('surface')} AS key FROM (SELECT unnest(regexp_extract_all(text, {_q(T.PIECE)})) AS surface FROM benchmark) WHERE {sql_kind('surface')} IN ('word', 'latin'))"


def _known(spark, sf_dir):
    return C.form_counts(S.surface_counts(read(spark, sf_dir, "benchmark"), ["item_id"])).select("key")


@query(f"""WITH {sql_tokens()}, {_FORMS}, {_KNOWN}
SELECT lang, count(*) AS tokens, count(k.key) AS covered, round(count(k.key) / count(*), 6) AS share FROM forms f LEFT JOIN known k USING (key) GROUP BY ROLLUP (lang)""")
def lexicon_coverage_rollup(spark, sf_dir):
    return C.coverage(C.form_counts(S.surface_counts(_docs(spark, sf_dir, False), ["lang"]), "lang"), _known(spark, sf_dir), "lang")


@query(f"WITH {sql_tokens()}, {_FORMS}, {_KNOWN} SELECT key, count(*) AS n FROM forms WHERE key NOT IN (SELECT key FROM known) GROUP BY 1 ORDER BY n DESC, key LIMIT 300")
def unknown_forms_topk(spark, sf_dir):
    forms = C.form_counts(S.surface_counts(_docs(spark, sf_dir, False), ["lang"]))
    return C.top_k(forms.join(_known(spark, sf_dir), "key", "left_anti").select("key", "n"), [F.desc("n"), F.asc("key")], 300)


@query(f"WITH {sql_tokens()}, {_FORMS}, {_KNOWN} SELECT DISTINCT key FROM forms WHERE key IN (SELECT key FROM known)")
def known_forms_semi(spark, sf_dir):
    return C.form_counts(S.surface_counts(_docs(spark, sf_dir, False), ["lang"])).join(_known(spark, sf_dir), "key", "left_semi").select("key")


@query(f"WITH {sql_tokens()}, {_FORMS} SELECT source, key, n FROM (SELECT source, key, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, key) AS rn FROM forms GROUP BY 1, 2) WHERE rn <= 20")
def form_frequency_topk(spark, sf_dir):
    forms = C.form_counts(S.surface_counts(_docs(spark, sf_dir, False), ["source"]), "source")
    return C.top_k(forms, [F.desc("n"), F.asc("key")], 20, ["source"]).select("source", "key", "n")


@query(f"SELECT lang, letter, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(upper({_CYR_SQL}), '[{T._CYR}]')) AS letter FROM documents) GROUP BY 1, 2")
def letter_frequency(spark, sf_dir):
    docs = _docs(spark, sf_dir, True)
    letters = docs.select("lang", F.explode(F.regexp_extract_all(F.upper("text"), F.lit(f"[{T._CYR}]"), F.lit(0))).alias("letter"))
    return letters.groupBy("lang", "letter").agg(F.count("*").alias("n"))


_PARA = "SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chapter FROM documents"


def _paragraphs(spark, sf_dir):
    return _docs(spark, sf_dir, False).select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("chapter", "para"))


@query(f"WITH paras AS ({_PARA}), {sql_tokens('para', 'doc_id, lang, source, chapter', 'paras')} SELECT lang, {sql_loose('surface')} AS key, CAST(min(chapter) AS BIGINT) AS first_chapter, count(*) AS n FROM tok WHERE {_word_sql()} GROUP BY 1, 2")
def first_occurrence(spark, sf_dir):
    t = S.surface_counts(_paragraphs(spark, sf_dir), ["lang"], "para", first=F.min("chapter")).where("kind in ('word', 'latin')")
    return t.groupBy("lang", T.loose_key(F.col("surface")).alias("key")).agg(F.min("first").cast("long").alias("first_chapter"), F.sum("n").alias("n"))


@query(f"WITH paras AS ({_PARA}), {sql_tokens('para', 'doc_id, lang, source, chapter', 'paras')} SELECT doc_id, CAST(chapter AS BIGINT) AS chapter, count(*) AS tokens, count(DISTINCT {sql_loose('surface')}) AS forms FROM tok WHERE {_word_sql()} GROUP BY 1, 2")
def chapter_distinct_forms(spark, sf_dir):
    t = S.surface_counts(_paragraphs(spark, sf_dir), ["doc_id", "chapter"], "para").where("kind in ('word', 'latin')")
    return t.groupBy("doc_id", F.col("chapter").cast("long").alias("chapter")).agg(F.sum("n").alias("tokens"), F.count_distinct(T.loose_key(F.col("surface"))).alias("forms"))


#: The letters that each stage of the alphabet course adds.
STAGES = [("latin-lookalikes", "АКМОТ"), ("false-friends", "ВНРСУХЕ"), ("new-shapes", "БГДЗИЙЛПФЭ"), ("iotated", "ЁЮЯ"), ("hushers", "ЖЧШЩЦ"), ("signs-and-y", "ЬЪЫ")]
_FORMS_CYR = f"forms AS (SELECT lang, {sql_loose('surface')} AS key, count(*) AS n FROM tok WHERE kind = 'word' GROUP BY 1, 2)"
_KNOWN_LETTERS = list("АКМОТВНРСУХЕБГД")


def _cyr_forms(spark, sf_dir, *groups):
    t = S.surface_counts(_docs(spark, sf_dir, True), ["lang"]).where("kind = 'word'")
    return C.form_counts(t, *groups)


def _sql_decode(key: str = "key") -> str:
    known = ", ".join(map(_q, _KNOWN_LETTERS))
    letters = f"list_transform(regexp_extract_all({key}, '[{T._CYR}]'), lambda x: upper(x))"
    return f"len(list_filter({letters}, lambda x: x IN ({known}))) AS hit, len({letters}) AS total, len(list_distinct(list_filter({letters}, lambda x: x NOT IN ({known})))) AS missing"


@query(f"""WITH {sql_tokens(_CYR_SQL)}, {_FORMS_CYR}, d AS (SELECT lang, n, {_sql_decode()} FROM forms),
c AS (SELECT lang, n, CASE WHEN total = 0 OR hit = total THEN 'fully' WHEN missing <= 1 AND hit / total >= 0.6 THEN 'nearly' ELSE 'not-yet' END AS category FROM d)
SELECT lang, category, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS forms FROM c GROUP BY 1, 2""")
def decodability_shares(spark, sf_dir):
    d = T.decodability(F.col("key"), F.array(*map(F.lit, _KNOWN_LETTERS)))
    return _cyr_forms(spark, sf_dir, "lang").select("lang", "n", d["category"].alias("category")).groupBy("lang", "category").agg(F.sum("n").alias("tokens"), F.count("*").alias("forms"))


_STAGE_OF = "CASE " + " ".join(f"WHEN x IN ({', '.join(map(_q, s))}) THEN {i}" for i, (_, s) in enumerate(STAGES)) + f" ELSE {len(STAGES)} END"


@query(f"""WITH {sql_tokens(_CYR_SQL)}, {_FORMS_CYR}, s AS (SELECT n, coalesce(list_max(list_transform(regexp_extract_all(upper(key), '[{T._CYR}]'), lambda x: {_STAGE_OF})), 0) AS stage FROM forms),
st(stage, stage_id) AS (VALUES {', '.join(f"({i}, '{s}')" for i, (s, _) in enumerate(STAGES))})
SELECT st.stage, st.stage_id, CAST((SELECT coalesce(sum(n), 0) FROM s WHERE s.stage <= st.stage) AS BIGINT) AS decodable,
  round((SELECT coalesce(sum(n), 0) FROM s WHERE s.stage <= st.stage) / (SELECT sum(n) FROM s), 6) AS share FROM st""")
def stage_coverage(spark, sf_dir):
    return C.stage_coverage(_cyr_forms(spark, sf_dir), STAGES)


@query(f"""WITH {sql_tokens(_CYR_SQL)}, {_FORMS_CYR}, d AS (SELECT lang, key, n, {_sql_decode()} FROM forms WHERE n >= 2 AND contains(upper(key), 'Р')),
r AS (SELECT lang, key, n, round(hit / total, 6) AS ratio, row_number() OVER (PARTITION BY lang ORDER BY hit / total DESC, total, n DESC, key) AS rn FROM d)
SELECT lang, key, n, ratio FROM r WHERE rn <= 8""")
def example_words(spark, sf_dir):
    d = T.decodability(F.col("key"), F.array(*map(F.lit, _KNOWN_LETTERS)))
    forms = _cyr_forms(spark, sf_dir, "lang").where("n >= 2").where(F.upper("key").contains("Р")).withColumn("d", d)
    top = C.top_k(forms, [F.desc("d.ratio"), F.asc("d.total"), F.desc("n"), F.asc("key")], 8, ["lang"])
    return top.select("lang", "key", "n", F.round("d.ratio", 6).alias("ratio"))


_CONC = f"""WITH {sql_sentences('text')}, s AS (SELECT doc_id, sentence, min(pos) AS at, string_agg(surface, ' ' ORDER BY pos) AS line FROM sent GROUP BY 1, 2),
hits AS (SELECT doc_id, any_value(lang) AS lang, sentence FROM sent WHERE {sql_loose('surface')} = 'that' GROUP BY doc_id, sentence)"""


@query(f"{_CONC}, r AS (SELECT lang, h.doc_id, h.sentence, line, row_number() OVER (PARTITION BY lang ORDER BY h.doc_id, h.sentence) AS rn FROM hits h JOIN s USING (doc_id, sentence)) SELECT lang, doc_id, sentence, line FROM r WHERE rn <= 12")
def concordance(spark, sf_dir):
    docs = _docs(spark, sf_dir, False).where(F.contains(F.lower(F.regexp_replace("text", "[\u0300\u0301]", "")), F.lit("that")))  # only these are segmented; marks don't count in a key
    split = lambda d: S.sentences(d, ["doc_id", "lang"])
    hits = split(docs).where(T.loose_key(F.col("surface")) == "that").select("lang", "doc_id", "sentence").distinct()
    first = C.top_k(hits, [F.asc("doc_id"), F.asc("sentence")], 12, ["lang"])
    first = F.broadcast(first)  # 12 rows a language
    line = split(docs.join(first.select("doc_id").distinct(), "doc_id", "left_semi")).join(first, ["lang", "doc_id", "sentence"], "left_semi")
    line = line.groupBy("lang", "doc_id", "sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "surface"))).alias("x"))
    return line.select("lang", "doc_id", "sentence", F.array_join("x.surface", " ").alias("line"))


@query(f"{_CONC}, c AS (SELECT lang, h.doc_id, h.sentence, line, row_number() OVER (PARTITION BY lang ORDER BY length(line), h.doc_id, h.sentence) AS rn FROM hits h JOIN s USING (doc_id, sentence) WHERE length(line) <= 140) SELECT lang, doc_id, sentence, line FROM c WHERE rn <= 2")
def example_sentences(spark, sf_dir):
    docs = _docs(spark, sf_dir, False).where(F.contains(F.lower(F.regexp_replace("text", "[\u0300\u0301]", "")), F.lit("that")))  # only these are segmented; marks don't count in a key
    sents = S.sentences(docs, ["doc_id", "lang"])
    line = sents.groupBy("lang", "doc_id", "sentence").agg(
        F.array_sort(F.collect_list(F.struct("pos", "surface"))).alias("x"), F.max(T.loose_key(F.col("surface")) == "that").alias("hit")
    )
    line = line.where("hit").select("lang", "doc_id", "sentence", F.array_join("x.surface", " ").alias("line")).where("length(line) <= 140")
    return C.top_k(line, [F.length("line"), F.asc("doc_id"), F.asc("sentence")], 2, ["lang"])


@query(f"""WITH {sql_sentences('text')}, s AS (SELECT doc_id, sentence, string_agg(surface, ' ' ORDER BY pos) AS line FROM sent GROUP BY 1, 2),
p AS (SELECT DISTINCT lang, key, doc_id, sentence FROM (SELECT *, {sql_loose('surface')} AS key FROM sent WHERE kind IN ('word', 'latin')) QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY doc_id, pos) <= 6),
r AS (SELECT p.*, line FROM p JOIN s USING (doc_id, sentence) QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY length(line), doc_id, sentence) <= 2)
SELECT lang, key, doc_id, sentence, line FROM r WHERE length(line) <= 140""")
def examples_of_forms(spark, sf_dir):
    return C.example_index(S.sentence_rows(_docs(spark, sf_dir, False), ["doc_id", "lang"]), ["lang"])


@query("""WITH d AS (SELECT doc_id, source, regexp_extract(text, '^\\s*([A-Za-zÀ-ÿ]+)', 1) AS lemma FROM documents),
n AS (SELECT doc_id, source, lemma, row_number() OVER (PARTITION BY source, lemma ORDER BY doc_id) AS k FROM d WHERE lemma <> '')
SELECT doc_id, source || ':' || lemma || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS lexeme_id FROM n""")
def homograph_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_extract("text", r"^\s*([A-Za-zÀ-ÿ]+)", 1).alias("lemma")).where("lemma <> ''")
    k = F.row_number().over(Window.partitionBy("source", "lemma").orderBy("doc_id"))
    return d.withColumn("k", k).select("doc_id", F.concat("source", F.lit(":"), "lemma", F.when(F.col("k") > 1, F.concat(F.lit("#"), "k")).otherwise("")).alias("lexeme_id"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c""")
def part_runs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return C.runs(c, ["conv_id"], ["turn"], F.col("role")).select("conv_id", "turn", F.col("run").cast("long").alias("run"))


def _half(which: str) -> str:
    return f"SELECT conv_id, turn AS idx, CAST(turn // 3 AS VARCHAR) AS part FROM conversations WHERE role = '{which}'"


def _sql_side(s: str) -> str:
    return f"""{s}1 AS (SELECT *, CASE WHEN part IS DISTINCT FROM lag(part) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS b FROM {s}0 WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
    {s}2 AS (SELECT conv_id, idx, sum(b) OVER (PARTITION BY conv_id ORDER BY idx) AS run FROM {s}1), {s}n AS (SELECT conv_id, max(run) + 1 AS runs FROM {s}2 GROUP BY 1)"""


@query(f"""WITH l0 AS ({_half('user')}), r0 AS ({_half('assistant')}), {_sql_side('l')}, {_sql_side('r')},
m AS (SELECT l.conv_id, coalesce(l.runs = r.runs AND l.runs > 1, false) AS by_run FROM ln l LEFT JOIN rn r USING (conv_id)),
lp AS (SELECT conv_id, idx, block, row_number() OVER (PARTITION BY conv_id, block ORDER BY idx) AS rn FROM (SELECT conv_id, idx, CASE WHEN by_run THEN run ELSE 0 END AS block FROM l2 JOIN m USING (conv_id))),
rp AS (SELECT conv_id, idx, block, row_number() OVER (PARTITION BY conv_id, block ORDER BY idx) AS rn FROM (SELECT conv_id, idx, CASE WHEN by_run THEN run ELSE 0 END AS block FROM r2 JOIN m USING (conv_id)))
SELECT lp.conv_id, lp.idx, rp.idx AS match_idx, CASE WHEN rp.idx IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM lp LEFT JOIN rp USING (conv_id, block, rn)""")
def chapter_alignment(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), "role", F.floor(F.col("turn") / 3).cast("string").alias("part"))
    return C.align(c.where("role = 'user'").drop("role"), c.where("role = 'assistant'").drop("role"), ["conv_id"])


@query("""WITH p AS (SELECT doc_id, text FROM documents), h AS (SELECT doc_id, source, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\x{0009}-\\x{000D} \\x{00A0}\\x{00AD}]+', ' ', 'g'))), chr(10))) AS content_hash FROM documents)
SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS first_doc FROM h""")
def content_hash_duplicates(spark, sf_dir):
    h = C.fingerprint(_paragraphs(spark, sf_dir), ["doc_id"], "chapter", "para")
    first = h.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"))
    return h.join(first, "content_hash").select("doc_id", "content_hash", "first_doc")


@query(f"""WITH {sql_sentences('text')}, w AS (SELECT doc_id, sentence, pos, {sql_loose('surface')} AS key, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY pos) AS i FROM sent),
p AS (SELECT doc_id, sentence, i, lead(i) OVER (PARTITION BY doc_id, sentence ORDER BY i) - i AS gap FROM w WHERE key = 'and')
SELECT doc_id, sentence, i AS at, gap FROM p WHERE gap <= 8""")
def paired_particle(spark, sf_dir):
    s = S.sentences(_docs(spark, sf_dir, False), ["doc_id"])
    w = Window.partitionBy("doc_id", "sentence").orderBy("i")
    p = s.where(T.loose_key(F.col("surface")) == "and").select("doc_id", "sentence", (F.col("index") + 1).alias("i"))
    return p.withColumn("gap", F.lead("i").over(w) - F.col("i")).where("gap <= 8").select("doc_id", "sentence", F.col("i").cast("long").alias("at"), F.col("gap").cast("long").alias("gap"))


@query(f"""WITH {sql_sentences('text')}, w AS (SELECT doc_id, sentence, pos, surface, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY pos) AS i FROM sent),
n AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, sentence ORDER BY pos) AS island FROM w WHERE i > 1 AND regexp_matches(surface, '^\\p{{Lu}}'))
SELECT doc_id, sentence, min(i) AS at, count(*) AS n, string_agg(surface, ' ' ORDER BY pos) AS name FROM n GROUP BY doc_id, sentence, island""")
def proper_name_runs(spark, sf_dir):
    s = S.sentences(_docs(spark, sf_dir, False), ["doc_id"]).where((F.col("index") > 0) & F.col("surface").rlike(r"^\p{Lu}"))
    island = F.col("index") - F.row_number().over(Window.partitionBy("doc_id", "sentence").orderBy("pos"))
    g = s.withColumn("island", island).groupBy("doc_id", "sentence", "island")
    r = g.agg((F.min("index") + 1).cast("long").alias("at"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "surface"))).alias("x"))
    return r.select("doc_id", "sentence", "at", "n", F.array_join("x.surface", " ").alias("name"))


_MAP_SQL = "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in T.TRANSLITERATION.items()) + "}"


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(string_split({_CYR_SQL}, ''), lambda x: CASE WHEN {_MAP_SQL}[lower(x)] IS NULL THEN x WHEN x = lower(x) THEN {_MAP_SQL}[lower(x)]
  ELSE upper(substr({_MAP_SQL}[lower(x)], 1, 1)) || substr({_MAP_SQL}[lower(x)], 2) END), '')) AS latin_md5 FROM (SELECT doc_id, translate(text, 'òóàáèéùúìíýÀÁÈÉÌÍÒÓÙÚÝ', '                      ') AS text FROM documents)""")
def transliterate_cyr(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.translate("text", "òóàáèéùúìíýÀÁÈÉÌÍÒÓÙÚÝ", " " * 22).alias("text"))
    return d.select("doc_id", F.md5(T.transliterate(T.cyrillic_projection(F.col("text")))).alias("latin_md5"))
