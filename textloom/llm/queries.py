"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .codes import vector_codes
from .common import table
from .decontaminate import find_leaks
from .embeddings import near_embeddings
from .jaccard import jaccard_components
from .linededup import dedup_lines
from .packing import pack_documents
from .pii import pseudonymise
from .quality import classify
from .secrets import scan
from .spelling import spelling_variants
from .topk import top_matches
from .urls import judge_urls


def vocabulary_path() -> str:
    """Where the byte-level vocabulary lies; asked on the driver and passed on as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Key of the pseudonyms in the registered query; a real run passes its own secret.
PSEUDONYM_KEY = "example key"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs.select("doc_id", "text", "source", "lang"), labels, F.col("source"), F.col("lang")).select("doc_id", "evidence", "posterior", "keep")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


#: The rules of the URL query: host, path, verdict.
URL_RULES = "('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {URL_RULES} AS r(host, path, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {URL_RULES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
    FROM (SELECT DISTINCT host, path FROM cut) c JOIN rules ON (c.host = r_host OR ends_with(c.host, '.' || r_host)) AND starts_with(c.path, r_path)
    GROUP BY host, path)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM cut c LEFT JOIN best b USING (host, path)
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP9_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rank
    FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, rank, string_agg(md5(role || chr(0) || text), ',') OVER (PARTITION BY conv_id ORDER BY rank) AS prefix,
        count(*) OVER (PARTITION BY conv_id) AS n FROM t),
kept AS (SELECT min(conv_id) AS conv_id, n FROM p WHERE rank = n
    AND NOT EXISTS (SELECT 1 FROM p q WHERE q.rank < q.n AND q.prefix = p.prefix) GROUP BY prefix, n)
SELECT k.conv_id, CAST((t.rank - 1) // 1024 AS BIGINT) AS segment, CAST(k.n AS BIGINT) AS n_turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY rank) AS rendered
FROM kept k JOIN t ON t.conv_id = k.conv_id GROUP BY ALL
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


#: Vectors of whole numbers, without those that hold nulls or non-finite components.
WHOLE_VECTORS = """SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_matches(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP11_SQL = f"""
WITH v AS ({WHOLE_VECTORS.format(scale=1024)}),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


_NEAREST = "(SELECT r, part, min_by(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT r, p.part, entry, (x1 - c1) ** 2 + (x2 - c2) ** 2 + (x3 - c3) ** 2 + (x4 - c4) ** 2 AS d FROM p JOIN {b} b ON p.part = b.part) GROUP BY ALL)"
_MEANS = """(SELECT b.part, b.entry, {each} FROM {b} b LEFT JOIN (SELECT p.part, entry, {sums}
    FROM p JOIN {a} a ON p.r = a.r AND p.part = a.part GROUP BY ALL) m ON b.part = m.part AND b.entry = m.entry)"""


def _op12_sql() -> str:
    each = ", ".join(f"coalesce(m{i}, c{i}) AS c{i}" for i in range(1, 5))
    sums = ", ".join(f"CAST(floor(CAST(sum(x{i}) AS DOUBLE) / count(*)) AS BIGINT) AS m{i}" for i in range(1, 5))
    ctes = [f"kept AS ({WHOLE_VECTORS.format(scale=256)})", "p AS (SELECT r, g.part, " + ", ".join(f"w[4 * g.part + {i}] AS x{i}" for i in range(1, 5)) + " FROM kept, range(16) g(part))"]
    ctes.append("b0 AS (SELECT part, r - 1 AS entry, x1 AS c1, x2 AS c2, x3 AS c3, x4 AS c4 FROM p WHERE r <= 64)")
    for i in (0, 1):
        ctes += [f"a{i} AS MATERIALIZED {_NEAREST.format(b=f'b{i}')}", f"b{i + 1} AS MATERIALIZED {_MEANS.format(b=f'b{i}', a=f'a{i}', each=each, sums=sums)}"]
    ctes.append(f"a2 AS MATERIALIZED {_NEAREST.format(b='b2')}")
    ctes.append("coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)")
    ctes.append("books AS (SELECT sha256(string_agg(concat_ws(',', c1, c2, c3, c4), ',' ORDER BY part, entry)) AS h FROM b2)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), books"


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per_doc AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM per_doc, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word),
path AS (SELECT word, word AS root FROM formed UNION ALL SELECT p.word, f.form FROM path p JOIN formed f ON p.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT p.word, p.root FROM path p JOIN formed f ON p.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON f.word = e.word
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_url_rules": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_exact_topk": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_spelling_variants": OP13_SQL,
    }
