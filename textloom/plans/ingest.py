"""Queries over the readers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import markup as M
from ..sources import plain as P
from .corpus import read
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


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
f AS (SELECT *, trim(line) = '' AS blank, coalesce(lag(trim(line) = '') OVER w, true) AS before, coalesce(lead(trim(line) = '') OVER w, true) AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
h AS (SELECT *, NOT blank AND length(trim(line)) <= 80 AND (regexp_matches(lower(trim(line)), {_sql(P.CHAPTER_WORD)}) OR (before AND after AND (regexp_matches(trim(line), {_sql(P.NUMERAL)}) OR (regexp_matches(trim(line), {_sql(P.NUMBERED)}) AND regexp_matches(trim(line), '^(?:[0-9]|[IVXLC]{{1,6}}(?:$|[\\s.:–—-]))'))))) AS heading FROM f),
p AS (SELECT *, coalesce(lag(heading) OVER (PARTITION BY doc_id ORDER BY no), false) AS ph FROM h),
n AS (SELECT doc_id, no, line, blank, heading, sum(CAST(heading AS INT)) OVER w AS chapter, sum(CAST(blank OR heading OR ph AS INT)) OVER w AS para FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
g AS (SELECT doc_id, chapter, para, string_agg(regexp_replace(trim(line), '[ \\t\\f\\r]+', ' ', 'g'), ' ' ORDER BY no) AS text FROM n WHERE NOT blank AND NOT heading GROUP BY 1, 2, 3)
SELECT doc_id, CAST(chapter AS BIGINT) AS chapter, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY para) - 1 AS paragraph, md5(text) AS text_md5 FROM g""")
def plain_text_chapters(spark, sf_dir):
    out = P.plain_text(read(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", F.col("chapter").cast("long").alias("chapter"), F.col("paragraph").cast("long").alias("paragraph"), F.md5("text").alias("text_md5"))


@query(None)
def html_blocks(spark, sf_dir):
    return M.html_blocks(read(spark, sf_dir, "pages"), "page_id").withColumn("emphasis", F.to_json("emphasis"))


#: Pages with what readers meet: optional end tags, classes, footnotes, tables, lists, nested quotes, breaks.
MARKUP = Fixture("markup", "page_id int, html string", [(i, h) for i, h in enumerate([
    "<html><head><title>T</title><p>one<p>two <i>three</i></html>", "<table><tr><td>a<td>b<tr><th>c</table>", '<div class="poetry">line<br>next</div><p class="footnote x">n</p><p class="chaptertitle title">H</p>',
    '<p>text<a class="noteref" href="#1">1</a> and <span style="font-style: italic">it</span><sup>2</sup>.</p><aside><p>side</p></aside>', "<blockquote><p>q1</p><p>q2</p></blockquote>after<hr>end", "<ul><li>x<li>y <b>z</b></ul><nav>menu</nav><footer>foot</footer>",
    '<h2>A &amp; B</h2><div>mixed<p>inner</p>tail</div><div class="letter"><p>Dear</p></div>', "", "no markup  at all", '<section epub:type="footnotes"><p>gone</p></section><p><b>all</b></p>',
])])
_BLOCKS = Fixture("want", "page_id int, block int, kind string, level int, text string, emphasis string", [
    (0, 0, "para", 0, "one", "[]"), (0, 1, "para", 0, "two three", '[{"start":4,"end":9,"kind":"em"}]'), (1, 0, "para", 0, "a", "[]"), (1, 1, "para", 0, "b", "[]"), (1, 2, "para", 0, "c", "[]"),
    (2, 0, "verse", 0, "line next", "[]"), (2, 1, "note", 0, "n", "[]"), (2, 2, "heading", 0, "H", "[]"), (3, 0, "para", 0, "text and it.", '[{"start":9,"end":11,"kind":"em"}]'), (3, 1, "note", 0, "side", "[]"),
    (4, 0, "quote", 0, "q1", "[]"), (4, 1, "quote", 0, "q2", "[]"), (4, 2, "para", 0, "after", "[]"), (4, 3, "para", 0, "end", "[]"), (5, 0, "para", 0, "x", "[]"), (5, 1, "para", 0, "y z", '[{"start":2,"end":3,"kind":"strong"}]'),
    (5, 2, "para", 0, "menu", "[]"), (5, 3, "para", 0, "foot", "[]"), (6, 0, "heading", 2, "A & B", "[]"), (6, 1, "para", 0, "mixed", "[]"), (6, 2, "para", 0, "inner", "[]"), (6, 3, "para", 0, "tail", "[]"), (6, 4, "letter", 0, "Dear", "[]"),
    (8, 0, "para", 0, "no markup at all", "[]"), (9, 0, "para", 0, "all", '[{"start":0,"end":3,"kind":"strong"}]'),
])


@query(f"WITH {_BLOCKS.sql} SELECT * FROM want")
def html_blocks_fixture(spark, sf_dir):
    return M.html_blocks(MARKUP.df(spark), "page_id").withColumn("emphasis", F.to_json("emphasis"))


@query(None)
def html_chapters(spark, sf_dir):
    return M.chapters(M.html_blocks(read(spark, sf_dir, "pages"), "page_id"), "page_id").withColumn("emphasis", F.to_json("emphasis"))


#: Names and beginnings of files for the pages, so that every extension and every sniffed beginning occurs.
_FILE = "CASE WHEN page_id % 12 < 10 THEN 'page' || split_part('.epub .PDF .acsm .html .htm .XHTML .json .txt .md .bin', ' ', CAST(1 + page_id % 12 AS INT)) ELSE 'page' END"
_HEAD = "CASE WHEN page_id % 5 = 0 THEN '{' WHEN page_id % 5 = 1 THEN 'PK' WHEN page_id % 5 = 2 THEN 'plain ' ELSE '' END || html"


@query(f"""WITH f AS (SELECT page_id, lower(regexp_extract({_FILE}, '\\.([A-Za-z0-9]+)$', 1)) AS ext, ltrim({_HEAD}) AS head FROM pages)
SELECT page_id, CASE WHEN ext = 'acsm' THEN 'drm' WHEN ext = 'pdf' THEN 'unsupported' WHEN ext = 'epub' THEN 'epub' WHEN ext IN ('html', 'htm', 'xhtml') THEN 'html' WHEN ext = 'json' THEN 'json' WHEN ext IN ('txt', 'text', 'md') THEN 'txt'
  WHEN starts_with(head, 'PK') THEN 'epub' WHEN starts_with(head, '<') THEN 'html' WHEN starts_with(head, '{{') THEN 'json' ELSE 'txt' END AS format FROM f""")
def format_detection(spark, sf_dir):
    files = read(spark, sf_dir, "pages").select("page_id", F.expr(_FILE).alias("name"), F.expr(_HEAD).alias("head"))
    return files.select("page_id", M.detect_format(F.col("name"), F.substring(F.ltrim("head"), 1, 64)).alias("format"))


@query("SELECT doc_id, 0::BIGINT AS chapter, paragraph - 1 AS paragraph, md5(para) AS text_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) AS paragraph FROM documents) WHERE NOT starts_with(para, '{')")
def json_round_trip(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    book = F.to_json(F.struct(F.lit("t").alias("title"), F.array(F.struct(F.lit("c").alias("title"), F.split("text", "\n").alias("paragraphs"))).alias("chapters")))
    out = M.json_books(d.select("doc_id", book.alias("raw")), "doc_id", "raw").where("not startswith(text, '{')")
    return out.select("doc_id", F.col("chapter").cast("long").alias("chapter"), F.col("paragraph").cast("long").alias("paragraph"), F.md5("text").alias("text_md5"))


@query("""WITH w AS (SELECT key, row_number() OVER (ORDER BY n DESC, key) AS rank FROM (SELECT lang || ':' || source AS key, count(*) AS n FROM documents GROUP BY 1))
SELECT key AS word, rank FROM w""")
def frequency_list(spark, sf_dir):
    n = read(spark, sf_dir, "documents").groupBy(F.concat("lang", F.lit(":"), "source").alias("key")).count().orderBy(F.desc("count"), "key")
    # a file of "word count" lines, as the reader gets it: one row per line with its number
    lines = n.select(F.concat("key", F.lit(" "), F.col("count").cast("string")).alias("line")).agg(F.collect_list("line").alias("x"))  # lang x source names
    return M.frequency_list(lines.select(F.posexplode("x").alias("no", "line"))).select("word", F.col("rank").cast("long").alias("rank"))
