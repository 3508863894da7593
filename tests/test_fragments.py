"""Paragraph markup, ranges that move with collapsed text, and the functions for users of SQL."""

import random

from pyspark.sql import functions as F

from textloom.functions import sql
from textloom.functions.offsets import collapse_ranges
from textloom.operators import segment
from textloom.sources.fragments import decoded, fragments, read_fragment

RANGES = "array<struct<start:int,end:int,kind:string>>"


def plain(text, ranges):
    """Character by character: the new offset of every old one."""
    out, at = "", []
    for ch in text:
        at.append(len(out))
        if ch in " \t\n\r\x0b\x0c\xa0\xad":
            out += "" if out.endswith(" ") else " "
        else:
            out += ch
    at.append(len(out))
    lead, trimmed = out.startswith(" "), out.strip(" ")
    put = lambda p: max(0, min(len(trimmed), at[p] - lead))
    return trimmed, [(put(s), put(e), k) for s, e, k in ranges if put(e) > put(s)]


def test_ranges_move_as_in_a_plain_walk(spark):
    rnd = random.Random(5)
    rows = [("", []), ("   ", [(0, 3, "em")]), ("\xa0 a", [(0, 1, "em"), (1, 3, "em"), (2, 2, "em")]), ("a", [])]
    for _ in range(300):
        text = "".join(rnd.choice("ab  \n\xa0\xadé𝒳") for _ in range(rnd.randrange(30)))
        points = [sorted((rnd.randrange(len(text) + 1), rnd.randrange(len(text) + 1))) for _ in range(rnd.randrange(6))]
        rows.append((text, [(s, e, "em") for s, e in points]))
    long = "word  \n" * 20_000
    rows.append((long, [(i * 70, i * 70 + 4, "strong") for i in range(2_000)]))
    df = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(rows)], f"i int, t string, r {RANGES}")
    got = df.select("i", collapse_ranges(F.col("t"), F.col("r")).alias("c")).collect()
    assert len(got) == len(rows)
    for row in got:
        text, ranges = rows[row.i]
        assert (row.c.text, [tuple(r) for r in row.c.ranges]) == plain(text, ranges), text[:40]


def test_ranges_cut_the_same_words(spark):
    text = "  one <two>  three\n"
    row = spark.createDataFrame([(text, [(text.index("two"), text.index("three") + 5, "em")])], f"t string, r {RANGES}").select(collapse_ranges(F.col("t"), F.col("r")).alias("c")).first().c
    assert row.text[row.ranges[0].start : row.ranges[0].end] == "two> three"


def test_null_text(spark):
    row = spark.createDataFrame([(None, None)], f"t string, r {RANGES}").select(collapse_ranges(F.col("t"), F.col("r")).alias("c")).first()
    assert row.c is None


def test_fragments_of_odd_markup():
    assert read_fragment("a<i>b<b>c</i>d</b>e") == ("abcde", [(1, 3, "em"), (2, 4, "strong")])
    assert read_fragment("a<sup>1<sup>2</sup>3</sup>b</sup>c") == ("abc", [])
    assert read_fragment("a<em>b<sup>x</em></sup>c") == ("abc", [(1, 3, "em")])
    assert read_fragment("</i>a<br/>b<P class='x'>c") == ("a b c", [])
    assert read_fragment("1 < 2 & 3 &unknown; <i></i>") == ("1 < 2 & 3 &unknown; ", [])
    assert read_fragment("<strong>open") == ("open", [(0, 4, "strong")])


def test_entities():
    assert [decoded(e) for e in ("&nbsp;", "&#65;", "&#x416;", "&#X41;", "&Prime;", "&zzz;", "&#x110000;", "&#xD800;")] == ["\xa0", "A", "Ж", "A", "″", "&zzz;", "&#x110000;", "&#xD800;"]


def test_fragments_keep_every_row(spark):
    df = spark.createDataFrame([(1, "<i>x&nbsp; y</i> "), (2, None), (3, ""), (3, "")], "k int, m string")
    got = sorted((r.k, r.text, [tuple(x) for x in r.ranges]) for r in fragments(df, ["k"], F.col("m")).collect())
    assert got == [(1, "x y", [(0, 3, "em")]), (2, "", []), (3, "", []), (3, "", [])]
    assert fragments(df.where("false"), ["k"], F.col("m")).count() == 0


def test_sql_functions(spark):
    assert sql.register(spark) == sql.register(spark)
    row = spark.sql("SELECT loose_key('Всё’'), loose_key('дѣлъ'), token_kind('12'), collapse_space(' a\n\tb '), loose_key(CAST(NULL AS STRING))").first()
    assert tuple(row) == ("все'", "дел", "number", "a b", None)
    df = spark.createDataFrame([(1, "Да, it's 3.5!  "), (2, ""), (3, None)], "id int, text string")
    found = spark.sql("SELECT id, t.* FROM (SELECT id, tokens(text) AS found FROM {d}) LATERAL VIEW inline(found) t", d=df)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, segment.tokens(df, ["id"]).collect()))
    plan = found._jdf.queryExecution().toString()
    plan = plan.split("== Physical Plan ==")[1]
    assert "Python" not in plan and "Join" not in plan and "Exchange" not in plan
    assert [r.surface for r in spark.sql("SELECT * FROM tokenize('ab, 1') ORDER BY pos").collect()] == ["ab", ",", "1"]
