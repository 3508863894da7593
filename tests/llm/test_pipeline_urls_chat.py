import importlib.util
import os
import random

import duckdb
import pytest

from textloom.llm import queries as Q
from textloom.llm.chat import format_chats
from textloom.llm.urls import judge_urls

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    result = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in result.description]
    want = sorted(tuple(str(r[cols.index(c)]) for c in df.columns) for r in result.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.collect()) == want


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/es/x?y", "http://example.org?u=/es/", "http://x.com/fr/a#b", "http://org:80/", "http://notexample.org/es/", "x://m.example.org/en/12", "http://m.example.org/en/2"]
    rules = spark.sql(f"SELECT * FROM VALUES {Q.URL_RULES} AS r(host, path, verdict)")
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(5, urls[5], "z")], "page_id long, url string, rule string")
    out = sorted(judge_urls(pages, rules).collect(), key=lambda r: r.page_id)
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out]
    assert got == [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.org", "", None, "allow"),
        (5, "a.example.org", "/es/x", "example.org/es/", "block"), (5, "a.example.org", "/es/x", "example.org/es/", "block"), (6, "example.org", "", None, "allow"),
        (7, "x.com", "/fr/a", "com/fr/", "allow"), (8, "org:80", "/", None, "allow"), (9, "notexample.org", "/es/", "org/", "allow"),
        (10, "m.example.org", "/en/12", "example.org/en/1", "block"), (11, "m.example.org", "/en/2", "org/", "allow"),
    ]
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_chat_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [a, ("assistant", "other")], 7: [b, a], 8: [a, b, ("user", "")]}
    rows = [(k, i, *t, 0) for k, ts in convs.items() for i, t in enumerate(ts)] + [(None, 0, "user", "x", 0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rank int")
    out = {r.conv_id: r.rendered for r in format_chats(df).collect()}
    assert set(out) == {3, 6, 7}
    assert out[7] == "<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    parts = {(r.conv_id, r.segment): r.rendered for r in format_chats(df, segment_turns=2).collect()}
    assert parts[(3, 0)] + parts[(3, 1)] == out[3]
    assert format_chats(df.limit(0)).count() == 0


@pytest.mark.skipif(not (os.path.isdir(SF) and importlib.util.find_spec("corpus_pipeline")), reason="no test tables or pipeline")
def test_pipeline_stages(spark):
    """Each stage against a plain rule on its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in P.STAGES:
        after = stage(spark, before, SF).cache()
        if name != "packing":
            assert after.columns == docs.columns
            kept, had = {r.doc_id: r for r in after.collect()}, {r.doc_id: r for r in before.collect()}
            assert 0 < len(kept) <= len(had) and kept.keys() <= had.keys()
        if name == "line dedup":
            seen = set()
            for d in sorted(kept):
                lines = [x for x in kept[d].text.split("\n") if len(x) >= 10]
                assert not seen & set(lines) and len(lines) == len(set(lines)) and kept[d].n_chars == len(kept[d].text)
                seen |= set(lines)
        if name == "near duplicates":
            shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
            sets = [(d, shingles(r.text)) for d, r in kept.items() if r.text and r.text.split()]
            assert not any(100 * len(s & t) >= 76 * len(s | t) for i, (_, s) in enumerate(sets) for _, t in sets[:i])
        before = after
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == set(kept)


@pytest.mark.skipif(not (os.path.isdir(SF) and importlib.util.find_spec("corpus_pipeline")), reason="no test tables or pipeline")
def test_pipeline_rows_repeated_and_without_id(spark):
    import corpus_pipeline as P

    words = [f"w{i}" for i in range(60)]
    a, near, b, c = " ".join(words), " ".join(words[:59]), "b " * 5 + "q r s t u v", "c d e f g h i j"
    schema = "doc_id long, text string, n_chars long"
    rows = [(5, a, 1), (5, a, 1), (3, near, 2), (None, a, 3), (None, b, 4), (None, b, 4), (7, c, 5), (7, c, 6), (7, "x y z u v w", 7), (8, None, 8), (9, "", 9)]
    out = P.near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(3), SF).collect()
    got = sorted(((r.doc_id, r.text) for r in out), key=str)
    assert got == sorted([(3, near), (None, b), (7, c), (7, "x y z u v w"), (8, None), (9, "")], key=str)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, item, 1), (1, f"so {item}", 2), (None, c, 3), (None, None, 4), (2, c, 5)]
    out = P.decontamination(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted(r.n_chars for r in out) == [3, 4, 5]
