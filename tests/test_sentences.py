"""Context rules over sentences that are one row each: the choices of the rules over tokens, without a sort or an exchange of tokens."""

import pytest
from pyspark.sql import functions as F
from test_context import CASES, tokens

from textloom.operators import context as X
from textloom.plans import whole


def sentences(spark):
    by_place = F.array_sort(F.collect_list(F.struct("i", "kind", "text", "cands")))
    return tokens(spark).groupBy("sentence_id").agg(by_place.alias("t")).select("sentence_id", F.col("t.kind").alias("kind"), F.col("t.text").alias("text"), F.col("t.cands").cast(f"array<array<{X.READING}>>").alias("cands"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_choices_in_a_row(spark, name):
    expected, rules = CASES[name]
    out = X.in_sentences(sentences(spark), rules).select("sentence_id", F.posexplode(F.arrays_zip("cands", "chosen", "why")).alias("i", "t")).where("t.why is not null")
    now = F.get("t.cands", F.col("t.chosen"))
    got = out.select("sentence_id", "i", now["lemma"], now["pos"], now["case"], "t.why").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_a_negation_beyond_reach_and_a_long_run_of_marks(spark):
    """The word before is looked for within eight tokens, as over rows of tokens."""
    of = lambda lemma, pos, case=None: [{"key": f"{pos}:{lemma}", "lemma": lemma, "pos": pos, "case": case, "confidence": 1.0}]
    rows = []
    for n in (0, 5, 6, 7, 8, 9):
        toks = [("word", "не", of("не", "particle")), ("word", "читал", of("читать", "verb")), *[("punct", ",", [])] * n, ("word", "книги", of("книга", "noun", "nom") + of("книга", "noun", "gen"))]
        rows.append((n, *map(list, zip(*toks, strict=True))))
    df = spark.createDataFrame(rows, f"sentence_id int, kind array<string>, text array<string>, cands array<array<{X.READING}>>")
    each = df.select("sentence_id", F.posexplode(F.arrays_zip("kind", "text", "cands")).alias("i", "t")).select("sentence_id", "i", "t.*")
    by_rows = {r[0] for r in X.in_context(each, [X.negated_object]).where("decided").select("sentence_id").collect()}
    in_rows = {r[0] for r in X.in_sentences(df, [X.negated_object]).where("exists(why, w -> w is not null)").select("sentence_id").collect()}
    assert by_rows == in_rows == {0, 5, 6}


def test_no_token_is_sorted_or_exchanged(spark, tmp_path):
    spark.createDataFrame([(1, "A man in the boat saw two dogs.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = whole.Q["context_all_rules"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan
