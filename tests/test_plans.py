"""Plans whose parts are read by several steps must not hold these parts once a step."""

from pyspark.sql import functions as F

from textloom.operators import corpus as C
from textloom.operators import generate as G
from textloom.operators import segment as S
from textloom.plans import analysis as P


def test_word_analysis_reads_its_tables_once(spark):
    """Its plan held the texts 208 times, 19.9 MB in letters, which a driver's memory doesn't hold."""
    table = lambda p: spark.createDataFrame([r[: len(p.cols)] for r in p.extra], p.schema).withColumn(p.cols[0][0], F.concat(p.cols[0][0], F.lit("")))
    closed = spark.createDataFrame([("и", "conjunction:и", "и", "conjunction", "")], "form string, key string, lemma string, pos string, features string")
    out = G.analyse(table(P.TEXT), table(P.READINGS), table(P.LEXICON), closed, table(P.NAMES))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000 and plan.count("concat(surface") <= 2
    assert {r.surface for r in out.select("surface").distinct().collect()} == {r[0] for r in P.TEXT.extra}


def test_examples_exchange_no_tokens(spark):
    """Sentences were gathered from exchanged tokens and stored with them: 247 MB of disk for 24.8 million characters, 40 MB without."""
    docs = spark.createDataFrame([(1, "en", "One cat sat. A cat ran far. " + "long " * 40 + "cat."), (2, "en", "Cat!")], "doc_id int, lang string, text string")
    out = C.example_index(S.sentence_rows(docs, ["doc_id", "lang"]), ["lang"])
    assert "collect_list" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted((r.key, r.doc_id, r.sentence, r.line) for r in out.where("key in ('cat', 'long')").collect()) == [("cat", 1, 0, "One cat sat ."), ("cat", 2, 0, "Cat !")]
