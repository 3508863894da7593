"""Every query of the library against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from textloom.operators import analysis as A
from textloom.plans import registry, whole

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def connected(folder):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """A folder with some of the documents: the analysis of whole sentences is compared on these."""
    folder = str(tmp_path_factory.mktemp("few"))
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/documents.parquet' WHERE n_chars < 4000 ORDER BY doc_id LIMIT 30) TO '{folder}/documents.parquet' (FORMAT PARQUET)")
    return folder


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, few, name):
    folder, con = (few, connected(few)) if name in whole.Q else (SF, con)
    df = registry.queries()[name](spark, folder)
    result = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, map(tuple, df.collect())) == rows(cols, result.fetchall())


def test_projected_readings_in_place_are_those_of_the_vocabulary(spark, few):
    """And a rule that looks at no neighbour exchanges no tokens, the others sentences as one row each."""
    tokens = whole.projected_tokens(spark, few)
    cands = lambda df: sorted((str(r.sentence_id), r.i, r.text, str(r.cands)) for r in df.collect())
    assert cands(whole.with_projected_readings(tokens)) == cands(A.with_readings(tokens, whole.projected_readings(spark, tokens)))
    plan = lambda name: whole.Q[name](spark, few)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("context_names") and "RepartitionByExpression" in plan("context_names")
    assert "Join" not in plan("context_all_or_everything") and "Repartition" not in plan("context_all_or_everything")
