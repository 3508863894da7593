"""Every operator on nulls, repeated rows, an empty table and columns named like its own helpers; plain versions of op1 and op6."""

import hashlib
import hmac
import importlib.util
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import queries as Q
from textloom.llm.chat import format_chats
from textloom.llm.decontaminate import find_leaks
from textloom.llm.embeddings import near_embeddings
from textloom.llm.jaccard import jaccard_components
from textloom.llm.linededup import dedup_lines
from textloom.llm.packing import pack_documents
from textloom.llm.pii import ROUNDS, pseudonymise
from textloom.llm.quality import classify
from textloom.llm.secrets import scan
from textloom.llm.urls import judge_urls

TEXT = "one two three four five six seven eight\na line that is long enough\nmail a.b1@x.org or call"
DOCS = [(1, TEXT, "s", "en"), (1, TEXT, "s", "en"), (2, None, None, None), (3, "", "s", None), (None, TEXT, None, "en"), (1, "other words of the same id", "t", "de"), (None, None, None, None)]
PAGES = [(1, "http://a.org/es/x"), (1, "http://a.org/es/x"), (None, None), (2, "")]
TURNS = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, None), (2, None, None, None)]
VECTORS = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (1, [0.0, 1.0])]


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, None), (None, "x"), (3, "")], "item_id long, text string")


def rules(spark):
    return spark.sql(f"SELECT * FROM VALUES {Q.URL_RULES} AS r(host, path, verdict)")


#: operator, its rows and their schema, names of its helpers, and whether it passes other columns on.
OPERATORS = {
    "pseudonymise": (lambda s, d: pseudonymise(d, "k"), DOCS, "doc_id long, text string, source string, lang string", "row found kinds", True),
    "jaccard": (lambda s, d: jaccard_components(d), DOCS, "doc_id long, text string, source string, lang string", "own fp row seeds n_shingles k1 k2 component_id", False),
    "lines": (lambda s, d: dedup_lines(d), DOCS, "doc_id long, text string, source string, lang string", "row doc key gone_doc gone_key gone_lines line_no h1", True),
    "embeddings": (lambda s, d: near_embeddings(d), VECTORS, "vec_id long, embedding array<double>", "v rep copies n component known tile", False),
    "leaks": (lambda s, d: find_leaks(d, items(s)), DOCS, "doc_id long, text string, source string, lang string", "key words item_id k shift runs", False),
    "quality": (lambda s, d: classify(d, labels(s), F.col("source"), F.col("lang")), DOCS, "doc_id long, text string, source string, lang string", "row host path p n s hn hs g_host g_path r_host r_rate quality", True),
    "secrets": (lambda s, d: scan(d), DOCS, "doc_id long, text string, source string, lang string", "assign access hex random spans base", False),
    "urls": (lambda s, d: judge_urls(d, rules(s)), PAGES, "page_id long, url string", "row best b_host b_path r_host r_rule key digest", True),
    "chats": (lambda s, d: format_chats(d), TURNS, "conv_id long, turn long, role string, text string", "rank h1 p1 last segment", False),
    "packing": (lambda s, d: pack_documents(d, Q.vocabulary_path()), DOCS, "doc_id long, text string, source string, lang string", "ids crew sequence_id", False),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_names(spark, name):
    run, rows, schema, helpers, passes = OPERATORS[name]
    extra = helpers.split()
    plain = spark.createDataFrame(rows, schema).repartition(2)
    named = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in extra])
    a, b = run(spark, plain), run(spark, named)
    if passes:
        assert set(a.columns) | set(extra) == set(b.columns)
        assert all(r[c] == f"own {c}" for r in b.select(*[c for c in extra if c not in a.columns]).collect() for c in r.asDict())
        assert a.count() == len(rows)
        b = b.select(a.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert run(spark, named.limit(0)).count() == 0


def permuted(left, right, a, b, tweak, key):
    """The Feistel rounds, written plainly."""
    inner, outer = (hmac.new(key.encode(), n, hashlib.sha256).hexdigest() for n in (b"inner", b"outer"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i in range(ROUNDS):
        side = left if i % 2 else right
        f = int(sha(outer + sha("|".join(map(str, (inner, tweak, a, b, i, side)))))[:15], 16)
        left, right = (left, (right + f % b) % b) if i % 2 else ((left + f % a) % a, right)
    return left, right


def test_pseudonyms_equal_plain_rounds(spark):
    rng = random.Random(5)
    ips = [f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(30)]
    ssns = [f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(30)]
    want = {}
    for v in ips:
        o = list(map(int, v.split(".")))
        x, y = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", "k")
        want[v] = f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    for v in ssns:
        area, group, serial = map(int, v.split("-"))
        x, y = permuted(area - 1, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", "k")
        want[v] = f"{x + 1 if x < 665 else x + 2:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    rows = list(enumerate(want))
    got = {rows[r.doc_id][1]: r.text for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got == want


def test_more_written_forms(spark):
    forms = ["555-123-4567", "1 555-123-4567", "212.555.0123", "DE89 3704 0044 0532 0130 00", "3/4/2021", "03.04.2021", "Ann.B7@Example.org"]
    out = [r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert all(x != y for x, y in zip(out, forms))
    shape = lambda s: "".join("9" if c.isdigit() else c for c in s)
    assert [shape(x) for x in out[:4]] == [shape(x) for x in forms[:4]] and out[0][0] == "5" and out[1][:3] == "1 5"
    bare = out[3].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    local = out[6].split("@")[0]
    assert out[6].endswith("@Example.org") and local[0].isupper() and local[4].isupper() and local[1:3].islower() and local[3] == "." and local[5].isdigit()


def test_posteriors_equal_plain_formula(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(rng.randrange(1, 60))), f"s{rng.randrange(5)}", f"l{rng.randrange(3)}") for i in range(150)]
    rows += [(500, "single site text", "alone", "l0"), (501, "", "s1", "l1"), (502, None, None, None)]
    marks = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    out = classify(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), F.col("source"), F.col("lang")).collect()
    p = {r.doc_id: 1 / (1 + math.exp(-r.evidence)) for r in out if r.text}
    where = {r.doc_id: (r.source, r.lang) for r in out}
    group = lambda key: {k: [p[d] for d in p if key(where[d]) == k] for k in {key(where[d]) for d in p}}
    hosts, paths = group(lambda w: w[0]), group(lambda w: w)
    mean = sum(p.values()) / len(p)

    def strength(groups, parent):
        g = [(len(x), sum(x), min(max(parent(k), 0.001), 0.999)) for k, x in groups.items() if len(x) > 1]
        n = sum(x[0] for x in g)
        between = max((sum(k * (s / k - r) ** 2 for k, s, r in g) - sum(r * (1 - r) for _, _, r in g)) / n, 1e-6)
        return min(max(sum(k * r * (1 - r) for k, _, r in g) / n / between - 1, 1.0), 1e4)

    kh = strength(hosts, lambda k: mean)
    kp = strength(paths, lambda k: (sum(hosts[k[0]]) + kh * mean) / (len(hosts[k[0]]) + kh))
    logit = lambda x: math.log(min(max(x, 0.001), 0.999) / (1 - min(max(x, 0.001), 0.999)))
    keep_rate = min(max(sum(q * (1 - t) for _, q, t in marks) / len(marks), 0.01), 0.99)
    for r in out:
        if not r.text:
            assert r.posterior == 0 and not r.keep
            continue
        h, g = hosts[r.source], paths[(r.source, r.lang)]
        rate = (sum(h) - p[r.doc_id] + kh * mean) / (len(h) - 1 + kh)
        rate = (sum(g) - p[r.doc_id] + kp * rate) / (len(g) - 1 + kp)
        assert abs(r.posterior - 1 / (1 + math.exp(-(r.evidence + logit(rate) - logit(keep_rate))))) < 1e-9
        assert r.keep == (r.posterior >= 0.5)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not (os.path.isdir(SF) and importlib.util.find_spec("corpus_pipeline")), reason="no test tables or pipeline")
@pytest.mark.parametrize("name", ["quality", "line dedup", "near duplicates", "decontamination", "packing"])
def test_stages_on_odd_rows(spark, name):
    """Nulls, repeated rows, an empty table, and columns named like helpers, which pass unchanged."""
    import corpus_pipeline as P

    stage, extra = dict(P.STAGES)[name], "row key id stays n_dropped keep evidence".split()
    rows = [(*r, len(r[1] or "")) for r in DOCS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").select("*", *[F.lit(f"own {c}").alias(c) for c in extra])
    out = stage(spark, docs, SF)
    found = out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert sum(r.length for r in found) >= len(rows)
        return
    assert out.columns == docs.columns and len(found) <= len(rows)
    assert all(r[c] == f"own {c}" for r in found for c in extra)
    if name == "near duplicates":
        assert sorted((r.doc_id, r.text) for r in found if r.text)[0] == (1, TEXT) and sum(r.text == TEXT for r in found) == 1 and sum(not r.text for r in found) == 3
    if name == "line dedup":
        assert sum("enough" in (r.text or "") for r in found) == 2  # rows equal in id and text are one document
    if name == "decontamination":
        assert len(found) == len(rows)
