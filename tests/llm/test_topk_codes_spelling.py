"""The searches, vector codes and spelling variants against plain versions, and on odd rows."""

import hashlib
import os
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import queries as Q
from textloom.llm.codes import vector_codes
from textloom.llm.spelling import Trie, one_edit, spelling_variants
from textloom.llm.topk import top_matches

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"
ODD = [
    (100, [1.0, 0.5, 0.0], 1), (100, [1.0, 0.5, 0.0], 1), (200, [0.0, 0.0, 0.0], 2), (1, None, 1), (2, [None, 1.0, 1.0], 1), (3, [float("nan"), 1.0, 1.0], 1), (4, [float("inf"), 0.0, 0.0], 1),
    (None, [0.5, 0.5, 0.5], None), (5, [2.0], None), (6, [], 3), (7, [1.0, 0.5, 0.0], None), (8, [-3.0, 7.25, -0.001], 1), (300, [0.001, -0.001, 5.0, 9.0], 2),
]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]


def floors(rows, scale):
    return [[int(np.floor(scale * x)) for x in r[1]] for r in usable(rows)]


def plain_topk(rows, k):
    good, w = usable(rows), floors(rows, 1024)
    out = []
    for i, r in enumerate(good):
        if r[0] is None or r[0] % 100:
            continue
        found = [(-sum(a * b for a, b in zip(w[i], w[j], strict=False)), good[j][0] is None, good[j][0] or 0) for j in range(len(good)) if j != i]
        out += [(r[0], n + 1, None if null else v, -s) for n, (s, null, v) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


def plain_codes(rows, parts, entries, rounds):
    good = sorted(zip(usable(rows), floors(rows, 256), strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[1]))
    width = max(1, -(-max(len(w) for _, w in good) // parts)) * parts
    x = np.array([w + [0] * (width - len(w)) for _, w in good], object).reshape(len(good), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]

    def nearest():
        return [[min((sum((x[i, p] - e) ** 2), j) for j, e in enumerate(books[p])) for p in range(parts)] for i in range(len(x))]

    for _ in range(rounds):
        at = nearest()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [x[i, p] for i in range(len(x)) if at[i][p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = nearest()
    errors = [sum(d for d, _ in row) for row in at]
    labels = Counter()
    for (r, _), e in zip(good, errors, strict=True):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(str((r[0], "".join(f"{j:02x}" for _, j in row), e, labels[r[2]], digest)) for (r, _), row, e in zip(good, at, errors, strict=True))


def plain_variants(docs, least=5, count=3, one_in=97):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in string.ascii_uppercase else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in total.items() if n >= count and len(w) >= least}
    edits = lambda a, b: a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or any(a == b[:i] + b[i + 1 :] for i in range(len(b))) and len(a) + 1 == len(b))
    near = {w: [v for v in words if edits(w, v) or edits(v, w)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(str((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None)) for w, n in words.items())


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("block, asking", [(2048, 4096), (3, 2)])
def test_topk_on_odd_rows(spark, block, asking):
    df = spark.createDataFrame(ODD, VECTORS).repartition(3)
    for extra in ([], ["row", "block", "w", "asks"]):
        named = df.select("*", *[F.lit("own").alias(c) for c in extra])
        assert told(top_matches(named, F.col("vec_id") % 100 == 0, 4, 1024, block, asking)) == plain_topk(ODD, 4)
    assert top_matches(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_with_ties_and_large_products(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(6)], 0) for i in range(400)] + [(401, [2.0**19] * 6, 0), (500, [-(2.0**18), 1.5, 2.0**21, 0.0, 1.0, 1.0], 0)]
    assert told(top_matches(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, 10, 1024, 64, 3)) == plain_topk(rows, 10)


@pytest.mark.parametrize("parts, entries, rounds", [(2, 3, 2), (16, 64, 2), (1, 1, 0)])
def test_codes_on_odd_rows(spark, parts, entries, rounds):
    df = spark.createDataFrame(ODD, VECTORS).repartition(3)
    for extra in ([], ["row", "w", "code", "low", "of_label"]):
        named = df.select("*", *[F.lit("own").alias(c) for c in extra])
        assert told(vector_codes(named, parts, entries, rounds)) == plain_codes(ODD, parts, entries, rounds)
    assert vector_codes(df.limit(0)).count() == 0


def test_codes_over_many_rounds_with_ties_and_large_components(spark):
    """Small whole numbers give many ties; large ones leave the exact range of doubles."""
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-3, 4) / 256 for _ in range(8)], i % 3) for i in range(300)]
    assert told(vector_codes(spark.createDataFrame(rows, VECTORS), 2, 20, 6)) == plain_codes(rows, 2, 20, 6)
    rows = [(i, [rng.uniform(-65000, 65000) for _ in range(64)], None) for i in range(120)]
    assert told(vector_codes(spark.createDataFrame(rows, VECTORS), 2, 10, 3)) == plain_codes(rows, 2, 10, 3)


def test_tries_find_all_words_one_edit_apart():
    rng = random.Random(3)
    made = sorted({bytes(rng.choice(b"ab\xe9") for _ in range(rng.randrange(1, 9))) for _ in range(900)} | {b"a" * 400, b"a" * 401, b"a" * 399 + b"b"})
    for words in (made, made[:1], made[:2]):
        trie = Trie.unpacked(*Trie.of(words, [1] * len(words)).packed())
        for w in [*words, b"ab", b"zz", b"a" * 402]:
            assert trie.near(w) == {i for i, v in enumerate(words) if one_edit(w, v)}


DOCS = [
    (1, "Colour COLOUR colour color color color color color color colors"), (2, None), (3, ""), (None, "colour colours colours colours"), (1, "Colour COLOUR colour color color color color color color colors"),
    (4, "Straße straße straße strasse déjàvu déjàvu déjavu déjavu déjavu École école École ábcde caféś ab Жаба"),
    (5, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5000 + " " + ("x" * 5001 + " ") * 7), (6, "nation\nnotion\tnation notion nation notion station " * 9),
]


@pytest.mark.parametrize("shard, room", [(50_000, 1 << 24), (3, 100)])
def test_spelling_on_odd_rows(spark, shard, room):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    for one_in in (97, 2):
        named = df.select("*", *[F.lit("own").alias(c) for c in ("word", "n", "form", "root", "of")])
        assert told(spelling_variants(named, one_in=one_in, shard_words=shard, broadcast_bytes=room)) == plain_variants(DOCS, one_in=one_in)
    assert spelling_variants(df.limit(0)).count() == 0


def test_long_chains_of_forms(spark):
    """Each word has twice the count of the next, one letter apart."""
    words = ["a" * i + "b" * (16 - i) for i in range(11)]
    docs = [(i, " ".join([w] * (3 << i))) for i, w in enumerate(words)]
    assert told(spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), one_in=1 << 40)) == plain_variants(docs, one_in=1 << 40)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_vector_codes", "op13_spelling_variants"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert told(Q.queries()[name](spark, SF).select(cols)) == sorted(str(r) for r in want.fetchall())
