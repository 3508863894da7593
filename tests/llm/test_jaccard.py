import random

import pytest

from textloom.llm.jaccard import jaccard_components


def brute(rows):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for ws in "\t\n\x0b\x0c\r":
            w = w.replace(ws, " ")
        w = [x for x in w.split(" ") if x]
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE two"), (5, "one two three"), (6, "é É ß"), (7, "é é ß")]
    base = [f"w{rng.randrange(300)}" for _ in range(140)]
    for _ in range(120):  # a loose group: links between some of its members only
        rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 7])))))
    for _ in range(60):  # unrelated texts that share a passage
        own = [f"u{rng.randrange(5000)}" for _ in range(rng.randrange(10, 90))]
        rows.append((len(rows), " ".join(own[:5] + passage + own[5:])))
    rows += [(len(rows) + k, rows[10][1]) for k in range(30)]
    rows.append((len(rows), " ".join(f"long{rng.randrange(10**6)}" for _ in range(30_000))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("region", [400_000, 3_000])
def test_components_equal_brute_force(spark, corpus, region):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in jaccard_components(docs, region_shingles=region).collect()}
    assert got == brute(corpus)


def test_empty_table_nulls_and_extra_columns(spark):
    schema = "doc_id long, text string, component_id string, row int, x int"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a b c d e f", "q", 1, 1), (7, "a b c d e f", "q", 1, 1), (9, "A b c d e f", None, None, None), (None, "a b c d e f", "z", 1, 1), (11, None, "z", 1, 1)]
    got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (9, 2, 7), (None, 2, None), (11, 0, 11)], key=str)


def test_several_texts_under_one_doc_id(spark):
    a, b, c = ([f"{c}{i}" for i in range(80)] for c in "abc")
    t = lambda w, k: " ".join(w[:k])
    rows = [(1, t(a, 80)), (1, t(b, 80)), (2, t(b, 75)), (3, t(a, 76)), (4, ""), (4, t(c, 40) + " 4"), (5, ""), (5, t(c, 40) + " 5"), (6, "z " * 9)]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 5), (6, 6)}


def test_windows_and_rounds_equal_brute_force(spark):
    """A tight group, a loose one, and texts that share a long passage, through all rounds."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(60)]
        for k in range(25):
            rows.append((len(rows), " ".join(edited(rng, base + (passage if k % 3 else []), k % 9))))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for region in (500, 20_000):
        assert {tuple(r) for r in jaccard_components(docs, region_shingles=region).collect()} == brute(rows)
