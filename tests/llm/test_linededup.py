import random

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.linededup import allowed_edits, dedup_lines, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12), st.integers(0, 3))
def test_within_equals_dynamic_programme(a, b, k):
    assert within(a, b, k) == (distance(a, b) <= k)


def brute(rows, k=2):
    """Kept lines of each document by comparing all wordings."""
    first = {}
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0]))
    for d, t in docs:
        for i, line in enumerate(t.split("\n")):
            if len(line) >= 10:
                first.setdefault(line, ((d is None, d), i))
    late = set()
    for a, at in first.items():
        for b, bt in first.items():
            n = allowed_edits(min(len(a), len(b)), k)
            if n and at > bt and abs(len(a) - len(b)) <= n and distance(a, b) <= n:
                late.add(a)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        kept = [x for i, x in enumerate(t.split("\n")) if len(x) < 10 or x not in late and first[x] == ((d is None, d), i)]
        out.append((d, "\n".join(kept), len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([5, 12, 21, 30, 45, 70]))) for _ in range(12)]

    def variant():
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            p = rng.randrange(len(s) + 1)
            s[p : p + rng.choice([0, 1])] = rng.choice(["", "x", "é"])
        return "".join(s)

    rows = [(i, "\n".join(variant() for _ in range(rng.randrange(1, 8)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "q" * 300), (104, "q" * 300 + "z"), (None, base[3] + "\nown line of null"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in dedup_lines(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_dropped string, key int, gone_doc int, gone_lines int, row int"
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0
    out = dedup_lines(spark.createDataFrame([(1, "a repeated line\na repeated line", "x", 1, 2, 3, 4)], schema)).collect()
    assert [(r.text, r.n_dropped, r.key, r.row) for r in out] == [("a repeated line", 1, 1, 4)]


def test_families_of_variants_equal_brute_force(spark):
    """Lines of which many share a segment: a base with its variants, and variants of a base that is not there."""
    rng = random.Random(8)
    rows = []
    for f in range(3):
        base = "".join(rng.choice("abcdefgh ") for _ in range(60))
        for _ in range(60):
            s = list(base)
            for _ in range(2 if f else rng.randrange(3)):
                s[rng.randrange(20 * (f == 2), 60)] = rng.choice("uvwxyz")
            rows.append((len(rows), "".join(s)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in dedup_lines(docs).collect()), key=str) == brute(rows)
