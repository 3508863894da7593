"""Export and import: a round trip is the identity, and an import merges by key."""

import datetime

from textloom.operators import exports as E

SCHEMA = "id int, word string, score double, at timestamp, tags array<string>"
ROWS = [
    (1, "да", 0.1, datetime.datetime(2024, 1, 2, 3, 4, 5, 678), ["a", "b"]),
    (2, None, None, None, None),
    (3, "", -2.5e300, None, []),
    (None, "loose", 1.0, None, None),
]


def listed(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_round_trip(spark, tmp_path):
    a, b = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([(5, "x.y")], "n long, `odd.name` string")
    rows = E.export({"a": a, "b": b, "none": a.where("false")})
    E.write_export(rows, str(tmp_path / "out"))
    for found in (rows, E.read_export(spark, str(tmp_path / "out"))):
        assert listed(E.imported(found, "a", a.schema)) == listed(a)
        assert listed(E.imported(found, "b", b.schema)) == listed(b)
        assert E.imported(found, "none", a.schema).count() == 0


def test_import_into_itself_changes_nothing(spark):
    a = spark.createDataFrame(ROWS[:3], SCHEMA)
    once = E.import_all({"a": a}, E.export({"a": a}), {"a": ["id"]})["a"]
    assert listed(once) == listed(a) and once.columns == a.columns


def test_upsert_by_field_append_and_private(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, w string, n int")
    new = spark.createDataFrame([(1, None, 6), (3, "c", 1), (3, "c", 2), (None, "z", 0)], "k int, w string, n int")
    rows = E.export({"t": new, "log": new}, {"log": ["w"]})
    after = E.import_all({"t": old, "log": old, "rest": old}, rows, {"t": ["k"], "log": []})
    assert listed(after["t"]) == listed(spark.createDataFrame([(1, "a", 6), (2, "b", None), (3, "c", 2), (None, "z", 0)], old.schema))
    assert after["log"].count() == 6 and after["log"].where("w is null").count() == 4
    assert listed(after["rest"]) == listed(old)


def test_lines_that_cannot_be_read(spark, tmp_path):
    path = tmp_path / "out"
    path.mkdir()
    (path / "part-0.json").write_text('{"table": "t", "row": "{\\"k\\": 1, \\"w\\": 3}"}\n{"table": "t", "row": "{"}\nno json\n{"table": "t", "row": "{\\"k\\": \\"no\\", \\"w\\": \\"x\\"}"}\n')
    schema = spark.createDataFrame([], "k int, w string").schema
    assert listed(E.imported(E.read_export(spark, str(path)), "t", schema)) == listed(spark.createDataFrame([(1, "3"), (None, "x")], schema))
