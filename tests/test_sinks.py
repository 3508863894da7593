import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import sinks


def test_books_are_written_once(spark, tmp_path):
    folder = str(tmp_path)
    books = spark.createDataFrame([(1, "h1", "A"), (2, "h2", "B"), (3, "h1", "C")], "book_id long, content_hash string, title string")
    schema = "idx int, title string, book_id long"
    chapters = spark.createDataFrame([(0, "x", 1), (1, "y", 1), (0, "z", 2), (0, "w", 3)], schema)
    refused = sinks.write_books(spark, folder, books, {"chapters": chapters})
    assert [(r.book_id, r.reason) for r in refused.collect()] == [(3, "duplicate")]
    again = spark.createDataFrame([(9, "h2", "B")], books.schema)
    assert [r.book_id for r in sinks.write_books(spark, folder, again, {"chapters": chapters}).collect()] == [9]
    sinks.append_chapters(spark, folder, 1, spark.createDataFrame([(0, "more")], "idx int, title string"), schema)
    got = sorted((r.book_id, r.idx, r.title) for r in spark.read.parquet(f"{folder}/chapters").collect())
    assert got == [(1, 0, "x"), (1, 1, "y"), (1, 2, "more"), (2, 0, "z")]
    assert sorted(r.title for r in spark.read.parquet(f"{folder}/books").collect()) == ["A", "B"]


def test_analyses_by_version(spark):
    old = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, False), (2, "c", 1, False)], "chapter int, key string, version int, superseded boolean")
    new = spark.createDataFrame([(1, "n")], "chapter int, key string")
    kept = sorted(map(tuple, sinks.write_analyses(old, new, ["chapter"]).collect()))
    assert kept == [(1, "a", 1, True), (1, "b", 2, True), (1, "n", 3, False), (2, "c", 1, False)]
    forced = sorted(map(tuple, sinks.write_analyses(old, new, ["chapter"], F.col("chapter") == 1).collect()))
    assert forced == [(1, "a", 1, True), (1, "n", 2, False), (2, "c", 1, False)]


def test_a_write_that_ended_between_two_tables_is_run_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    books = spark.createDataFrame([(1, "h1", "A"), (2, "h2", "B")], "book_id long, content_hash string, title string")
    chapters = spark.createDataFrame([(0, "x", 1), (1, "y", 1), (0, "z", 2)], "idx int, title string, book_id long")
    notes = spark.createDataFrame([("n", 1)], "note string, book_id long")
    whole = sinks.overwrite_partitions

    def ends(rows, path, keys):
        if path.endswith("/notes"):
            raise RuntimeError("killed")
        whole(rows, path, keys)

    monkeypatch.setattr(sinks, "overwrite_partitions", ends)
    with pytest.raises(RuntimeError):
        sinks.write_books(spark, folder, books, {"chapters": chapters, "notes": notes})
    assert sinks.read_table(spark, folder, "books", "book_id long").count() == 0
    monkeypatch.setattr(sinks, "overwrite_partitions", whole)
    for _ in range(2):
        assert sinks.write_books(spark, folder, books, {"chapters": chapters, "notes": notes}).count() == 0
        assert sorted((r.book_id, r.title) for r in spark.read.parquet(f"{folder}/chapters").collect()) == [(1, "x"), (1, "y"), (2, "z")]
        assert spark.read.parquet(f"{folder}/books").count() == 2
    for _ in range(2):
        sinks.delete_books(spark, folder, books.where("book_id = 1"), ["chapters", "notes"])
        assert [r.title for r in spark.read.parquet(f"{folder}/books").collect()] == ["B"]
        assert [r.title for r in spark.read.parquet(f"{folder}/chapters").collect()] == ["z"]


def test_analyses_are_rewritten_in_place(spark, tmp_path):
    folder, schema = str(tmp_path), "key string, tag string, version int, superseded boolean, chapter int"
    first = spark.createDataFrame([(1, "a", "r1"), (2, "c", "r1")], "chapter int, key string, tag string")
    second = spark.createDataFrame([(1, "b", "r2")], first.schema)
    for new in (first, first, second, second):
        sinks.rewrite_analyses(spark, folder, schema, new, ["chapter"])
    got = sorted((r.chapter, r.key, r.version, r.superseded) for r in spark.read.parquet(f"{folder}/analyses").collect())
    assert got == [(1, "a", 1, True), (1, "b", 2, False), (2, "c", 1, False)]


def test_shards_are_bounded_and_a_lookup_reads_one(spark, tmp_path):
    keys = ["д", "до", "дом", "дома", "домик", "Ёлка", "ёлки", "кот", "кота", "котик", "который"] + [f"дом{a}{b}" for a in "абвг" for b in "деж"]
    index = spark.createDataFrame([(k, f"n:{i}") for i, k in enumerate(keys)], "key string, code string")
    path, limit = str(tmp_path / "s"), 130
    prefixes = {r.shard: r for r in sinks.write_shards(index, path, limit).collect()}
    sizes = {}
    for r in spark.read.parquet(f"{path}/forms").collect():
        sizes.setdefault(r.shard, []).append(r.key)
    assert set(sizes) == set(prefixes) and sum(len(v) for v in sizes.values()) == len(keys)
    for shard, held in sizes.items():
        assert len(held) == 1 or prefixes[shard].bytes <= limit or len(shard) == sinks.DEPTH
        assert all(k.lower().replace("ё", "е").startswith(shard.rstrip("$")) for k in held)
    assert {"д$", "до$"} <= set(sizes)
    for k in ("дом", "елка", "котик", "нет"):
        found = sinks.read_shards(spark, path, [k])
        assert sorted(r.key for r in found.collect()) == sorted(x for x in keys if x.lower().replace("ё", "е") == k)
        assert len(found.inputFiles()) >= 0 and len({r.shard for r in found.collect()}) <= 1


def test_corpus_and_report(spark, tmp_path):
    works = spark.createDataFrame([("a", "A", True), ("b", "B", False)], "slug string, title string, has_english boolean")
    listed = sinks.write_corpus(works, spark.createDataFrame([("b",)], "slug string"), str(tmp_path / "c"))
    assert sorted(map(tuple, listed.collect())) == [("a", "A", False), ("b", "B", True)]
    assert sorted(r.title for r in spark.read.json(str(tmp_path / "c/works")).collect()) == ["A", "B"]
    sinks.write_report(listed.groupBy("has_english").count(), str(tmp_path / "r"))
    lines = [json.loads(x) for f in (tmp_path / "r").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 2


def test_html_without_end_tags():
    from textloom.sources.markup import blocks_of

    assert [b[2] for b in blocks_of("<html><head><title>T</title><p>one<p>two")] == ["one", "two"]
    assert [(b[0], b[2]) for b in blocks_of("<ul><li>a<ul><li>b</ul><li>c</ul>")] == [("para", "a"), ("para", "b"), ("para", "c")]
