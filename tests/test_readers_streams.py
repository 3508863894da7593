import io
import zipfile

from pyspark.sql import functions as F

from textloom.operators.learner import word_status
from textloom.sources import markup, plain
from textloom.streaming import activity


def epub(extra=()):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></c>')
        z.writestr("O/p.opf", '<package xmlns="x"><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.xhtml", "<h1>One</h1><p>first <i>text</i></p>")
        z.writestr("O/b.xhtml", "<p>second</p>")
        for name, body in extra:
            z.writestr(name, body)
    return data.getvalue()


def test_epub_order_and_refusals(spark):
    rows = [("ok.epub", epub()), ("drm.epub", epub([("META-INF/rights.xml", "<r/>")])), ("bad.epub", b"nothing")]
    out = markup.epub_blocks(spark.createDataFrame(rows, "path string, content binary")).orderBy("path", "spine", "block").collect()
    assert [(r.spine, r.kind, r.text) for r in out if r.path == "ok.epub"] == [(0, "heading", "One"), (0, "para", "first text"), (1, "para", "second")]
    assert {r.path: r.reason for r in out if r.reason} == {"drm.epub": "drm", "bad.epub": "malformed"}


def test_html_blocks():
    got = markup.blocks_of("<html><head><title>x</title></head><body><h1>A &amp; B</h1><p>one <b>two</b><script>no</script> three<sup>1</sup></p><nav>menu</nav>tail")
    assert [(k, t) for k, _, t, _ in got] == [("heading", "A & B"), ("para", "one two three"), ("para", "menu"), ("para", "tail")]
    assert got[1][3] == [{"start": 4, "end": 7, "kind": "strong"}]


def test_plain_text(spark):
    text = "front\n\nГлава I\n\nline one\nline two\n\nnext\n\nII\n\nlast"
    out = plain.plain_text(spark.createDataFrame([(1, text)], "k int, text string"), "k").orderBy("chapter", "paragraph").collect()
    assert [(r.chapter, r.title, r.paragraph, r.text) for r in out] == [(0, None, 0, "front"), (1, "Глава I", 0, "line one line two"), (1, "Глава I", 1, "next"), (2, "II", 0, "last")]


def test_json_errors(spark):
    rows = [(1, '{"title": "t", "chapters": [{"title": "c", "paragraphs": ["a", {"kind": "note", "text": "b"}]}]}'), (2, "{nope"), (3, '{"title": "t", "chapters": []}')]
    out = markup.json_books(spark.createDataFrame(rows, "k int, text string"), "k").orderBy("k", "paragraph").collect()
    assert [(r.k, r.reason, r.kind, r.text) for r in out if r.k == 1] == [(1, None, "para", "a"), (1, None, "note", "b")]
    assert {r.k: r.reason for r in out if r.reason} == {2: "malformed", 3: "empty"}


def test_status_equals_the_fold(spark):
    import random

    rng = random.Random(3)
    log = [(k, t, t, rng.choice(["read"] * 5 + ["lookup"])) for k in range(40) for t in range(rng.randrange(1, 30))]
    want = {}
    for k, _, _, kind in log:
        want[k] = activity.advance(*want.get(k, (None, 0, 0)), kind, 4)
    got = word_status(spark.createDataFrame(log, "lexeme long, at long, event_id long, kind string"), "lexeme", 4).collect()
    assert {r.lexeme: (r.status, r.encounters, r.lookups) for r in got} == want


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 5, f"2024-01-01 0{i % 7}:10:00", ["view", "click"][i % 3 == 0]) for i in range(200)], "event_id long, user_id long, ts string, event_type string")
    e = e.withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, df in (("windows", activity.activity(stream, late="1 day")),):
        q = df.writeStream.outputMode("update").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, activity.activity(e).collect()))
    log = stream.select(F.col("user_id").alias("lexeme"), F.col("ts").alias("at"), "event_id", F.when(F.col("event_type") == "view", "read").otherwise("lookup").alias("kind"))
    q = activity.status_stream(log).writeStream.outputMode("update").format("memory").queryName("status").start()
    q.processAllAvailable()
    q.stop()
    batch = e.select(F.col("user_id").alias("lexeme"), F.col("ts").alias("at"), "event_id", F.when(F.col("event_type") == "view", "read").otherwise("lookup").alias("kind"))
    assert sorted(map(tuple, spark.table("status").collect())) == sorted(map(tuple, word_status(batch, "lexeme").select("lexeme", "status", "encounters", "lookups").collect()))


def test_late_events_are_applied_in_order(spark, tmp_path):
    """Three batches with events out of order, one long after the others to move the watermark; sessions and repeats as streams too."""
    import random

    rng = random.Random(7)
    start = 1_704_067_200
    log = [(k, start + 60 * rng.randrange(0, 50), 100 * k + n, rng.choice(["read"] * 5 + ["lookup"])) for k in range(12) for n in range(rng.randrange(1, 25))]
    rng.shuffle(log)
    schema = "lexeme long, s long, event_id long, kind string"
    parts = [log[::2], log[1::2] + log[:3], [(99, start + 86_400, 1, "read")], [(99, start + 2 * 86_400, 2, "read")]]
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, schema).select("lexeme", F.timestamp_seconds("s").alias("at"), "event_id", "kind")
        df.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    (tmp_path / "in").mkdir()
    files = [next((tmp_path / f"b{i}").glob("part-*.parquet")) for i in range(len(parts))]
    shape = spark.read.parquet(str(tmp_path / "b0")).schema

    def run(name, made, mode):
        q = made(spark.readStream.schema(shape).parquet(str(tmp_path / "in"))).writeStream.outputMode(mode).format("memory").queryName(name)
        q = q.option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        return q

    running = [
        run("late_status", lambda s: activity.ordered_status_stream(activity.once(s.withColumnRenamed("at", "ts")).withColumnRenamed("ts", "at"), None, 4), "update"),
        run("late_sessions", lambda s: activity.sessions(s.select(F.col("lexeme").alias("user_id"), F.col("at").alias("ts")), late="1 hour"), "append"),
    ]
    for i, f in enumerate(files):
        f.rename(tmp_path / "in" / f"{i}.parquet")
        for q in running:
            q.processAllAvailable()
    for q in running:
        q.stop()
    want = {}
    for k, _, _, kind in sorted(set(log), key=lambda r: (r[1], r[2])):
        want[k] = activity.advance(*want.get(k, (None, 0, 0)), kind, 4)
    got = {}
    for r in spark.table("late_status").collect():
        got[r.lexeme] = max(got.get(r.lexeme, (0, "")), (r.encounters + r.lookups, (r.status, r.encounters, r.lookups)))
    assert {k: v[1] for k, v in got.items() if k != 99} == want
    whole = spark.createDataFrame(log + log[:3], schema).select(F.col("lexeme").alias("user_id"), F.timestamp_seconds("s").alias("ts"))
    assert sorted(tuple(r) for r in spark.table("late_sessions").where("user_id <> 99").collect()) == sorted(map(tuple, activity.sessions(whole).collect()))
