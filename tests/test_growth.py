"""Plans that must stay lean: what a large corpus pays for each token."""

import pandas as pd
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import context as X
from textloom.operators import segment as S
from textloom.sources import markup as M


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_of_forms_stay_above_the_counting(spark):
    docs = spark.createDataFrame([("Кот и кот",)], "text string")
    counted = S.surface_counts(docs, []).where("kind = 'word'").where(F.upper(T.loose_key(F.col("surface"))).contains("К"))
    plan = optimized(counted)
    assert plan.index("upper") < plan.index("Aggregate") and "upper" not in plan[plan.index("Aggregate") :]
    assert sorted(counted.select("surface", "n").collect()) == [("Кот", 1), ("кот", 1)]


def test_a_text_is_cut_into_pieces_once(spark):
    docs = spark.createDataFrame([(1, "One. Two")], "doc_id int, text string")
    assert optimized(S.sentences(docs, ["doc_id"])).count("regexp_extract_all(text") == 1


def test_long_runs_of_punctuation_end_sentences_alike(spark):
    texts = {}
    for n in (3, S.LOOK - 1, S.LOOK, S.LOOK + 1, 500):
        for end in (" B", " b", "", ' "b', "\n B."):
            texts[len(texts)] = "A." + ", " * n + end
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    found = {i: n for i, n in S.sentences(docs, ["doc_id"]).groupBy("doc_id").agg(F.max("sentence") + 1).collect()}
    assert [found[i] for i in texts] == [2, 1, 2, 1, 2] * 5


def test_keys_kinds_and_letters(spark):
    words = ["Чтò", "бо́льшая", "ОБЪ", "объ", "Ёж", "don`t", "`", "Ñandú", "İ", "ъ", "xъ", "Щука", "жЖ", "Ѳома", "ỳ", "ѝ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select(T.loose_key(F.col("w")), T.transliterate(F.col("w"))).collect()
    assert [r[0] for r in got[:6]] == ["что", "большая", "об", "об", "еж", "don't"] and [r[0] for r in got[9:11]] == ["ъ", "x"]
    assert [r[1] for r in got[11:14]] == ["Shchuka", "zhZh", "Foma"] and got[0][1] == "Chto" and got[1][1] == "bolshaya".replace("l", "l'")
    starts = {"я": "word", "́а": "word", "ɏ": "latin", "ɐ": "punct", "×": "latin", "7": "number", "　": "space", "​": "punct", "٣": "punct", "\u0085": "punct", "": "punct"}
    df = spark.createDataFrame([(s,) for s in starts], "s string")
    assert {s: k for s, k in df.select("s", T.kind(F.col("s"))).collect()} == starts


def test_blocks_of_pages_leave_in_bounded_frames():
    pages = pd.DataFrame({"k": range(5000), "h": ["<p>a</p><p>b</p>"] * 5000})
    frames = list(M.block_frames(iter([pages])))
    assert max(map(len, frames)) <= M.FRAME_BLOCKS + 2 and sum(map(len, frames)) == 10_000
    assert [f["k"].iloc[0] for f in frames] == [0, 2048, 4096]


def test_context_carries_single_neighbours_and_no_frame_to_the_end_of_a_sentence(spark):
    """A list of neighbours a token and rule, or a frame that is summed again for each row, made whole sentences time out."""
    plan = optimized(X.in_context(spark.createDataFrame([], f"sentence_id int, i int, kind string, text string, cands array<{X.READING}>")))
    assert plan.count("collect_list") == 2  # of prepositions and of their nouns alone
    assert "$(), -1)" in plan and "1, unboundedfollowing$()" not in plan
