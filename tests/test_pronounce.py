"""Pronunciation: known words, and a plain walk over letters from right to left."""

import random

from pyspark.sql import functions as F

from textloom.functions import pronounce as P

CASES = [
    ("молоко", 5, "malako", "[məlɐko]", 1.0, ["о unstressed → [ə]", "о before the stress → [ɐ]"]), ("хорошо", 5, "kharasho", "[xərɐʂo]", 1.0, ["о unstressed → [ə]", "о before the stress → [ɐ]"]),
    ("его", 2, "yevo", "[jɪvo]", 1.0, ["е unstressed → [ɪ]", P.OGO_NOTE]), ("что", 2, "shto", "[ʂto]", 0.9, ["что" + P.SHTO_NOTE]), ("учиться", 2, "uchitsa", "[utɕitsə]", 1.0, [P.TSA_NOTE]),
    ("сад", 1, "sat", "[sat]", 1.0, ["final д devoiced → [t]"]), ("вход", 2, "fkhot", "[fxot]", 1.0, [P.V_NOTE, "final д devoiced → [t]"]),
    ("Достоевский", 5, "dastayefskiy", "[dəstɐjefskʲij]", 1.0, ["о unstressed → [ə]", "о before the stress → [ɐ]", P.V_NOTE]), ("молоко", -1, "moloko", "[moloko]", 0.7, [P.UNKNOWN_STRESS]),
    ("конечно", 3, "kaneshna", "[kɐnʲeʂnə]", 0.9, ["о before the stress → [ɐ]", P.SHN_NOTE, "о unstressed → [ə]"]), ("бог", 1, "bokh", "[box]", 1.0, [P.GOD_NOTE]),
    ("", -1, "", "[]", 0.7, [P.UNKNOWN_STRESS]), ("сдача", 2, "zdacha", "[zdatɕə]", 1.0, ["с assimilates in voicing to the next consonant → [z]", "а unstressed → [ə]"]),
    ("кость", 1, "kost", "[kostʲ]", 1.0, []),
]


def test_known_words(spark):
    df = spark.createDataFrame([(w, s) for w, s, *_ in CASES], "w string, s int").coalesce(1)
    got = df.select(P.pronounce(F.col("w"), F.col("s")).alias("p")).select("p.*").collect()
    for (word, *want), r in zip(CASES, got, strict=True):
        assert [r.translit, r.ipa, r.confidence, r.notes] == want[1:], word
    assert df.limit(1).select(P.pronounce(F.lit(None).cast("string"), F.lit(0)).alias("p")).first().p is None


def plain_signs(word):
    """Voicing by walking back, the rule as it reads."""
    out, asked, last = [], None, True
    for ch in reversed(word):
        sign = "."
        if ch in P.SILENT:
            out.append(sign)
            continue
        if ch in P.OBSTRUENTS:
            asked = sign = asked or ("+" if ch in P.VOICED and not last else "-")
        elif ch == "в":
            sign, asked = "-" if asked == "-" else "+", None
        elif ch in P.VOWELS + P.SONORANTS:
            asked = None
        last = False
        out.append(sign)
    return "".join(reversed(out))


def test_voicing_equals_a_plain_walk(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("абвгдзжкпстфхцчшщйлмнрьъео-ѣ") for _ in range(rng.randrange(1, 12))) for _ in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1)
    assert [r[0] for r in df.select(P.voicing(F.split("w", ""))).collect()] == [plain_signs(w) for w in words]
