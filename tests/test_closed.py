"""Readings of the closed classes and feature codes, typed in."""

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.closed import closed_classes
from textloom.operators.features import decode_features

ASKED = [(w,) for w in ("Мною", "ней", "моей", "нашего", "тем", "всё", "двух", "пятью", "сорока", "за", "что", "чтоб", "нельзя", "Были", "дом", "ни")]
ANSWERS = [
    ("Мною", "pronoun:я", "case=inst;number=sg;person=1;pronoun_type=personal"), *[("ней", "pronoun:она", f"case={c};gender=f;number=sg;person=3;pronoun_type=personal") for c in ("dat", "inst", "prep")],
    *[("моей", "pronoun:мой", f"case={c};gender=f;number=sg;pronoun_type=possessive") for c in ("gen", "dat", "inst", "prep")], *[("нашего", "pronoun:наш", f"case=gen;gender={g};number=sg;pronoun_type=possessive") for g in "mn"],
    ("тем", "pronoun:тот", "case=inst;gender=m;number=sg;pronoun_type=demonstrative"), ("тем", "pronoun:тот", "case=inst;gender=n;number=sg;pronoun_type=demonstrative"), ("тем", "pronoun:тот", "case=dat;number=pl;pronoun_type=demonstrative"),
    *[("всё", "pronoun:весь", f"case={c};gender=n;number=sg;pronoun_type=determinative") for c in ("nom", "acc")], *[("всё", "pronoun:весь", f"case={c};number=pl;pronoun_type=determinative") for c in ("nom", "acc")],
    ("двух", "numeral:два", "case=gen"), ("пятью", "numeral:пять", "case=inst"), *[("сорока", "numeral:сорок", f"case={c}") for c in ("gen", "dat", "inst", "prep")], ("за", "preposition:за", "case=inst"), ("за", "preposition:за", "case=acc"),
    ("что", "conjunction:что", ""), *[("что", "pronoun:что", f"case={c};number=sg;pronoun_type=interrogative/relative") for c in ("nom", "acc")], ("чтоб", "conjunction:чтобы", ""), ("нельзя", "predicative:нельзя", ""),
    ("Были", "verb:быть", "aspect=imperfective;number=pl;tense=past;verb_form=past"), ("ни", "conjunction:ни", ""), ("ни", "particle:ни", ""),
]


def test_closed_class_readings(spark):
    words = spark.createDataFrame(ASKED, "surface string").withColumn("w", T.loose_key(F.col("surface")))
    got = words.join(closed_classes(spark), F.col("w") == F.col("form")).select("surface", "key", "features").collect()
    assert sorted(map(tuple, got)) == sorted(ANSWERS)


DECODED = [
    ("n:sg:gen", "sg", "gen", None, None, None, None), ("n:pl:inst", "pl", "inst", None, None, None, None), ("a:m:sg:nom", "sg", "nom", "m", None, None, None), ("a:pl:gen", "pl", "gen", None, None, None, None),
    ("a:short:f", "sg", None, "f", None, None, "short"), ("a:short:pl", "pl", None, None, None, None, "short"), ("a:comp", None, None, None, None, None, "comparative"), ("a:sup", None, None, None, None, None, "superlative"),
    ("v:inf", None, None, None, None, "infinitive", None), ("v:pf:sg1", "sg", None, None, 1, "present-future", None), ("v:pf:pl3", "pl", None, None, 3, "present-future", None), ("v:past:m", "sg", None, "m", None, "past", None),
    ("v:past:pl", "pl", None, None, None, "past", None), ("v:imp:sg", "sg", None, None, None, "imperative", None), ("p:1:sg:nom", "sg", "nom", None, 1, None, None), ("x", None, None, None, None, None, None),
]


def test_feature_codes(spark):
    codes = spark.createDataFrame([(r[0],) for r in DECODED], "code string").coalesce(1)
    assert [tuple(r) for r in codes.select("code", decode_features(F.col("code")).alias("d")).select("code", "d.*").collect()] == DECODED
