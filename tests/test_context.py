"""Context rules over authored sentences; the expected choices are typed in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import context as X

CASES: dict = {}

#: Sentences: each token with its readings, best first, as lemma/pos/case/number/gender and flags.
SENTENCES = {
    1: "в=в/preposition/prep|в/preposition/acc доме=дом/noun/prep/sg/m",
    2: "к=к/preposition/dat старому=старый/adjective/dat/sg/m другу=друг/noun/acc/sg/m|друг/noun/dat/sg/m",
    3: "за=за/preposition/inst|за/preposition/acc час=час/noun/nom/sg/m|час/noun/acc/sg/m",
    4: "идёт=идти/verb////motion в=в/preposition/prep|в/preposition/acc лес=лес/noun/nom/sg/m|лес/noun/acc/sg/m",
    5: "для=для/preposition/gen старого=старый/adjective/acc/sg/m|старый/adjective/gen/sg/m друга=друг/noun/acc/sg/m|друг/noun/gen/sg/m",
    6: "высокого=высокий/adjective/gen/sg/m дома=дома/adverb|дом/noun/gen/sg/m",
    7: "всё=весь/pronoun/nom/pl//determinative|весь/pronoun/nom/sg/n/determinative все=весь/pronoun/nom/sg/n/determinative|весь/pronoun/nom/pl//determinative",
    8: "думал=думать/verb , что=что/pronoun/nom/sg/n|что/conjunction он=он/pronoun/nom/sg/m",
    9: "что=что/conjunction|что/pronoun/acc/sg/n он=он/pronoun/nom/sg/m",
    10: "более=более/adverb похожа=похожий/adjective , чем=что/pronoun/inst/sg/n|чем/conjunction стол=стол/noun/nom/sg/m",
    11: "не=не/particle читал=читать/verb книги=книга/noun/nom/pl/f|книга/noun/gen/sg/f",
    12: "боится=бояться/verb собаки=собака/noun/nom/pl/f|собака/noun/gen/sg/f",
    13: "три=три/numeral/nom стола=стол/noun/nom/pl/m|стол/noun/gen/sg/m пять=пять/numeral/nom столов=стол/noun/acc/pl/m|стол/noun/gen/pl/m один=один/numeral/nom стол=стол/noun/nom/sg/m",
    14: "ждёт=ждать/verb Костылина=?/noun/nom/sg/f",
    15: "в=в/preposition/prep|в/preposition/acc Москве=?/noun//sg/m",
    16: "стул=стул/noun/nom/sg/m|стул/noun/acc/sg/m видит=видеть/verb стол=стол/noun/nom/sg/m|стол/noun/acc/sg/m",
    17: "за=за/preposition/inst|за/preposition/acc ногу=нога/noun/acc/sg/f",
    18: "из=из/preposition/gen своей=свой/pronoun/dat/sg/f/possessive|свой/pronoun/gen/sg/f/possessive комнаты=комната/noun/nom/pl/f|комната/noun/gen/sg/f",
    19: "в=в/preposition/prep|в/preposition/acc жаркое=жаркое/noun/nom/sg/n|жаркий/adjective/acc/sg/n время=время/noun/nom/sg/n|время/noun/acc/sg/n",
    20: "Родя=Родион/noun/nom/sg/m|Родион/proper/nom/sg/m спит=спать/verb",
}


def _token(n: int, i: int, spec: str) -> list[tuple]:
    text, _, readings = spec.partition("=")
    if not readings:
        return [(n, i, "punct", text, 0, *[None] * 9, None)]
    out = []
    for k, r in enumerate(readings.split("|")):
        lemma, pos, case, number, gender, flag = ([*r.split("/"), *[""] * 5])[:6]
        guessed = lemma == "?"
        lemma = text.lower() if guessed else lemma
        kind = flag if flag in ("possessive", "demonstrative", "determinative") else None
        out.append((n, i, "word", text, k, ("?" if guessed else "") + f"{pos}:{lemma}", lemma, pos, case or None, number or None, gender or None, None, kind, flag == "motion", 0.4 if guessed else 1.0))
    return out


TOKENS = [row for n, s in SENTENCES.items() for i, spec in enumerate(s.split(" ")) for row in _token(n, i, spec)]
SCHEMA = "sentence_id int, i int, kind string, text string, k int, key string, lemma string, pos string, case string, number string, gender string, degree string, type string, motion boolean, confidence double"


def tokens(spark):
    """The sentences as rows of tokens with arrays of readings."""
    rows = spark.createDataFrame(TOKENS, SCHEMA)
    fields = ["key", "lemma", "pos", "case", "number", "gender", "degree", "type", "motion", "confidence"]
    rest = [F.lit(None).cast("string").alias(c) for c in ("verb_form", "tense", "aspect", "person", "reflexive", "motion_kind")]
    reading = F.when(F.col("kind") == "word", F.struct("k", F.struct(*fields, *rest).alias("c")))
    return rows.groupBy("sentence_id", "i", "kind", "text").agg(F.array_sort(F.collect_list(reading)).alias("r")).select("sentence_id", "i", "kind", "text", F.col("r.c").alias("cands"))


def query(name: str, expected: list[tuple], rules: list):
    """The choices that `rules` make: (sentence_id, i, lemma, pos, case, why)."""
    CASES[name] = (expected, rules)


_GOVERNED = [
    (1, 0, "в", "preposition", "prep", "governs prep"), (1, 1, "дом", "noun", "prep", "governed by в"), (2, 0, "к", "preposition", "dat", "governs dat"), (2, 2, "друг", "noun", "dat", "governed by к"),
    (3, 0, "за", "preposition", "acc", "governs acc"), (3, 1, "час", "noun", "acc", "governed by за"), (4, 1, "в", "preposition", "acc", "governs acc"), (4, 2, "лес", "noun", "acc", "governed by в"),
    (5, 0, "для", "preposition", "gen", "governs gen"), (5, 2, "друг", "noun", "gen", "governed by для"), (15, 0, "в", "preposition", "prep", "governs prep"), (17, 0, "за", "preposition", "acc", "governs acc"), (17, 1, "нога", "noun", "acc", "governed by за"),
    (18, 0, "из", "preposition", "gen", "governs gen"), (18, 2, "комната", "noun", "gen", "governed by из"), (19, 0, "в", "preposition", "acc", "governs acc"), (19, 2, "время", "noun", "acc", "governed by в"),
]
_AGREED = [(2, 1, "старый", "adjective", "dat", "agrees with другу"), (5, 1, "старый", "adjective", "gen", "agrees with друга"), (18, 1, "свой", "pronoun", "gen", "agrees with комнаты"), (19, 1, "жаркий", "adjective", "acc", "agrees with время")]
query("context_prepositions", _GOVERNED, [X.preposition_government])
query("context_agreement", _GOVERNED + _AGREED, [X.preposition_government, X.modifier_agreement])
query("context_noun_after_adjective", [(6, 1, "дом", "noun", "gen", "agrees with высокого"), (2, 2, "друг", "noun", "dat", "agrees with старому"), (5, 2, "друг", "noun", "acc", "agrees with старого")], [X.noun_after_adjective])
query("context_all_or_everything", [(7, 0, "весь", "pronoun", "nom", "neuter with ё"), (7, 1, "весь", "pronoun", "nom", "plural without ё")], [X.all_or_everything])
query("context_that_or_what", [(8, 2, "что", "conjunction", None, "reported clause"), (9, 0, "что", "pronoun", "acc", "pronoun"), (10, 3, "чем", "conjunction", None, "than")], [X.that_or_what])
query("context_negated_object", [(11, 2, "книга", "noun", "gen", "negated читал")], [X.negated_object])
query("context_verb_government", [(12, 1, "собака", "noun", "gen", "governed by боится")], [X.verb_government])
query("context_numerals", [(13, 1, "стол", "noun", "gen", "counted by три"), (13, 3, "стол", "noun", "gen", "counted by пять")], [X.numeral_government])
query("context_names", [(14, 1, "Костылин", "proper", "gen", "capitalised"), (15, 1, "Москва", "proper", "prep", "capitalised")], [X.capitalised_names])
query("context_word_order", [
    (3, 1, None, None, None, None), (4, 2, "лес", "noun", "acc", "after the verb"), (16, 0, "стул", "noun", "nom", "before the verb"), (16, 2, "стол", "noun", "acc", "after the verb"),
][1:], [X.word_order])
query("context_all_rules", [
    *_GOVERNED, *_AGREED, (6, 1, "дом", "noun", "gen", "agrees with высокого"), (7, 0, "весь", "pronoun", "nom", "neuter with ё"), (7, 1, "весь", "pronoun", "nom", "plural without ё"),
    (8, 2, "что", "conjunction", None, "reported clause"), (9, 0, "что", "pronoun", "acc", "pronoun"), (10, 3, "чем", "conjunction", None, "than"), (11, 2, "книга", "noun", "gen", "negated читал"),
    (12, 1, "собака", "noun", "gen", "governed by боится"), (13, 1, "стол", "noun", "gen", "counted by три"), (13, 3, "стол", "noun", "gen", "counted by пять"), (14, 1, "Костылин", "proper", "gen", "capitalised"),
    (15, 1, "Москва", "proper", "prep", "capitalised"), (16, 0, "стул", "noun", "nom", "before the verb"), (16, 2, "стол", "noun", "acc", "after the verb"),
], X.RULES)


@pytest.mark.parametrize("name", sorted(CASES))
def test_choices(spark, name):
    expected, rules = CASES[name]
    out, c = X.in_context(tokens(spark), rules).where("decided"), F.get("cands", F.col("chosen"))
    got = out.select("sentence_id", "i", c["lemma"], c["pos"], c["case"], "why").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
