"""Drills against what each must hold."""

from textloom.operators import drills as D
from textloom.plans.drills import CONFUSABLE, CONTRASTS, INVENTORY


def test_word_drills_hold_their_answer_and_others(spark, monkeypatch):
    monkeypatch.setattr(D, "BUCKET", 8)
    rows = [(f"сло{chr(0x430 + i % 26)}{chr(0x430 + i // 26)}", f"slo{i // 2}") for i in range(200)] + [("сло", None), (None, "x"), ("слоаа", "slo0")]
    found = D.word_drills(spark.createDataFrame(rows, "word string, translit string")).collect()
    words = [r for r in found if r.mode == "word"]
    assert len([r for r in found if r.mode == "cursive"]) == 200 and len(words) > 150
    for r in words:
        assert r.answer in r.options and len(set(r.options)) == len(r.options) and 3 <= len(r.options) <= 4
        assert r.symbols == "".join(dict.fromkeys(r.word.upper()))


def test_few_words_have_no_drill_of_sounds(spark):
    found = D.word_drills(spark.createDataFrame([("а", "a"), ("о", "o")], "word string, translit string"))
    assert sorted(r.mode for r in found.collect()) == ["cursive", "cursive"]
    none = spark.createDataFrame([], "word string, translit string")
    assert D.word_drills(none).count() == 0


def test_letter_drills(spark):
    letters, hard, pairs = INVENTORY.df(spark), CONFUSABLE.df(spark), CONTRASTS.df(spark)
    assert letters.count() == 33
    known = [(1, c) for c in "АОУЕЭШЩЪ"] + [(1, "А"), (2, "Ш"), (None, "А"), (3, "Q"), (3, None)]
    found = D.letter_drills(spark.createDataFrame(known, "learner int, symbol string"), letters, hard, pairs).collect()
    kind = {r.symbol: r.kind for r in letters.collect()}
    assert {r.learner for r in found} == {1, 2}
    for r in found:
        assert r.answer in r.options and len(set(r.options)) == len(r.options)
        if r.mode in ("sound_to_symbol", "visual"):
            assert {kind[o] for o in r.options} == {kind[r.symbol]} and 3 <= len(r.options) <= 4
    modes = lambda learner, symbol: {r.mode for r in found if r.learner == learner and r.symbol == symbol and r.mode != "contrast"}
    assert modes(1, "А") == {"symbol_to_sound", "sound_to_symbol", "visual"}
    assert modes(1, "Ъ") == set()
    assert modes(1, "Ш") == {"visual"}  # only one other consonant is known
    assert "Щ" in next(r.options for r in found if r.learner == 2 and r.mode == "sound_to_symbol")
    assert sorted((r.learner, r.symbol, set(r.options) == {"Ш", "Щ"}) for r in found if r.mode == "contrast") == [(1, "Е", False), (1, "О", False), (1, "Ш", True)]
    assert D.letter_drills(spark.createDataFrame([], "learner int, symbol string"), letters, hard, pairs).count() == 0
