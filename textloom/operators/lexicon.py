"""Lexicon build and word analysis as relational steps: unpivot, index, fallback joins, rules by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def paradigm_cells(df: DataFrame, keys: list[str], slots: list[str]) -> DataFrame:
    """Wide paradigm tables as rows (keys, slot, cell); empty cells fall away."""
    return df.unpivot(keys, slots, "slot", "cell").where("cell is not null and trim(cell) <> ''")


def form_index(cells: DataFrame, code: dict[str, str]) -> DataFrame:
    """Inverted index (key, lexeme_id, code, stress) of all alternatives of all cells, each reading once."""
    table = F.create_map(*[F.lit(x) for kv in code.items() for x in kv])
    alternative = cells.select("lexeme_id", F.element_at(table, F.col("slot")).alias("code"), F.explode(T.split_list(F.col("cell"), ",")).alias("form"))
    split = alternative.withColumn("a", T.split_accent(F.col("form")))
    return split.select(T.loose_key(F.col("a.form")).alias("key"), "lexeme_id", "code", F.col("a.stress").alias("stress")).distinct()


def with_citation_forms(index: DataFrame, lexemes: DataFrame) -> DataFrame:
    """The index with the lemma itself for lexemes that have no cell."""
    bare = lexemes.join(index.select("lexeme_id").distinct(), "lexeme_id", "left_anti")
    return index.unionByName(bare.select(T.loose_key(F.col("lemma")).alias("key"), "lexeme_id", F.lit("x").alias("code"), F.lit(-1).alias("stress")))


def ranks(lexemes: DataFrame, frequency: DataFrame) -> DataFrame:
    """Frequency rank by exact lemma, else with ё written as е."""
    first = frequency.groupBy("word").agg(F.min("rank").alias("rank"))
    exact, folded = first.select(F.col("word").alias("w1"), F.col("rank").alias("r1")), first.select(F.col("word").alias("w2"), F.col("rank").alias("r2"))
    out = lexemes.join(exact, F.col("lemma") == F.col("w1"), "left").join(folded, F.translate("lemma", "ё", "е") == F.col("w2"), "left")
    return out.withColumn("rank", F.coalesce("r1", "r2")).drop("w1", "w2", "r1", "r2")


def partners(lexemes: DataFrame) -> DataFrame:
    """The id of the lexeme a partner lemma names: of the same part of speech, the first seen."""
    first = lexemes.groupBy(F.col("pos").alias("p_pos"), F.col("lemma").alias("p_lemma")).agg(F.min_by("lexeme_id", "src").alias("partner_id"))
    return lexemes.join(first, (F.col("pos") == F.col("p_pos")) & (F.col("partner") == F.col("p_lemma")), "left").drop("p_pos", "p_lemma")


def apply_overrides(lexemes: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """Lexemes with patches laid over them and the dropped ones gone."""
    o = overrides.select(F.col("lexeme_id").alias("__id"), F.coalesce("drop", F.lit(False)).alias("__drop"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = lexemes.join(o, F.col("lexeme_id") == F.col("__id"), "left").where("not coalesce(__drop, false)")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop("__id", "__drop", *[f"__{f}" for f in fields])


def stems(cells: DataFrame) -> DataFrame:
    """Longest common beginning of a lexeme's cells: that of the least and the greatest, no list of cells needed."""
    low = cells.groupBy("lexeme_id").agg(F.min(F.lower("cell")).alias("lo"), F.max(F.lower("cell")).alias("hi"))
    n = F.least(F.length("lo"), F.length("hi"))
    same = F.size(F.filter(F.sequence(F.lit(0), n), lambda i: F.substr("lo", F.lit(1), i) == F.substr("hi", F.lit(1), i))) - 1
    return low.select("lexeme_id", F.substr("lo", F.lit(1), same).alias("stem"))


#: Endings of adjectives in the order they are tried, with gender, number and case.
ADJECTIVE_ENDINGS = [
    ("ого", "m", "sg", "gen"), ("ому", "m", "sg", "dat"), ("его", "m", "sg", "gen"), ("ему", "m", "sg", "dat"), ("ыми", None, "pl", "inst"), ("ими", None, "pl", "inst"),
    ("ых", None, "pl", "gen"), ("их", None, "pl", "gen"), ("ым", "m", "sg", "inst"), ("им", "m", "sg", "inst"), ("ые", None, "pl", "nom"), ("ие", None, "pl", "nom"),
    ("ою", "f", "sg", "inst"), ("ей", "f", "sg", "gen"), ("ую", "f", "sg", "acc"), ("юю", "f", "sg", "acc"), ("ая", "f", "sg", "nom"), ("яя", "f", "sg", "nom"),
    ("ое", "n", "sg", "nom"), ("ее", "n", "sg", "nom"), ("ой", "m", "sg", "nom"), ("ый", "m", "sg", "nom"), ("ий", "m", "sg", "nom"), ("ом", "m", "sg", "prep"), ("ем", "m", "sg", "prep"),
]
#: Rules that rebuild a base form: name, priority, ending cut, endings put on in order, part of speech, confidence with a known base.
BASE_RULES = [
    ("gerund-past-reflexive", 11, "вшись", ["ться"], "verb", 0.85), ("gerund-past", 12, "вши", ["ть"], "verb", 0.85), ("gerund-past", 13, "в", ["ть"], "verb", 0.85),
    ("gerund-present-reflexive", 14, "ясь", ["ться", "аться", "яться", "еться", "иться"], "verb", 0.8), ("gerund-present-reflexive", 15, "ась", ["ться", "аться", "яться", "еться", "иться"], "verb", 0.8),
    ("gerund-present", 16, "я", ["ть", "ать", "ять", "еть", "ить"], "verb", 0.8), ("gerund-present", 17, "а", ["ть", "ать", "ять", "еть", "ить"], "verb", 0.8),
    ("comparative", 8, "ее", ["ый", "ий", "ой"], "adjective", 0.85), ("comparative", 8, "ей", ["ый", "ий", "ой"], "adjective", 0.85),
    ("past", 6, "л", ["ть"], "verb", 0.85), ("past", 6, "ла", ["ть"], "verb", 0.85), ("past", 6, "ло", ["ть"], "verb", 0.85), ("past", 6, "ли", ["ть"], "verb", 0.85),
    ("adverb", 20, "о", ["ый", "ий", "ой"], "adjective", 0.85),
]


def rule_readings(words: DataFrame, index: DataFrame, lexemes: DataFrame) -> DataFrame:
    """Readings of `words` (surface) by rules whose base form the index knows: the first rule, then its first base.

    Generate base candidates from the rule table, join the index, pick by priority: no lexicon inside a UDF."""
    spark = words.sparkSession
    rows = [(n, p, cut, base, k, pos, c) for n, p, cut, bases, pos, c in BASE_RULES for k, base in enumerate(bases)]
    rules = spark.createDataFrame(rows, "rule string, priority int, cut string, put string, base_order int, pos string, confidence double")
    s = words.select("surface", T.loose_key(F.col("surface")).alias("w")).distinct()
    made = s.join(F.broadcast(rules), F.col("w").endswith(F.col("cut")) & (F.length("w") > F.length("cut") + 1))  # the rule table is a constant
    made = made.withColumn("base", F.concat(F.substr("w", F.lit(1), F.length("w") - F.length("cut")), "put"))
    hit = made.join(index.select(F.col("key").alias("base"), "lexeme_id").distinct(), "base").join(lexemes.select("lexeme_id", "lemma", F.col("pos").alias("l_pos")), "lexeme_id").where("pos = l_pos")
    w = Window.partitionBy("surface").orderBy("priority", "base_order", "lexeme_id")
    return hit.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("surface", "rule", "lexeme_id", "lemma", "pos", "confidence")


def ending_guess(word):
    """struct(pos, lemma, confidence) read off the ending alone, the last resort."""
    w = F.lower(word)
    cut = lambda n: F.substr(word, F.lit(1), F.length(word) - n)
    made = lambda pos, lemma, c: F.struct(F.lit(pos).alias("pos"), lemma.alias("lemma"), F.lit(c).alias("confidence"))
    out = F.when(w.endswith("остью") & (F.length(w) > 5), made("noun", F.concat(cut(5), F.lit("ость")), 0.55))
    out = out.when(w.endswith("ости") & (F.length(w) > 4), made("noun", F.concat(cut(4), F.lit("ость")), 0.55))
    out = out.when(w.endswith("ость") & (F.length(w) > 4), made("noun", word, 0.55))
    out = out.when(w.endswith("ть") | w.rlike("[сзй]ти$"), made("verb", word, 0.5))
    for end, *_ in ADJECTIVE_ENDINGS:
        out = out.when(w.endswith(end) & (F.length(w) > len(end) + 1), made("adjective", F.concat(F.lower(cut(len(end))), F.lit("ый")), 0.5))
    out = out.when(w.endswith("о") | w.endswith("е"), made("adverb", F.concat(cut(1), F.lit("ый")), 0.4))
    return out.otherwise(made("noun", word, 0.4))


def rank_candidates(candidates: DataFrame, keep: int = 3) -> DataFrame:
    """Candidates ranked per token: confidence, then source order, then frequency rank (nulls last); the chosen one always stays."""
    w = Window.partitionBy("token_id").orderBy(F.desc("confidence"), F.asc("source_order"), F.asc_nulls_last("rank"), "lexeme_id")
    ranked = candidates.withColumn("position", F.row_number().over(w) - 1)
    return ranked.where((F.col("position") < keep) | F.col("chosen")).withColumn("rank_no", F.when(F.col("chosen"), 0).otherwise(F.col("position") + 1)).drop("position")


def dependency_edges(edges: DataFrame) -> DataFrame:
    """One relation per dependent of a sentence: the first by priority, then order, then head."""
    w = Window.partitionBy("sentence_id", "dependent").orderBy("priority", "ord", "head")
    return edges.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def agreement(df: DataFrame) -> DataFrame:
    """matches of subject and verb features in three-valued logic: absent features are not compared, none compared is null."""
    checks = [F.col(f"s_{f}") == F.col(f"v_{f}") for f in ("gender", "number", "person")]
    wrong = F.coalesce(*[F.when(~c, F.lit(True)) for c in checks])
    right = F.coalesce(*[F.when(c, F.lit(True)) for c in checks])
    return df.withColumn("matches", F.when(wrong, False).when(right, True))
