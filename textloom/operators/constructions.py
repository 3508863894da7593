"""Construction finders over tokens with their chosen readings: lead, lag and short frames, one window for all.

Tokens are rows (sentence_id, i, w, pos, lemma, gcase, number, gender, person, verb_form, tense, aspect, motion,
reflexive, pronoun_type) with nulls for what a reading doesn't have. Every finder returns (sentence_id, pattern,
head, members, confidence); `find_constructions` is their union in the fixed order of the finders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("sentence_id").orderBy("i")


def neighbours(tokens: DataFrame) -> DataFrame:
    """Tokens with the structs of up to four tokens before and six after: n1.., p1.. in one sort."""
    this = F.struct("i", "w", "pos", "lemma", "gcase", "verb_form", "pronoun_type")
    after = {f"n{k}": F.lead(this, k).over(_order()) for k in range(1, 7)}
    before = {f"p{k}": F.lag(this, k).over(_order()) for k in range(1, 5)}
    return tokens.withColumns(after | before)


def _row(order: int, when: Column, pattern: Column | str, members: list[Column], confidence: float) -> Column:
    """A construction at this token, null where `when` doesn't hold."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    ids = F.array_sort(F.array_distinct(F.filter(F.array(*members), lambda x: x.isNotNull())))
    found = F.struct(F.lit(order).alias("finder"), pattern.alias("pattern"), F.col("i").alias("head"), ids.alias("members"), F.lit(confidence).alias("confidence"))
    return F.when(F.coalesce(when, F.lit(False)), found)


def _first(prefix: str, span: range, test) -> Column:
    return F.coalesce(*[F.when(test(F.col(f"{prefix}{k}")), F.col(f"{prefix}{k}.i")) for k in span])


def find_constructions(tokens: DataFrame) -> DataFrame:
    """All constructions of all sentences."""
    t = neighbours(tokens)
    w, i = F.lower("w"), F.col("i")
    verb = F.col("pos") == "verb"
    future = verb & (F.col("lemma") == "быть") & (F.col("tense") == "future") & (F.col("n1.pos") == "verb") & (F.col("n1.verb_form") == "infinitive")
    # the infinitive of an analytic future is no predicate of its own
    t = t.withColumn("aux", F.coalesce(future, F.lit(False))).withColumn("used", F.coalesce(F.lag("aux").over(_order()), F.lit(False)) | F.col("aux"))
    finite = verb & F.col("verb_form").isin("past", "present-future", "imperative", "infinitive") & ~F.col("used")
    negative = _first("p", range(1, 4), lambda x: x["pronoun_type"] == "negative")
    genitive = _first("n", range(1, 4), lambda x: (x["gcase"] == "gen") & x["pos"].isin("noun", "proper", "pronoun"))
    noun_after = _first("n", range(1, 5), lambda x: x["pos"].isin("noun", "proper"))
    infinitive = _first("n", range(1, 3), lambda x: x["verb_form"] == "infinitive")
    dative = _first("p", range(1, 3), lambda x: x["gcase"] == "dat")
    than = _first("n", range(1, 4), lambda x: F.lower(x["w"]) == "чем")
    verb_near = F.coalesce(_first("p", range(1, 5), lambda x: x["pos"] == "verb"), _first("n", range(1, 5), lambda x: x["pos"] == "verb"))
    heads = _first("n", range(1, 7), lambda x: ~x["pos"].isin("adjective", "numeral", "pronoun") | (x["pronoun_type"] == "personal"))
    head_pos = F.coalesce(*[F.when(~F.col(f"n{k}.pos").isin("adjective", "numeral", "pronoun") | (F.col(f"n{k}.pronoun_type") == "personal"), F.col(f"n{k}.pos")) for k in range(1, 7)])
    not_ = (w == "не") & F.col("n1.pos").isNotNull() & (F.col("n1.pos") != "punct")
    found = [
        _row(0, F.col("aux"), "future:analytic", [i, F.col("n1.i")], 0.9),
        _row(1, finite, F.concat(F.lit("aspect:"), F.coalesce("aspect", F.lit("unknown"))), [i], 0.85),
        _row(2, verb & F.col("motion").isNotNull(), F.concat(F.lit("motion:"), "motion"), [i], 0.85),
        _row(3, F.col("pos") == "predicative", F.concat(F.lit("impersonal:"), "lemma"), [i, dative, infinitive], 0.85),
        _row(4, (w == "у") & (F.col("pos") == "preposition") & (F.col("n1.gcase") == "gen"), "possession:у", [i, F.col("n1.i")], 0.8),
        _row(5, verb & F.coalesce("reflexive", F.lit(False)), "reflexive:general", [i], 0.55),
        _row(6, not_, F.when(negative.isNotNull(), "negation:double").when(genitive.isNotNull(), "negation:genitive-object").otherwise("negation:plain"), [negative, i, F.col("n1.i"), genitive], 0.85),
        _row(8, (F.col("pos") == "numeral") & noun_after.isNotNull(), F.concat(F.lit("numeral:"), "lemma"), [i, noun_after], 0.85),
        _row(9, (F.col("pos") == "preposition") & head_pos.isin("noun", "proper", "pronoun"), F.concat(F.lit("pp:"), w), [i, heads], 0.85),
        _row(10, F.col("verb_form").startswith("participle"), F.concat(F.lit("participle:"), "verb_form"), [i], 0.7),
        _row(11, F.col("verb_form").startswith("gerund"), F.concat(F.lit("gerund:"), "verb_form"), [i], 0.7),
        _row(12, w.isin("бы", "б") & verb_near.isNotNull(), "conditional:бы", [i, verb_near], 0.8),
        _row(13, w.isin("чтобы", "чтоб"), "purpose:чтобы", [i, _first("n", range(1, 7), lambda x: x["pos"] == "verb")], 0.85),
        _row(14, F.col("pos") == "comparative", "comparative", [i, than], 0.8),
    ]
    t = t.withColumn("next_ni", F.min(F.when(w == "ни", i)).over(_order().rowsBetween(1, 8)))
    found.append(_row(7, (w == "ни") & F.col("next_ni").isNotNull(), "negation:ni-ni", [i, F.col("next_ni")], 0.8))
    each = t.select("sentence_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("sentence_id", "x.*")
    names = tokens.where("pos = 'proper'").select("sentence_id", "i", "lemma").withColumn("island", i - F.row_number().over(_order()))
    runs = names.groupBy("sentence_id", "lemma", "island").agg(F.min("i").alias("head"), F.array_sort(F.collect_list("i")).alias("members"))
    named = runs.select("sentence_id", F.lit(15).alias("finder"), F.concat(F.lit("name:"), "lemma").alias("pattern"), "head", "members", F.lit(0.9).alias("confidence"))
    return each.unionByName(named)


def members(constructions: DataFrame) -> DataFrame:
    """One row per token of a construction."""
    return constructions.select("sentence_id", "finder", "pattern", "head", F.explode("members").alias("i"))
