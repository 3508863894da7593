"""Analysis of whole texts: readings of the vocabulary on every occurrence, choice by context, constructions, clauses.

The lexicon meets the vocabulary alone; its ranked readings are then joined back onto occurrences as one array a word. From
there on everything happens within a sentence, behind one exchange: context rules, constructions, and clauses whose predicates
are the heads of the constructions found."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clauses as C
from . import constructions as K
from . import context as X
from .stored import kept

#: Features of a reading by their names in a feature string.
FEATURES = {
    "case": "case", "number": "number", "gender": "gender", "degree": "degree", "type": "pronoun_type", "verb_form": "verb_form", "tense": "tense", "aspect": "aspect", "person": "person",
    "reflexive": "reflexive", "motion_kind": "motion",
}
#: Finders of constructions by their number.
FUTURE, ASPECT, IMPERSONAL, POSSESSION, PHRASE = 0, 1, 3, 4, 9


class Analysis(NamedTuple):
    """tokens (with the chosen reading, why, ambiguous, clause), constructions, clauses and dependencies."""

    tokens: DataFrame
    constructions: DataFrame
    clauses: DataFrame
    dependencies: DataFrame


def reading(features: Column) -> Column:
    """struct of X.READING from key, lemma, pos, confidence and a feature string."""
    of = F.str_to_map(features, F.lit(";"), F.lit("="))
    f = {name: F.try_element_at(of, F.lit(key)) for name, key in FEATURES.items()}
    f["reflexive"] = F.coalesce(f["reflexive"] == "true", F.lit(False))
    f["motion"] = f["motion_kind"].isNotNull()
    order = [x.split(":")[0] for x in X.READING[len("struct<") : -1].split(",")]
    return F.struct(*[f.get(name, F.col(name)).alias(name) for name in order])


def with_readings(tokens: DataFrame, readings: DataFrame) -> DataFrame:
    """`tokens` (sentence_id, i, kind, text) with cands, the array of their readings, best first.

    `readings` are those of `generate.analyse`. They become one row a surface first, so that an occurrence meets one row; frequent
    words make that join skewed, which adaptive execution splits."""
    ranked = readings.select("surface", F.struct("rank", reading(F.col("features")).alias("c")).alias("x"))
    rows = ranked.groupBy("surface").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("cands"))  # a word has a few dozen readings
    words = tokens.withColumn("of", F.when(F.col("kind") == "word", F.col("text")))
    none = F.array().cast(f"array<{X.READING}>")
    return words.join(rows.withColumnRenamed("surface", "of"), "of", "left").select("sentence_id", "i", "kind", "text", F.coalesce("cands", none).alias("cands"))


def chosen_tokens(tokens: DataFrame, rules: list = X.RULES) -> DataFrame:
    """Tokens with cands, a row each or arrays of a sentence, to one row each with the features of the reading that context chose, why,
    decided and ambiguous."""
    if "i" in tokens.columns:
        seen = X.in_context(tokens, rules)
    else:
        each = X.in_sentences(tokens, rules).select("sentence_id", F.posexplode(F.arrays_zip("kind", "text", "cands", "chosen", "why")).alias("i", "t")).select("sentence_id", "i", "t.*")
        seen = each.select("sentence_id", "i", "kind", "text", F.coalesce("cands", F.array().cast(f"array<{X.READING}>")).alias("cands"), "chosen", F.col("why").isNotNull().alias("decided"), F.coalesce("why", F.lit("")).alias("why"))
    now = F.get("cands", F.col("chosen"))
    word = F.col("kind") == "word"
    named = [now[c].alias(c) for c in ("key", "lemma", "case", "number", "gender", "type", "verb_form", "tense", "aspect")]
    return seen.select(
        "sentence_id", "i", "kind", "text", F.when(word, now["pos"]).otherwise("punct").alias("pos"), *named, now["person"].cast("int").alias("person"), now["motion_kind"].alias("motion"),
        F.coalesce(now["reflexive"], F.lit(False)).alias("reflexive"), "decided", "why",
        (word & (X.ambiguous(F.col("cands"), F.col("chosen"), F.col("decided")) | F.col("why").isin(X.BY_ORDER))).alias("ambiguous"),
    )


def with_constructions(tokens: DataFrame, constructions: DataFrame) -> DataFrame:
    """Tokens of `chosen_tokens` with what constructions say of them: verbal (head of an aspect or a future), phrase_head and
    in_phrase (within a prepositional phrase), role (experiencer of an impersonal, possessor after у)."""
    of = lambda *finders: constructions.where(F.col("finder").isin(*finders))
    fact = lambda df, i, verbal=None, head=None, role=None: df.select("sentence_id", i.alias("i"), F.lit(verbal).cast("boolean").alias("verbal"), (F.lit(None) if head is None else head).cast("int").alias("phrase_head"), F.lit(role).cast("string").alias("role"))
    last = F.array_max("members")
    facts = (
        fact(of(FUTURE, ASPECT), F.col("head"), verbal=True)
        .unionByName(fact(of(PHRASE).select("sentence_id", last.alias("last"), F.explode(F.sequence("head", last)).alias("at")), F.col("at"), head=F.col("last")))
        .unionByName(fact(of(IMPERSONAL).select("sentence_id", F.explode(F.filter("members", lambda m: m < F.col("head"))).alias("at")), F.col("at"), role="experiencer"))
        .unionByName(fact(of(POSSESSION).select("sentence_id", last.alias("at")), F.col("at"), role="possessor"))
    )
    told = facts.groupBy("sentence_id", "i").agg(F.max("verbal").alias("verbal"), F.min("phrase_head").alias("phrase_head"), F.min("role").alias("role"))
    joined = tokens.join(told, ["sentence_id", "i"], "left")
    return joined.withColumns({"verbal": F.coalesce("verbal", F.lit(False)), "in_phrase": F.col("phrase_head").isNotNull()})


def analyse_sentences(tokens: DataFrame, readings: DataFrame, rules: list = X.RULES, keep: Callable[[DataFrame], DataFrame] = kept) -> Analysis:
    """The whole analysis of `tokens` (sentence_id of any type, i from 0, kind, text) with `readings` of their vocabulary.

    `keep` stores what several of the results need (tokens, then constructions), such as a checkpoint or a table of the caller."""
    return analyse_read(with_readings(tokens, readings), rules, keep)


def analyse_read(tokens: DataFrame, rules: list = X.RULES, keep: Callable[[DataFrame], DataFrame] = kept) -> Analysis:
    """`analyse_sentences` of tokens that have their readings, cands, already; they may be rows of sentences as `X.in_sentences` takes them."""
    chosen = keep(chosen_tokens(tokens, rules))
    found = keep(K.find_constructions(chosen.select("*", F.col("text").alias("w"), F.col("case").alias("gcase"), F.col("type").alias("pronoun_type"))))
    parted = keep(C.clause_numbers(with_constructions(chosen, found)))
    roles = C.clause_roles(parted)
    return Analysis(parted, found, roles, C.dependencies(parted, roles))
