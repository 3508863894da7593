"""Feature codes, chapter preparation, verdict shares and the chapters of plain English books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode_features(code: Column) -> Column:
    """struct of features of a code such as n:sg:gen, a:m:sg:nom, a:short:f, v:pf:sg1, v:past:m, v:imp:sg, p:1:sg:nom or x."""
    p = F.split(code, ":")
    at = lambda i: F.get(p, F.lit(i))
    noun, adj, verb, pron = at(0) == "n", at(0) == "a", at(0) == "v", at(0) == "p"
    short, degree = adj & (at(1) == "short"), adj & at(1).isin("comp", "sup")
    full = adj & ~short & ~degree
    pf, past, imp = verb & (at(1) == "pf"), verb & (at(1) == "past"), verb & (at(1) == "imp")
    gender = F.when(full, at(1)).when(past | short, at(2))
    gender = F.when(gender.isin("m", "f", "n"), gender)
    number = (
        F.when(noun, at(1)).when(full, F.when(at(1) == "pl", "pl").otherwise(at(2))).when(short | past, F.when(at(2) == "pl", "pl").otherwise("sg"))
        .when(pf, F.substring(at(2), 1, 2)).when(imp, at(2)).when(pron, at(2))
    )
    case = F.when(noun, at(2)).when(full, F.when(at(1) == "pl", at(2)).otherwise(at(3))).when(pron, at(3))
    return F.struct(
        number.alias("number"), case.alias("gcase"), gender.alias("gender"),
        F.when(pf, F.substring(at(2), 3, 1).try_cast("int")).when(pron, at(1).try_cast("int")).alias("person"),
        F.when(pf, "present-future").when(past, "past").when(imp, "imperative").when(verb & (at(1) == "inf"), "infinitive").alias("verb_form"),
        F.when(short, "short").when(degree & (at(1) == "comp"), "comparative").when(degree, "superlative").alias("degree"),
    )


def chapter_prep(counts: DataFrame, known: DataFrame, work: list[str], limits: dict[str, int]) -> DataFrame:
    """The first `limits[kind]` new entries of each kind per chapter: those not known and first met in it, by count.

    `counts` has work, chapter, kind, key, n; `known` has key."""
    first = Window.partitionBy(*work, "kind", "key")
    new = counts.withColumn("first", F.min("chapter").over(first)).where("chapter = first").join(known, "key", "left_anti")
    rn = F.row_number().over(Window.partitionBy(*work, "chapter", "kind").orderBy(F.desc("n"), "key"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("kind"))
    return new.withColumn("rn", rn).where(F.col("rn") <= limit).drop("rn", "first")


def verdict_shares(verdicts: DataFrame, group: str) -> DataFrame:
    """Shares of verdicts per group and in total, pivoted: dictionary, closed, rule, guess, none.

    `verdicts` has the group, producer, confidence and n. Buckets are by producer."""
    kinds = ["dictionary", "closed", "rule", "guess", "none"]
    total = F.sum("n")
    share = lambda k: F.round(F.sum(F.when(F.col("producer") == k, F.col("n")).otherwise(0)) / total, 6).alias(k)
    return verdicts.rollup(group).agg(total.cast("long").alias("tokens"), *[share(k) for k in kinds])
