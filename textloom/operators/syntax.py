"""Sentence-scope rules as window expressions over tokens with their readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preposition_heads(tokens: DataFrame, prepositions: DataFrame) -> DataFrame:
    """(sentence_id, prep, head, governed): the noun a preposition governs and the first of its cases the noun can have.

    Tokens are (sentence_id, i, w, pos, readings). The head is the next noun with only modifiers between; the
    look ahead is a running frame over the reversed order."""
    back = Window.partitionBy("sentence_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    other = ~F.col("pos").isin("adjective", "numeral", "pronoun")
    ahead = tokens.select("*", F.last(F.when(other, F.struct("pos", "w", "readings")), ignorenulls=True).over(back).alias("next"))
    heads = ahead.where((F.col("pos") == "preposition") & (F.col("next.pos") == "noun"))
    joined = heads.join(F.broadcast(prepositions), F.col("w") == F.col("form"))  # a closed class
    fits = joined.where(F.array_contains(F.split("next.readings", ","), F.col("governed")))
    return fits.groupBy("sentence_id", F.col("w").alias("prep"), F.col("next.w").alias("head")).agg(F.min_by("governed", "case_order").alias("governed"))
