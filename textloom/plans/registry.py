"""Names of the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis, clauses, corpus, dictionary, drills, features, ingest, learner, lexicon, records, sentence, sound, surface, whole

MODULES = [analysis, clauses, corpus, dictionary, drills, features, ingest, lexicon, learner, records, sentence, sound, surface, whole]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
