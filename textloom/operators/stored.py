"""Intermediate results that several parts of a plan read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once: a checkpoint where spark.checkpoint.dir names a shared folder, else cached with its lineage.

    The checkpoint is written at once; one that waits is computed by each of its readers in the first job, and again to be written."""
    return df.checkpoint(eager=True) if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()
