"""Table-level writes as DataFrame results: new books, cascade deletes, merge of exported progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_books(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming books whose content is not stored yet; of equal incoming ones the first id."""
    first = incoming.groupBy("content_hash").agg(F.min("book_id").alias("book_id"))
    return first.join(existing.select("content_hash").distinct(), "content_hash", "left_anti")


def cascade_delete(tables: dict[str, DataFrame], books: DataFrame, key: str = "book_id") -> dict[str, DataFrame]:
    """Each dependent table without the rows of the given books."""
    gone = books.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def merge_progress(current: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key: an imported row's fields win where they are set."""
    rest = [c for c in current.columns if c not in keys]
    right = imported.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest])
    return current.join(right, keys, "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])
