"""Export of tables of different shape into one, each row tagged with its table and held as a VARIANT, and the import that merges
them back: rows with a key are upserted field by field, rows without one are appended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def export(tables: dict[str, DataFrame], private: dict[str, list[str]] | None = None) -> DataFrame:
    """(table, row): every row of every table, with its fields by name.

    `private` names columns by table that are not exported, such as keys of a service. A field that is null is exported as null."""
    private = private or {}

    def one(name: str, df: DataFrame) -> DataFrame:
        fields = [F.col(f"`{c}`") for c in df.columns if c not in private.get(name, [])]
        return df.select(F.lit(name).alias("table"), F.to_variant_object(F.struct(*fields)).alias("row"))

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def imported(rows: DataFrame, name: str, schema: StructType) -> DataFrame:
    """The rows of one table, read to its schema. A field that is absent or of another kind is null; fields that the schema lacks
    are left out."""
    get = lambda f: F.try_variant_get("row", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name)
    return rows.where(F.col("table") == name).select(*[get(f) for f in schema])


def merged(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`current` after the import of `new`, with its columns.

    With keys: a row whose key is stored sets the fields it has, another is added. Of several imported rows with one key the
    greatest field by field, in the order of the columns, counts, so the result does not depend on their order. A row that
    lacks part of its key is added as it is, as are all rows where `keys` is empty."""
    if not keys:
        return current.unionByName(new.select(*current.columns))
    rest = [c for c in current.columns if c not in keys]
    keyed = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
    once = new.where(keyed).groupBy(*keys).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("new_fields")) if rest else new.where(keyed).select(*keys).distinct()
    taken = current.where(keyed).join(once, keys, "full")
    fields = [F.coalesce(F.col("new_fields")[c], F.col(f"`{c}`")).alias(c) for c in rest]
    loose = current.where(~keyed).unionByName(new.where(~keyed).select(*current.columns))
    return taken.select(*keys, *fields).select(*current.columns).unionByName(loose)


def import_all(current: dict[str, DataFrame], rows: DataFrame, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Each table after the import. Tables that `keys` does not name stay as they are, as do those of which there are no rows."""
    return {n: merged(df, imported(rows, n, df.schema), keys[n]) if n in keys else df for n, df in current.items()}


def write_export(rows: DataFrame, path: str) -> None:
    """The export as lines of JSON, split as Spark splits it."""
    rows.select("table", F.to_json("row").alias("row")).write.mode("overwrite").json(path)


def read_export(spark, path: str) -> DataFrame:
    """(table, row) of a written export. A line whose row is no JSON is left out."""
    lines = spark.read.schema("table string, row string").json(path)
    return lines.select("table", F.try_parse_json("row").alias("row")).where("row is not null")
