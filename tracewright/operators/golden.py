"""Difference of a table from what it should hold, as a multiset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def _comparable(value: Column, kind: DataType) -> Column:
    """Maps as entries sorted by key, at any depth, so that equal rows group together."""
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _comparable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda e: _comparable(e, kind.elementType))
    if isinstance(kind, StructType):
        inner = F.struct(*[_comparable(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def golden_diff(actual: DataFrame, expected: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that are not there as often as they should: the columns, ``side`` (missing or unexpected), and how often (``copies``).

    Equal rows are counted on both sides before the one shuffle; nulls equal nulls. An empty result says that the tables are equal.
    """
    columns = list(columns or expected.columns)
    parts = []
    for df, weight in ((actual, 1), (expected, -1)):
        kinds = {f.name: f.dataType for f in df.schema}
        plain = [_comparable(F.col(f"`{c}`"), kinds[c]).alias(c) for c in columns]
        parts.append(df.select(*plain, F.lit(weight).cast("bigint").alias("_weight")))
    counted = parts[0].unionByName(parts[1]).groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum("_weight").alias("_n"))
    side = F.when(F.col("_n") < 0, "missing").otherwise("unexpected")
    return counted.where("_n <> 0").select(*[F.col(f"`{c}`") for c in columns], side.alias("side"), F.abs("_n").alias("copies"))
