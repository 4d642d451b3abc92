"""Running values over ordered rows, safe when one key holds a large share of the table.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task. :func:`split_keys` checks first: it
counts rows per key (a partial aggregate) and only when some key has more than ``target_rows`` rows does it cut such keys
into consecutive chunks of their order axis. A running value over chunked rows is

    local part   window over (key, chunk)                     one task per chunk
    summary      groupBy(key, chunk), partial aggregation     one row per chunk
    carry        window over the summary rows of a key        few rows, settled as a small table
    result       local part combined with the carry, joined on (key, chunk)

The join reuses the partitioning of the local window, so the rows are shuffled once. When no key is hot, the plan is the
plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.plans.settle import settle

CHUNK = "_chunk"
TARGET_ROWS = 1_000_000
#: chunks per ``target_rows`` rows of a hot key: head room for uneven spacing along the order axis
FAN = 16
CHUNK_BYTES = 8 << 20


@dataclass(frozen=True)
class Running:
    """One running value: ``last`` non-null value, ``sum``, ``max`` or ``min``, up to or strictly before the row."""

    kind: str
    value: Column
    inclusive: bool = True


def last(value: Column, inclusive: bool = True) -> Running:
    return Running("last", value, inclusive)


def total(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def highest(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def lowest(value: Column, inclusive: bool = True) -> Running:
    return Running("min", value, inclusive)


def previous(value: Column) -> Running:
    """``lag(value, 1)``; null values are kept apart from "no previous row" by the wrapping struct."""
    return Running("lag", F.struct(value.alias("v")), False)


@dataclass(frozen=True)
class Lane:
    """Rows of ``keys`` in ``order``; ``split`` when the rows carry chunk numbers."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool = False

    def over(self, *extra: str) -> Lane:
        return Lane((*self.keys, *extra), self.order, self.split)


def split_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    target_rows: int = TARGET_ROWS,
    fan: int = FAN,
) -> tuple[DataFrame, Lane]:
    """Chunk the keys that hold more than ``target_rows`` rows; the first order column must be integral.

    The lookup that assigns chunks holds only such keys, so it has at most ``rows / target_rows`` entries whatever the
    key distribution is, and may be broadcast.
    """
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order[0]).alias("_lo"), F.max(order[0]).alias("_hi"))
        .where(F.col("_n") > target_rows)
        .select(
            *keys,
            "_lo",
            F.expr(f"(_hi - _lo) div (cast(ceil(_n / {float(target_rows)}) as bigint) * {fan}) + 1").alias("_width"),
        )
    )
    if hot.isEmpty():
        return df, Lane(tuple(keys), tuple(order))
    chunked = (
        df.join(F.broadcast(settle(hot)), list(keys), "left")
        .withColumn(CHUNK, F.coalesce(F.expr(f"({order[0]} - _lo) div _width"), F.lit(0).cast("bigint")))
        .drop("_lo", "_width")
    )
    return chunked, Lane(tuple(keys), tuple(order), True)


def split_offsets(
    df: DataFrame, keys: Sequence[str], offset: str = "byte_offset", chunk_bytes: int = CHUNK_BYTES, length: str = "byte_length"
) -> tuple[DataFrame, Lane]:
    """Chunks for log lines: a slice of the byte axis is bounded by construction.

    Sources shorter than one slice need no chunks, which the largest offset tells. Where ``length`` is among the columns, neither do
    sources of which less than one slice is here: a large offset alone says where their lines stand, not how many there are.
    """
    top = df.agg(F.max(offset)).first()[0]
    if top is None or top < chunk_bytes:
        return df, Lane(tuple(keys), (offset,))
    if length in df.columns:
        held = F.sum(F.greatest(F.lit(1).cast("bigint"), F.col(length)))
        if df.groupBy(*keys).agg(held.alias("_held")).agg(F.max("_held")).first()[0] < chunk_bytes:
            return df, Lane(tuple(keys), (offset,))
    return df.withColumn(CHUNK, F.expr(f"cast({offset} div {chunk_bytes} as bigint)")), Lane(tuple(keys), (offset,), True)


def scan(df: DataFrame, lane: Lane, values: Mapping[str, Running]) -> DataFrame:
    """Add one column per entry of ``values``."""
    keys, order = list(lane.keys), list(lane.order)
    cut = [*keys, CHUNK] if lane.split else keys
    kept = [c for c in df.columns if c not in values]
    staged = df.select("*", *[r.value.alias(f"_v_{n}") for n, r in values.items()])
    ordered = Window.partitionBy(*cut).orderBy(*order)

    def local(name: str, r: Running) -> Column:
        frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
        col = F.col(f"_v_{name}")
        if r.kind == "lag":
            return F.lag(col, 1).over(ordered)
        if r.kind == "last":
            return F.last(col, ignorenulls=True).over(frame)
        return {"sum": F.sum, "max": F.max, "min": F.min}[r.kind](col).over(frame)

    if not lane.split:

        def alone(name: str, r: Running) -> Column:
            value = local(name, r)
            value = value["v"] if r.kind == "lag" else F.coalesce(value, F.lit(0)) if r.kind == "sum" else value
            return value.alias(name)

        return staged.select(*kept, *[alone(n, r) for n, r in values.items()])

    def summary(name: str, r: Running) -> Column:
        col = F.col(f"_v_{name}")
        if r.kind in ("last", "lag"):
            agg = F.max_by(col, F.when(col.isNotNull(), F.struct(*order)))
        else:
            agg = {"sum": F.sum, "max": F.max, "min": F.min}[r.kind](col)
        return agg.alias(f"_s_{name}")

    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    def carry(name: str, r: Running) -> Column:
        col = F.col(f"_s_{name}")
        if r.kind in ("last", "lag"):
            agg = F.last(col, ignorenulls=True)
        else:
            agg = {"sum": F.sum, "max": F.max, "min": F.min}[r.kind](col)
        return agg.over(before).alias(f"_c_{name}")

    def combine(name: str, r: Running) -> Column:
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if r.kind == "lag":
            return F.coalesce(here, there)["v"]
        if r.kind == "last":
            return F.coalesce(here, there)
        if r.kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        return {"max": F.greatest, "min": F.least}[r.kind](here, there)

    carries = settle(
        staged.groupBy(*keys, CHUNK)
        .agg(*[summary(n, r) for n, r in values.items()])
        .select(
            *keys,
            CHUNK,
            F.row_number().over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_slot"),
            *[carry(n, r) for n, r in values.items()],
        )
        .where(F.col("_slot") > 1)
        .drop("_slot")
    )
    return (
        staged.select("*", *[local(n, r).alias(f"_l_{n}") for n, r in values.items()])
        .join(carries, [*keys, CHUNK], "left")
        .select(*kept, *[combine(n, r).alias(n) for n, r in values.items()])
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    facts: Sequence[str],
    target_rows: int | None = TARGET_ROWS,
) -> DataFrame:
    """For every left row the latest earlier right row of the same key, as columns ``facts`` (null when none).

    Both sides carry ``keys`` and ``order``; the first order column must be integral. A right row at the same order
    values as a left row is not visible to it. ``target_rows=None`` states that no key is hot and skips the check.
    """
    keys, order, facts = list(keys), list(order), list(facts)
    left_cols = [c for c in left.columns if c not in keys and c not in order]
    probe = left.select(
        *keys,
        *order,
        F.lit(None).cast(right.select(F.struct(*facts).alias("f")).schema["f"].dataType).alias("_fact"),
        F.struct(*[F.col(c) for c in left_cols], F.lit(True).alias("_probe")).alias("_row"),
    )
    build = right.select(
        *keys,
        *order,
        F.struct(*facts).alias("_fact"),
        F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"),
    )
    both, lane = probe.unionByName(build), Lane(tuple(keys), tuple(order))
    if target_rows is not None:
        both, lane = split_keys(both, keys, order, target_rows)
    sided = both.withColumn("_side", F.col("_row").isNull().cast("int"))
    found = scan(
        sided, Lane(lane.keys, (*lane.order, "_side"), lane.split), {"_hit": last(F.col("_fact"), inclusive=False)}
    )
    return found.where(F.col("_row").isNotNull()).select(
        *keys, *order, *[F.col("_row")[c].alias(c) for c in left_cols], *[F.col("_hit")[f].alias(f) for f in facts]
    )


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows per key in the given order, with ``rank``.

    Spark turns ``row_number() <= n`` into a group limit before the shuffle, so each map task forwards at most ``n`` rows
    of a key and a hot key costs ``n`` rows per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order, *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
