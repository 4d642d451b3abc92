"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered without a global sort: a hash of the whole row picks one of 65,536 ranges, the counts of the ranges give
each range its first number, and rows are numbered inside their range. The numbers depend only on the rows, not on files
or partitions. A Feistel network over the smallest rectangle ``a x b`` that holds all numbers permutes them; a value
outside the row count walks on along its cycle. Row ``r`` then stands at ``p = permute(r)``: shard ``p % shards``, slot
``p // shards``; both can be computed for any row number, and inverted, without data (``permute``, ``row_at``).

Everything on this path is DataFrame and SQL functions.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.common import col, fresh, settle, with_ordinals

RANGES = 65_536
ROUNDS = 6
#: A rectangle holds at most about sqrt(n) values outside [0, n), so one step leaves it with odds of 1 / sqrt(n) at most and
#: a walk of this length is out of reach (below 2^-380 for n > 4096, impossible for smaller n); it would raise, not repeat.
WALK = 64


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of longs."""
    return F.call_function("div", a, b)


def _permuted(row: Column, n: Column, seed: int) -> Column:
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = _div(n + a - 1, a)

    def step(v: Column) -> Column:
        start = F.struct(_div(v, b).alias("x"), F.pmod(v, b).alias("y"), a.alias("p"), b.alias("q"))
        return F.aggregate(
            F.array(*[F.lit(i) for i in range(ROUNDS)]),
            start,
            lambda s, i: F.struct(
                s["y"].alias("x"),
                F.pmod(s["x"] + F.pmod(F.xxhash64(F.lit(seed), i, s["y"]), s["p"]), s["p"]).alias("y"),
                s["q"].alias("p"),
                s["p"].alias("q"),
            ),
            lambda s: s["x"] * s["q"] + s["y"],
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(row), lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long; take another seed")).cast("long"))


def assign_shards(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Every row of ``df`` with ``row_number``, ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most. Equal rows are told apart by an ordinal, so a row that makes up a third of the table
    is spread like any other. Nulls in any column are values like others; an empty table gives an empty result. The columns
    of ``df`` keep their names; a new column whose name is taken gets underscores.
    """
    ordinal, key, part, base, total = (fresh(df, x) for x in ("_ordinal", "_key", "_range", "_base", "_total"))
    number, shard, slot = (fresh(df, x) for x in ("row_number", "shard", "slot"))
    rows = with_ordinals(df, ordinal)
    rows = settle(rows.withColumn(key, F.xxhash64(*[col(c) for c in rows.columns])))
    rows = rows.withColumn(part, F.pmod(F.col(key), F.lit(RANGES)))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("c"))
    # at most RANGES rows, whatever the size of the table
    running = W.orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.orderBy(part).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = counts.select(part, (F.sum("c").over(running) - F.col("c")).alias(base), F.sum("c").over(every).alias(total))
    inside = F.row_number().over(W.partitionBy(part).orderBy(key, ordinal, *[col(c) for c in df.columns])) - 1
    numbered = rows.withColumn(number, inside.cast("long")).join(F.broadcast(firsts), part)
    numbered = numbered.withColumn(number, F.col(number) + F.col(base))
    at = fresh(df, "_at")
    placed = numbered.withColumn(at, _permuted(F.col(number), F.col(total), seed))
    return placed.select(
        *[col(c) for c in df.columns],
        F.col(number),
        F.pmod(F.col(at), F.lit(shards)).cast("int").alias(shard),
        _div(F.col(at), F.lit(shards)).alias(slot),
    )


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 17) -> None:
    """Write the rows as Parquet, one folder per shard, each file in slot order."""
    placed = assign_shards(df, shards, seed)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _round(seed: int, i: int, y: int) -> int:
    import xxhash

    h = 42
    for packed in (struct.pack("<i", seed), struct.pack("<i", i), struct.pack("<q", y)):
        h = xxhash.xxh64_intdigest(packed, h)
    return h - (1 << 64) if h >> 63 else h


def permute(row: int, n: int, seed: int = 17) -> int:
    """The place of one row number among ``n``, as the job computes it."""
    a = math.ceil(math.sqrt(n))
    b = (n + a - 1) // a
    while True:
        x, y, p, q = row // b, row % b, a, b
        for i in range(ROUNDS):
            x, y, p, q = y, (x + _round(seed, i, y) % p) % p, q, p
        row = x * b + y
        if row < n:
            return row


def row_at(shard: int, slot: int, shards: int, n: int, seed: int = 17) -> int:
    """The row number that stands in a slot: the permutation run backwards."""
    a = math.ceil(math.sqrt(n))
    b = (n + a - 1) // a
    v = slot * shards + shard
    while True:
        x, y, p, q = v // b, v % b, a, b
        for i in reversed(range(ROUNDS)):
            x, y, p, q = (y - _round(seed, i, x) % q) % q, x, q, p
        v = x * b + y
        if v < n:
            return v
