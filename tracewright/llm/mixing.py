"""Mixing sources to target weights with nested hash-threshold histograms.

Each source gets a target: shares of a budget by weight, never above a multiple of what the source has, the excess reshared by
weight (a water level found by grouped sums, one round per group of sources that fill up). A source whose target is above its size
takes every document ``floor(target / size)`` times; the rest is the documents whose hash lies below a threshold. The threshold is found
without sorting: sizes are summed by source and the next nine hash bits, the bucket in which the running sum passes the budget is
kept, and only documents of that bucket are read for the next nine bits, until one document is left.

Everything on this path is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.common import CHUNK, col, fresh, settle, with_ordinals

BITS, LEVELS = 9, 7  # 63 bits of hash


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: adds ``sid`` (rank by code point, null last), ``weight`` and ``target``.

    One row per source, so the only window without a partition here runs over the list of source names.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("sid", F.row_number().over(order).cast("long") - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    src = settle(ranked.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    budget = share * float(src.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("cap")
        got = src.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if got["n"] == full or not got["open"]:
            break
        full, level = got["n"], (budget - (got["held"] or 0.0)) / got["open"]
    return src.withColumn("target", F.least(F.col("weight") * level, F.col("cap")))


def _prefix(depth: int) -> Column:
    return F.shiftright("h", 63 - BITS * depth)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Take documents so that each source comes near its target.

    ``docs`` has ``source`` and ``size`` (long) and any other groupable columns, which identify a row. Returns those columns with
    ``source_size``, ``target`` and ``copies`` (how often the document is taken, at most ``ceil(most)``). Only one document of a
    source is off: the one at the threshold is taken if that comes nearer to the target. The choice hangs on the rows' hashes
    alone, so reruns agree. A null source is a source of its own, after all others; null sizes count as 0; equal rows are
    chosen one by one; an empty table gives an empty result. New names get underscores where they are taken.
    """
    own = {c: c if c in ("source", "size") else f"_user{i}" for i, c in enumerate(docs.columns)}
    given = docs.select(*[col(c).alias(new) for c, new in own.items()])
    rows = with_ordinals(given.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))), "_ordinal")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).bitwiseAND(F.lit(2**63 - 1))
    rows = settle(rows.withColumn("h", hashed))
    src = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    src = src.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    src = settle(src.select("source", "sid", "source_size", "target", "base", "rest"))
    known = src.select(F.col("source").alias("_s"), "sid", "source_size", "target", "base")
    rows = settle(rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))

    # state of a source: the bucket (a prefix of the hash) that holds its threshold, and the size of all buckets before it
    # (where nothing is left to take, a threshold would only add documents of size 0)
    state = src.where("rest > 0").select("sid", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    done: list[DataFrame] = []
    for depth in range(1, LEVELS + 1):
        inside = rows.select("sid", "h", "size", (_prefix(depth - 1) if depth > 1 else F.lit(0).cast("long")).alias("bucket"))
        if depth > 1:
            inside = inside.join(state.select("sid", "bucket"), ["sid", "bucket"], "left_semi")
        counts = inside.groupBy("sid", _prefix(depth).alias("next")).agg(
            F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n")
        )
        run = W.partitionBy("sid").orderBy("next").rowsBetween(W.unboundedPreceding, W.currentRow)
        at = counts.withColumn("upto", F.sum("sum").over(run)).join(state, "sid")
        at = at.where(F.col("before") + F.col("upto") > F.col("rest")).withColumn(
            "first", F.row_number().over(W.partitionBy("sid").orderBy("next"))
        )
        at = at.where("first = 1").select(
            "sid", "rest", F.col("next").alias("bucket"), (F.col("before") + F.col("upto") - F.col("sum")).alias("before"), "n",
            "sum",
        )
        at = settle(at)
        last = F.lit(depth == LEVELS) | (F.col("n") == 1)
        nearer = F.abs(F.col("before") + F.col("sum") - F.col("rest")) < F.abs(F.col("before") - F.col("rest"))
        bound = F.shiftleft(F.col("bucket") + F.when(nearer, 1).otherwise(0), 63 - BITS * depth)
        done.append(at.where(last).select("sid", bound.alias("bound")))
        state = at.where(~last).select("sid", "rest", "bucket", "before")
        if state.isEmpty():
            break
    bounds = done[0]
    for d in done[1:]:
        bounds = bounds.unionByName(d)
    # a bound of 2^63 overflows to the least long: every document is below it
    below = (F.col("h") < F.col("bound")) | (F.col("bound") < 0)
    taken = rows.join(bounds, "sid", "left").withColumn(
        "copies", F.col("base") + F.when(F.col("bound").isNotNull() & below, 1).otherwise(0)
    )
    new = [F.col(c).alias(fresh(docs, c)) for c in ("source_size", "target", "copies")]
    return taken.select(*[F.col(now).alias(c) for c, now in own.items()], *new)


def mixed_documents(docs: DataFrame, size: Column, source: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns unchanged.

    The mix is worked out over a digest, source and size of each row; the rows themselves move once at most. Rows that are equal
    in all columns share their copies. Other arguments are those of ``mix``.
    """
    key, n, total, copy = (fresh(docs, c) for c in ("_key", "_n", "_total", "_copy"))
    digest = F.md5(F.to_json(F.struct(*[col(c) for c in docs.columns]), {"ignoreNullFields": "false"}))
    slim = settle(docs.select(digest.alias("key"), col(source).alias("source"), size.alias("size")))
    taken = mix(slim, **options).groupBy("key").agg(F.count(F.lit(1)).alias(n), F.sum("copies").cast("long").alias(total))
    taken = settle(taken.where(F.col(total) > 0).withColumnRenamed("key", key))
    keyed = docs.select(*[col(c) for c in docs.columns], digest.alias(key))
    once = keyed.join(taken.where(F.col(n) == 1), key).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(total))))
    same = keyed.join(taken.where(F.col(n) > 1), key).dropDuplicates([key])
    chunks = same.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{total}` - 1) div {CHUNK}"))))
    first = F.col(copy) * CHUNK
    more = chunks.repartition(F.col(key), F.col(copy)).withColumn(
        copy, F.explode(F.sequence(first, F.least(F.col(total), first + CHUNK) - 1))
    )
    return once.unionByName(more).select(*[col(c) for c in docs.columns])
