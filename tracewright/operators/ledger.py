"""Qualified inventory changes, snapshot consistency, and applying changes to balances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.identity import digest

KINDS = ["acquire", "sale", "drop", "loss"]


def qualified_changes(changes: DataFrame, context: Sequence[str], identity: Sequence[str], content: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Changes that qualify, once per id, and rejected ids with a reason.

    Allowed kinds, confirmed or high confidence, observed or inferred, whole positive counts of items. The id is a digest
    over context, event and rule; the same id with different content is rejected.
    """
    ok = (
        F.col("kind").isin(*KINDS)
        & F.col("confidence").isin("confirmed", "high")
        & F.col("provenance").isin("observed", "inferred")
        & (F.col("unit") == "items")
        & (F.col("quantity") > 0)
        & (F.col("quantity") == F.floor("quantity"))
    )
    marked = changes.withColumns(
        {
            "change_id": digest([F.col(c) for c in (*context, *identity)], 64),
            "_content": digest([F.col(c) for c in content], 64),
            "_ok": F.coalesce(ok, F.lit(False)),
        }
    )
    rest = [c for c in changes.columns]
    grouped = (
        marked.where("_ok")
        .groupBy("change_id")
        .agg(
            F.min("_content").alias("_lo"),
            F.max("_content").alias("_hi"),
            F.min(F.struct(*rest)).alias("_row"),
            F.count(F.lit(1)).alias("offers"),
        )
    )
    same = F.col("_lo") == F.col("_hi")
    accepted = grouped.where(same).select("change_id", "_row.*", "offers")
    clashing = grouped.where(~same).select("change_id", F.lit("conflicting_content").alias("reason"))
    unfit = marked.where(~F.col("_ok")).select("change_id", F.lit("not_qualified").alias("reason")).distinct()
    return accepted, clashing.unionByName(unfit)


def snapshot_consistency(pages: DataFrame, keys: Sequence[str], agree: Sequence[str], ident: str, page: str, complete: str) -> DataFrame:
    """Per snapshot: pages must agree on ``agree``, ids must be unique, and only the last page closes it."""
    items = pages.groupBy(*keys, ident).agg(F.count(F.lit(1)).alias("_n"))
    unique = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("_n") > 1).alias("duplicates"))
    agg = pages.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in agree],
        *[F.max(c).alias(f"_hi_{c}") for c in agree],
        F.max(page).alias("_last"),
        F.min(F.when(F.col(complete), F.col(page))).alias("_closed"),
    )
    changed = F.lit(False)
    for c in agree:
        changed = changed | (F.col(f"_lo_{c}") != F.col(f"_hi_{c}"))
    status = (
        F.when(changed, "changed_during_pagination")
        .when(F.col("duplicates") > 0, "duplicate_ids")
        .when(F.col("_closed").isNull() | (F.col("_closed") != F.col("_last")), "not_closed")
        .otherwise("consistent")
    )
    return agg.join(unique, list(keys)).select(*keys, "items", "duplicates", status.alias("status"))


def apply_changes(changes: DataFrame, inventory: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Before and after quantity per change, or why it conflicts.

    Several inventory rows for the item, none (unless it is an acquisition of an exactly known item), another unit or a
    negative result are conflicts. The inventory is reduced to one row per item before the join.
    """
    held = inventory.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("quantity").alias("_quantity"), F.min("unit").alias("_unit")
    )
    exact = catalogue.where(F.col("status") == "exact").select("item_id").distinct().withColumn("_known", F.lit(True))
    rows = changes.join(held, "item_id", "left").join(exact, "item_id", "left")
    acquire = F.col("kind") == "acquire"
    n = F.coalesce("_rows", F.lit(0))
    before = F.coalesce("_quantity", F.lit(0))
    after = before + F.when(acquire, F.col("quantity")).otherwise(-F.col("quantity"))
    status = (
        F.when(n > 1, "ambiguous_mapping")
        .when((n == 0) & ~(acquire & F.coalesce("_known", F.lit(False))), "no_mapping")
        .when((n == 1) & (F.col("_unit") != F.col("unit")), "unit_mismatch")
        .when(after < 0, "negative_balance")
        .otherwise("applicable")
    )
    return rows.select(
        *changes.columns,
        status.alias("status"),
        F.when(status == "applicable", before).alias("before"),
        F.when(status == "applicable", after).alias("after"),
    )


def operation_status(reported: Column) -> Column:
    """Stored status for a reported operation status."""
    return (
        F.when(reported.isin("applied", "duplicate"), "applied")
        .when(reported == "pending", "unknown")
        .when(reported.isin("rejected", "conflict"), reported)
    )
