"""Privacy scan, public views, masking, retention and scoped deletion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import DAY_MS, RETENTION_DAYS
from tracewright.functions.privacy import (
    privacy_hits,
    redact_endpoint,
    redact_id,
    sanitize_map,
    sensitive_key,
    with_redaction,
)
from tracewright.plans.settle import fenced

SENSITIVE = ["personal", "social", "secret"]


def redact(rows: DataFrame, column: str, base: Column | None = None, limit: int = 320) -> DataFrame:
    """Add ``snippet``, ``kinds``, ``sensitivity`` and ``applied`` for a text column."""
    return fenced(with_redaction(rows, column, base, limit))


def privacy_scan(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """How many rows per key match each sensitive pattern."""
    hits = rows.select(*keys, F.explode(privacy_hits(F.col(column))).alias("pattern"))
    return hits.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("rows"))


def public_view(rows: DataFrame, ids: Sequence[str] = (), endpoints: Sequence[str] = ()) -> DataFrame:
    """A projection with identifiers and endpoints shortened."""
    return rows.withColumns(
        {**{c: redact_id(F.col(c)) for c in ids}, **{c: redact_endpoint(F.col(c)) for c in endpoints}}
    )


def evidence_detail(events: DataFrame, sensitivity: str = "sensitivity", payload: str = "payload") -> DataFrame:
    """Payload replaced for sensitive events, sanitized for the others, with the availability of the evidence."""
    hidden = F.col(sensitivity).isin(*SENSITIVE)
    masked = F.create_map(F.lit("redacted"), F.lit("true"))
    return events.withColumns(
        {
            payload: F.when(hidden, masked).otherwise(sanitize_map(F.col(payload))),
            "availability": F.when(hidden, "redacted").otherwise("available"),
        }
    )


def sanitize_report(rows: DataFrame, column: str) -> DataFrame:
    """Number of masked map keys per category."""
    keys = rows.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    named = keys.withColumn("category", sensitive_key(F.col("key"))).where(F.col("category").isNotNull())
    return named.groupBy("category").agg(F.sum("_n").alias("rows"))


def apply_retention(
    events: DataFrame,
    now_ms: int | Column,
    days: float = RETENTION_DAYS,
    environment: str | None = None,
    ingested: str = "ingested_ms",
    before: Callable[[], None] | None = None,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """Rows that stay: not older than the cut-off, or of another environment when one is named."""
    if before:
        before()
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    stays = F.col(ingested) >= now - int(days * DAY_MS)
    if environment is not None:
        stays = stays | (F.col("environment_key") != environment)
    kept = events.where(stays)
    if after:
        after()
    return kept


def delete_scope(events: DataFrame, environment: str | None = None, sensitive_only: bool = False) -> DataFrame:
    """Rows that stay after deleting an environment, the sensitive rows, or (without a scope) everything."""
    if environment is not None and not sensitive_only:
        return events.where(F.col("environment_key") != environment)
    if sensitive_only:
        gone = F.col("sensitivity").isin(*SENSITIVE)
        if environment is not None:
            gone = gone & (F.col("environment_key") == environment)
        return events.where(~gone)
    return events.limit(0)


def delete_checkpoints(checkpoints: DataFrame, events: DataFrame, sensitive_only: bool = True) -> DataFrame:
    """Checkpoints that stay: those of environments without sensitive events."""
    hit = events.where(F.col("sensitivity").isin(*SENSITIVE)) if sensitive_only else events
    return checkpoints.join(hit.select("environment_key").distinct(), "environment_key", "left_anti")
