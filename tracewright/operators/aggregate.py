"""Store summaries, unknown-evidence buckets, facets, headline summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import NOISE_CATEGORY, SENSITIVITY_LEVELS, UNKNOWN_CATEGORIES, UNKNOWN_POLICY
from tracewright.functions.identity import digest
from tracewright.functions.privacy import infer_sensitivity, sensitivity_name, sensitivity_rank, with_redaction
from tracewright.functions.text import evidence_markers
from tracewright.plans.scans import TARGET_ROWS, scan, split_keys, total
from tracewright.plans.settle import fenced


def store_health(events: DataFrame, ms: str, environment: str) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.min(ms).alias("oldest_ms"),
        F.max(ms).alias("newest_ms"),
        F.count_distinct(environment).alias("environments"),
    )


def storage_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("sensitivity").agg(F.count(F.lit(1)).alias("events"))


# --- unknown evidence -------------------------------------------------------------------------------------------------
def classify_unknown(unmatched: DataFrame, text: str, reason: str) -> DataFrame:
    """Category, markers, sensitivity and redacted snippet of unmatched records.

    The leading timestamp is neither a marker nor part of the fingerprint, so equal evidence at different times meets in
    one bucket.
    """
    body = F.regexp_replace(F.col(text), r"^<\d{4}-\d{2}-\d{2}T[^>]*>\s*", "")
    first = unmatched.withColumns(
        {"_body": body, "_why": F.when(F.col(reason).rlike(r"^[a-z][a-z0-9_]{1,80}\z"), F.col(reason)).otherwise("no_profile_match")}
    )
    marked = first.withColumn("markers", F.array_distinct(evidence_markers(F.col("_body"))))
    staged = fenced(with_redaction(marked, "_body").withColumnsRenamed({"sensitivity": "_level", "applied": "redacted"}))
    low = (
        (F.size("markers") == 0)
        | F.col("_body").rlike(r"(?i)^\s*(?:\[[^\]]+\]\s*)?(?:debug|trace|verbose)(?!\w)")
        | F.col("_body").rlike(r"(?i)<[^>]*(?:noise|debug|trace|verbose)[^>]*>")
    )
    known = F.create_map(*[x for k, v in UNKNOWN_CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
    why = F.col("_why")
    category = F.when(low & (why == "no_profile_match"), NOISE_CATEGORY).otherwise(
        F.coalesce(F.try_element_at(known, why), F.concat(F.lit("parser."), why))
    )
    rank = F.greatest(sensitivity_rank(infer_sensitivity(F.col("_body"))), sensitivity_rank(F.col("_level")))
    named = staged.withColumns(
        {
            "low_value": low,
            "category": category,
            "sensitivity": sensitivity_name(rank),
            "bytes": F.octet_length(text),
        }
    )
    return named.withColumn(
        "fingerprint",
        digest(
            [F.col("category"), why, F.when(F.col("low_value"), "").otherwise(F.col("snippet")), F.array_join("markers", "\n")], 32
        ),
    ).drop("_body", "_level", "_why")


def unknown_buckets(classified: DataFrame, keys: Sequence[str], ms: str) -> DataFrame:
    """One row per (keys, category, fingerprint): counts, bytes, first and last time, highest sensitivity."""
    rank = sensitivity_rank(F.col("sensitivity"))
    return (
        classified.groupBy(*keys, "category", "fingerprint")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum("bytes").alias("bytes"),
            F.min(ms).alias("first_ms"),
            F.max(ms).alias("last_ms"),
            F.max(rank).alias("_rank"),
            F.max("redacted").alias("redacted"),
            F.max("low_value").alias("low_value"),
        )
        .withColumn("sensitivity", sensitivity_name(F.col("_rank")))
        .drop("_rank")
    )


def unknown_samples(
    classified: DataFrame, keys: Sequence[str], order: Sequence[str], policy: dict | None = None, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Samples kept per bucket: the first few records, for noise every n-th, within a byte budget per environment.

    Candidate samples are found by a running count over the bucket; the budget of an environment (the first of ``keys``)
    is spent in order over those candidates. Taking the prefix that fits makes the cap exact up to the first sample that
    does not fit.
    """
    p = {**UNKNOWN_POLICY, **(policy or {})}
    bucket = [*keys, "category", "fingerprint"]
    cut, lane = split_keys(classified, bucket, order, target_rows)
    counted = scan(cut, lane, {"nth": total(F.lit(1).cast("bigint"))})
    noise = F.col("low_value")
    due = F.when(noise, (F.col("nth") == 1) | (F.col("nth") % p["noise_sample_every"] == 0)).otherwise(F.lit(True))
    slot = F.when(noise, F.when(F.col("nth") == 1, 1).otherwise(F.floor(F.col("nth") / p["noise_sample_every"]) + 1)).otherwise(F.col("nth"))
    able = counted.where(due & (slot <= p["samples_per_bucket"]) & (F.length("snippet") > 0)).drop("_chunk")
    sized = able.withColumn("snippet_bytes", F.octet_length("snippet").cast("bigint"))
    cut2, lane2 = split_keys(sized, [keys[0]], order, target_rows)
    spent = scan(cut2, lane2, {"_n": total(F.lit(1).cast("bigint")), "_bytes": total(F.col("snippet_bytes"))})
    fits = (F.col("_n") <= p["max_samples"]) & (F.col("_bytes") <= p["max_total_sample_bytes"])
    return spent.where(fits).drop("_n", "_bytes", "_chunk")


def unknown_summary(buckets: DataFrame, environment: str, build: str) -> DataFrame:
    """Totals per (environment, build), per environment and overall."""
    return buckets.rollup(environment, build).agg(
        F.count(F.lit(1)).alias("buckets"),
        F.sum("records").alias("records"),
        F.sum("bytes").alias("bytes"),
        F.min("first_ms").alias("oldest_ms"),
        F.max("last_ms").alias("newest_ms"),
    )


def facet_counts(rows: DataFrame, facets: dict[str, Sequence[str]]) -> DataFrame:
    """How often each value occurs in any field of a facet; a row counts once per matching field."""
    pairs = [
        F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, cols in facets.items() for c in cols
    ]
    return (
        rows.select(F.inline(F.array(*pairs)))
        .where(F.coalesce("value", F.lit("")) != "")
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def current_summary(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """One wide row of headline facts per environment from projections keyed by ``key``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full_outer")
    return out


def append_report(attempted: DataFrame, inserted: DataFrame) -> DataFrame:
    """Counts of attempted, inserted and duplicate rows."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    marks = attempted.select(one.alias("a"), zero.alias("i")).unionByName(inserted.select(zero.alias("a"), one.alias("i")))
    counts = marks.agg(F.coalesce(F.sum("a"), zero).alias("attempted"), F.coalesce(F.sum("i"), zero).alias("inserted"))
    return counts.withColumn("duplicates", F.col("attempted") - F.col("inserted"))


def sensitivity_lattice() -> list[str]:
    return list(SENSITIVITY_LEVELS)


def expire_buckets(buckets: DataFrame, now_ms: int | Column, retention_ms: int) -> DataFrame:
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return buckets.where(F.col("last_ms") >= now - retention_ms)
