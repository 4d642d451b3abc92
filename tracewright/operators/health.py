"""Parser health as events of the event table: the verdict of each environment, and a suspicion of drift where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import DRIFT_MIN_RECORDS, DRIFT_MIN_UNKNOWN, DRIFT_RATIO
from tracewright.functions.identity import scoped_id
from tracewright.operators.contracts import envelope, validate_events
from tracewright.operators.rules import health_verdict

STATUS, DRIFT = "ParserCompatibilityStatusObserved", "ParserDriftSuspected"
#: Markers of the evidence reference of the two events
MARKERS = {STATUS: "parser-health:compatibility", DRIFT: "parser-health:drift"}
PARSER = "runtime-log-parser/0.1.0"


def with_verdict(
    counted: DataFrame, compatible: Column | None = None, incompatible_reason: Column | None = None, drifted: Column | None = None,
    min_records: int = DRIFT_MIN_RECORDS, min_unknown: int = DRIFT_MIN_UNKNOWN, ratio: float = DRIFT_RATIO,
) -> DataFrame:
    """Counts per environment (``records``, ``unknown``) with ``status``, ``reason`` and ``ratio``."""
    verdict = health_verdict(
        F.col("records"), F.col("unknown"), F.lit("compatible") if compatible is None else compatible,
        F.lit("build_not_tested") if incompatible_reason is None else incompatible_reason,
        F.lit(False) if drifted is None else F.coalesce(drifted, F.lit(False)), min_records, min_unknown, ratio,
    )
    return counted.withColumn("_v", verdict).select(*counted.columns, "_v.*")


def _payload(kind: str) -> Column:
    values = {
        "profileId": F.col("profile_id"), "profileVersion": F.col("profile_version"), "reason": F.col("reason"),
        "recordsSeen": F.col("records"), "knownEventsEmitted": F.col("emitted"), "unknownRecords": F.col("unknown"),
    }
    if kind == STATUS:
        values |= {"status": F.col("status"), "unknownSampleCount": F.col("samples"), "droppedUnknownSamples": F.col("dropped")}
    else:
        values["unknownRatio"] = F.col("ratio").cast("decimal(7,6)")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def health_events(health: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid health events in the envelope of the event table, and those that break the contract with their ``errors``.

    ``health`` has one row per environment and check: environment_key, profile_id, profile_version, records, emitted, unknown, samples, dropped,
    status, reason, ratio, checked_ms. The same counts give the same event id, so a check that is run again adds nothing.
    """
    zero = F.lit(0).cast("bigint")
    given = health.withColumns({c: F.coalesce(F.col(c), zero) for c in ("records", "emitted", "unknown", "samples", "dropped")})
    drift = F.when(F.col("status") == "suspected_drift", F.struct(F.lit(DRIFT).alias("event_type"), _payload(DRIFT).alias("payload"), F.lit(2).alias("at")))
    status = F.struct(F.lit(STATUS).alias("event_type"), _payload(STATUS).alias("payload"), F.lit(1).alias("at"))
    rows = given.select("*", F.inline(F.array_compact(F.array(status, drift))))
    told = F.when(F.col("event_type") == STATUS, F.col("status")).otherwise(F.col("reason"))
    same = [F.col("event_type"), F.col("profile_id"), F.col("profile_version"), told, F.col("records"), F.col("unknown")]
    marker = F.lit(None).cast("string")
    for kind, text in MARKERS.items():
        marker = F.when(F.col("event_type") == kind, text).otherwise(marker)
    full = rows.select(
        "environment_key", "event_type", "payload", "profile_id", "profile_version", F.lit(PARSER).alias("parser_version"),
        scoped_id(F.col("environment_key"), "parser_health", same).alias("dedupe_id"), F.col("checked_ms").alias("ts_ms"),
        F.lit("parser-health").alias("source_id"), zero.alias("generation"), F.col("at").cast("bigint").alias("byte_offset"),
        F.col("records").alias("line_no"), F.lit("observed").alias("provenance"),
        F.when(F.col("status") == "compatible", "high").otherwise("medium").alias("confidence"),
        F.array().cast("array<string>").alias("contributors"), marker.alias("marker"),
    )
    valid, rejected = validate_events(full, [STATUS, DRIFT])
    return envelope(valid), rejected


def window_health(windows: DataFrame, key: str = "environment_key", **limits) -> DataFrame:
    """Closed windows (``window``, ``records``, ``unknown``) as health rows, checked at the end of their window."""
    end = F.unix_millis(F.col("window.end"))
    counted = windows.select(
        F.col(key).alias("environment_key"), "records", "unknown", (F.col("records") - F.col("unknown")).alias("emitted"),
        F.lit("windowed").alias("profile_id"), F.lit("1").alias("profile_version"), F.lit(0).cast("bigint").alias("samples"),
        F.lit(0).cast("bigint").alias("dropped"), end.alias("checked_ms"),
    )
    return with_verdict(counted, **limits)


def health_of(parsed, build_reason: str = "build_not_tested") -> DataFrame:
    """Health rows per environment of one parse: records, events emitted, unknown records, drifted families, and the verdict.

    ``parsed`` is what ``emission.parse_records`` returns. An environment without a profile is ``unsupported_profile``. A record counts as unknown once,
    however many rules it failed.
    """
    place = ["environment_key", "source_id", "generation", "byte_offset"]
    zero = F.lit(0).cast("bigint")
    seen = parsed.records.groupBy("environment_key").agg(
        F.count(F.lit(1)).alias("records"), F.max("status").alias("_status"), F.max("profile_id").alias("profile_id"), F.max("ts_ms").alias("checked_ms"),
    )
    unknown = parsed.unknown.select(*place).distinct().groupBy("environment_key").agg(F.count(F.lit(1)).alias("unknown"))
    emitted = parsed.events.groupBy("environment_key").agg(F.count(F.lit(1)).alias("emitted"))
    drifted = parsed.drifted.groupBy("environment_key").agg(F.sort_array(F.collect_set("family")).alias("drifted_families"))
    joined = seen.join(unknown, "environment_key", "left").join(emitted, "environment_key", "left").join(drifted, "environment_key", "left")
    filled = joined.withColumns(
        {"unknown": F.coalesce("unknown", zero), "emitted": F.coalesce("emitted", zero), "samples": zero, "dropped": zero,
         "compat": F.when(F.col("profile_id").isNull(), "unsupported_profile").otherwise(F.coalesce("_status", F.lit("unsupported_profile"))),
         "why": F.when(F.col("profile_id").isNull(), "no_compatible_profile").otherwise(build_reason),
         "profile_id": F.coalesce("profile_id", F.lit("unsupported_profile")), "profile_version": F.lit("1")}
    ).drop("_status")
    return with_verdict(filled, F.col("compat"), F.col("why"), F.col("drifted_families").isNotNull()).drop("compat", "why")


def diagnostics_of(parsed) -> DataFrame:
    """What went wrong in one parse, as ``(source_id, generation, line_no, byte_offset, code, severity, detail)``.

    Matches whose payloads contradict each other, events that break the contract, matches without a required field, generations after the first of
    a source, and environments without a profile (at their first record). Positions that a step does not know are null.
    """
    lane = ["source_id", "generation"]
    none = F.lit(None).cast("bigint")

    def rows(df: DataFrame, code: str, severity: str, detail: Column, line: Column | None = None) -> DataFrame:
        at = F.col("byte_offset") if "byte_offset" in df.columns else none
        number = line if line is not None else F.col("line_no") if "line_no" in df.columns else none
        return df.select(*lane, number.cast("bigint").alias("line_no"), at.alias("byte_offset"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"))

    first = F.min(F.struct("generation", "byte_offset", "line_no"))
    starts = parsed.records.groupBy(*lane).agg(F.min(F.struct("byte_offset", "line_no")).alias("_at"))
    oldest = parsed.records.groupBy("source_id").agg(F.min("generation").alias("_oldest"))
    later = starts.join(oldest, "source_id").where("generation > _oldest").select(*lane, "_at.byte_offset", "_at.line_no")
    bare = parsed.records.where("profile_id is null").groupBy("environment_key", "source_id").agg(first.alias("_f"))
    bare = bare.select("environment_key", "source_id", "_f.generation", "_f.byte_offset", "_f.line_no")
    parts = [
        rows(parsed.conflicts, "match_conflict", "error", F.col("event_type")),
        rows(parsed.rejected, "event_validation_failed", "error", F.concat(F.col("event_type"), F.lit(" "), F.array_join("errors", " "))),
        rows(parsed.incomplete, "missing_required_fields", "warn", F.concat(F.col("event_type"), F.lit(" "), F.array_join("missing", " "))),
        rows(later, "source_generation_changed", "warn", F.concat(F.lit("generation "), F.col("generation").cast("string"))),
        rows(bare, "unsupported_profile", "warn", F.col("environment_key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
