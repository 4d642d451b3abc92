"""Instants: ISO-8601 with offset, kept as epoch milliseconds, rendered as UTC text. Independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import group

# --- fixed values: patterns of the log format
_STAMP = r"<(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})?)>"
_INSTANT = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})\z"


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def epoch_ms(ts: Column | str) -> Column:
    return F.floor(epoch_us(ts) / 1000).cast("bigint")


def iso_ms(ms: Column) -> Column:
    """Epoch milliseconds as ``yyyy-MM-ddTHH:mm:ss.SSSZ``."""
    base = F.timestamp_add("SECOND", F.floor(ms / 1000).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    frac = F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0")
    text = F.regexp_replace(base.cast("string"), " ", "T")
    return F.concat(text, F.lit("."), frac, F.lit("Z"))


def stamp_instant(stamp: Column) -> Column:
    """Epoch milliseconds of a stamp already known to look like ``date T time [.fraction] [offset]``.

    Read by position; null for impossible calendar fields or a missing offset. Pass a column, not an extraction: the
    stamp is referenced several times.
    """
    base = F.timestamp_diff(
        "SECOND",
        F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
        F.concat(F.substring(stamp, 1, 10), F.lit(" "), F.substring(stamp, 12, 8)).try_cast("timestamp_ntz"),
    )
    utc = F.endswith(stamp, F.lit("Z"))
    zone = F.substring(stamp, -6, 6)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    offset = zone.rlike(r"^[+-]\d{2}:\d{2}\z") & (hours <= 23) & (minutes <= 59)
    shift = F.when(utc, F.lit(0)).when(
        offset, (hours * 3600 + minutes * 60) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    )
    digits = F.rpad(F.regexp_extract(F.substring(stamp, 20, 10), r"^\.(\d{1,3})", 1), 3, "0")
    return ((base - shift) * 1000 + digits.try_cast("int")).cast("bigint")


def stamp_code(stamp: Column, ms: Column) -> Column:
    """timestamp_missing, timestamp_ambiguous, timestamp_malformed, or null when ``ms`` is known."""
    zoned = stamp.rlike(r"(?:Z|[+-]\d{2}:\d{2})\z")
    return (
        F.when(ms.isNotNull(), F.lit(None).cast("string"))
        .when(stamp.isNull(), "timestamp_missing")
        .when(~zoned, "timestamp_ambiguous")
        .otherwise("timestamp_malformed")
    )


def parse_instant(text: Column) -> Column:
    """Epoch milliseconds of an absolute instant, null when malformed or without an offset."""
    return F.when(text.rlike(_INSTANT), stamp_instant(text))


def log_stamp(text: Column) -> Column:
    """The first bracketed timestamp of a log record, as written."""
    return group(text, _STAMP, 1)


def with_log_instant(df: DataFrame, text: str, ms: str, code: str | None = None, offsetless_utc: bool = False) -> DataFrame:
    """Add the epoch milliseconds of a log text column and optionally why there are none.

    Offset-less stamps count only when UTC is declared.
    """
    stamp = log_stamp(F.col(text))
    if offsetless_utc:
        stamp = F.when(stamp.rlike(r"(?:Z|[+-]\d{2}:\d{2})\z"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    out = df.withColumn("_stamp", stamp).withColumn(ms, stamp_instant(F.col("_stamp")))
    if code:
        out = out.withColumn(code, stamp_code(F.col("_stamp"), F.col(ms)))
    return out.drop("_stamp")


def ordered_within(earlier: Column, later: Column, window_ms: int) -> Column:
    """True when ``0 <= later - earlier <= window_ms``; null times never qualify."""
    gap = later - earlier
    return F.coalesce((gap >= 0) & (gap <= window_ms), F.lit(False))


def freshness_label(ms: Column, now_ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor((now_ms - ms) / 1000)).cast("bigint")
    return (
        F.when(ms.isNull(), "Unknown")
        .when(s < 5, "Now")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
    )


def compact_duration(ms: Column, now_ms: Column) -> Column:
    m = F.greatest(F.lit(0), F.floor((now_ms - ms) / 60000)).cast("bigint")
    h = F.floor(m / 60).cast("bigint")
    rest = F.concat((m % 60).cast("string"), F.lit("m"))
    return F.when(ms.isNull(), "Unknown").when(h > 0, F.concat(h.cast("string"), F.lit("h "), rest)).otherwise(rest)
