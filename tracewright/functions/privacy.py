"""Redaction, sensitivity and privacy patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import PRIVACY_PATTERNS, REDACTIONS, SENSITIVITY_LEVELS
from tracewright.functions.text import WS, trim_ws, truncate_utf8


def sensitivity_rank(level: Column) -> Column:
    """Position in public < local < personal < social < secret; unknown words count as local."""
    rank = F.lit(1)
    for i, name in enumerate(SENSITIVITY_LEVELS):
        rank = F.when(level == name, i).otherwise(rank)
    return rank


def sensitivity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SENSITIVITY_LEVELS]), rank.cast("int") + 1)


def max_sensitivity(*levels: Column) -> Column:
    ranks = [sensitivity_rank(x) for x in levels]
    return sensitivity_name(F.greatest(*ranks) if len(ranks) > 1 else ranks[0])


def infer_sensitivity(text: Column) -> Column:
    edge, end = r"(?<!\w)", r"(?!\w)"
    return (
        F.when(text.rlike(rf"(?i){edge}(?:authorization|auth|token|secret|password|apikey){end}"), "secret")
        .when(text.rlike(rf"(?i){edge}(?:handle|nickname|leader|member){end}\s*[:=\[]"), "social")
        .when(
            text.rlike(
                rf"(?i){edge}(?:accountId|playerGEID|characterGEID|geid|node_id|session|sessionId|loginSessionId){end}\s*[:=\[]"
            ),
            "personal",
        )
        .otherwise("local")
    )


def one_line(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, rf"{WS}*\n{WS}*", " "))


def redact(text: Column) -> Column:
    """Apply the ordered redaction patterns to a one-line text."""
    out = one_line(text)
    for _, pattern, replacement, _ in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def with_redaction(df: DataFrame, column: str, base: Column | None = None, limit: int = 320) -> DataFrame:
    """Add ``snippet``, ``kinds``, ``sensitivity`` and ``applied``.

    The patterns apply one after the other and each kind is tested on the text its pattern would have seen; every step is
    a column of its own, so no pattern is evaluated twice for the next one.
    """
    step = df.withColumns({"_line": one_line(F.col(column)), "_text": one_line(F.col(column))})
    for i, (_, pattern, replacement, _) in enumerate(REDACTIONS):
        step = step.withColumns(
            {f"_hit{i}": F.col("_text").rlike(pattern), "_text": F.regexp_replace("_text", pattern, replacement)}
        )
    hits = [(F.col(f"_hit{i}"), kind, level) for i, (kind, _, _, level) in enumerate(REDACTIONS)]
    kinds = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(k)) for h, k, _ in hits]))))
    ranks = [F.when(h, F.lit(SENSITIVITY_LEVELS.index(level))).otherwise(F.lit(0)) for h, _, level in hits]
    start = sensitivity_rank(base) if base is not None else F.lit(1)
    named = step.withColumns({"snippet": truncate_utf8(F.col("_text"), limit), "kinds": kinds,
                              "sensitivity": sensitivity_name(F.greatest(start, *ranks))})
    applied = (F.size("kinds") > 0) | (F.col("snippet") != F.col("_line"))
    return named.withColumn("applied", applied).select(*df.columns, "snippet", "kinds", "sensitivity", "applied")


def privacy_hits(text: Column) -> Column:
    """Names of the sensitive patterns found in the text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in PRIVACY_PATTERNS]))


def redact_id(value: Column) -> Column:
    """First and last two characters; short values become dots."""
    return F.when(F.length(value) <= 4, F.repeat(F.lit("•"), F.length(value).cast("int"))).otherwise(
        F.concat(F.substring(value, 1, 2), F.lit("…"), F.substring(value, -2, 2))
    )


def redact_endpoint(value: Column) -> Column:
    """``a.b.*.*`` for addresses, a shortened first label for host names."""
    labels = F.split(value, r"\.")
    host = F.element_at(labels, 1)
    short = F.when(F.length(host) <= 4, F.repeat(F.lit("•"), F.length(host).cast("int"))).otherwise(
        F.concat(F.substring(host, 1, 2), F.lit("…"), F.substring(host, -2, 2))
    )
    named = F.array_join(F.concat(F.array(short), F.slice(labels, F.lit(2), F.size(labels))), ".")
    address = F.concat(host, F.lit("."), F.try_element_at(labels, F.lit(2)), F.lit(".*.*"))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(None)).when(
        value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}\z"), address
    ).otherwise(named)


def sanitize_map(value: Column) -> Column:
    """Mask map entries whose key looks sensitive; strip paths and addresses from the others."""

    def entry(key: Column, val: Column) -> Column:
        plain = F.regexp_replace(val, r"(?i)(?:[A-Za-z]:\\|\\\\|/home/|/Users/|/tmp/)[^\s\"']+", "[redacted]")
        plain = F.regexp_replace(plain, r"(?<!\w)(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?(?!\w)", "[redacted]")
        return F.when(sensitive_key(key).isNotNull(), F.lit("[redacted]")).otherwise(plain)

    return F.transform_values(value, entry)


def sensitive_key(key: Column) -> Column:
    """Category of a sensitive key name, null for ordinary keys."""
    hit = key.rlike(
        r"(?i)account|user.?id|stable.?id|event.?id|source.?id|session.?id|identifier|endpoint|address|token|secret"
        r"|password|credential|handle|path"
    )
    return F.when(
        hit,
        F.when(key.rlike("(?i)path"), "path")
        .when(key.rlike("(?i)endpoint|address"), "network_address")
        .when(key.rlike("(?i)token|secret|password|credential"), "credential")
        .otherwise("stable_identifier"),
    )
