"""Blueprint notifications to a de-duplicated catalogue, with per-file reports and the export contract."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.constants import BLUEPRINT_LABEL, BLUEPRINT_PARSER_VERSION, BLUEPRINT_PROFILES
from tracewright.functions.text import group, trim_ws


def blueprint_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(b, p) for p, builds in BLUEPRINT_PROFILES.items() for b in builds], "build string, profile_id string"
    )


def header_build(first_line: Column) -> Column:
    return group(first_line, r"(?i)Build\((\d+)\)", 1)


def blueprint_name(text: Column, labels: Sequence[str] = (BLUEPRINT_LABEL,)) -> Column:
    """Name in a blueprint notification; null for other lines."""
    found = []
    for label in labels:
        words = r"\s+".join(re.escape(w) for w in label.split())
        found.append(group(text, rf'(?i)Added notification "{words}\s*:\s*([\s\S]*?):\s*"\s*\[\d+\]\s+to queue\.', 1))
    raw = F.when(F.contains(text, F.lit("Added notification")), F.coalesce(*found))
    return F.nullif(F.regexp_replace(trim_ws(raw), r"\s+", " "), F.lit(""))



def _compat_lower(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower())


def name_key(name: Column) -> Column:
    """Compatibility-normalized lower-case key. Plain ASCII names stay in the JVM."""
    return F.when(name.rlike(r"^[\x00-\x7f]*\z"), F.lower(name)).otherwise(F.pandas_udf(_compat_lower, "string")(name))


def blueprint_observations(lines: DataFrame, files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Observed names of approved builds: ``lines`` (source_id, line_no, text), ``files`` (source_id, rank, build)."""
    approved = files.join(profiles, "build")
    return (
        lines.withColumn("name", blueprint_name(F.col("text")))
        .where(F.col("name").isNotNull())
        .join(approved, "source_id")
        .select("source_id", "rank", "line_no", "name", "build", "profile_id", group(F.col("text"), r"^<([^>]+)>", 1).alias("stamp"))
    )


def blueprint_catalogue(observations: DataFrame) -> DataFrame:
    """One record per name key: the first observation in file and line order, and how many more there were.

    Names are counted as written before the key is computed, so the normalization runs once per distinct spelling and
    the second step sees one row per spelling.
    """
    spelled = observations.groupBy("name").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("rank", "line_no", "source_id", "build", "profile_id", "stamp")).alias("_first"),
    )
    keyed = spelled.withColumn("name_key", name_key(F.col("name")))
    out = keyed.groupBy("name_key").agg(
        F.min(F.struct("_first", "name")).alias("_f"), (F.sum("_n") - 1).alias("duplicates")
    )
    return out.select(
        "name_key",
        F.col("_f.name").alias("name"),
        F.lit("").alias("type"),
        F.lit(None).cast("boolean").alias("shared"),
        "_f._first.source_id",
        "_f._first.line_no",
        "_f._first.build",
        "_f._first.profile_id",
        "_f._first.stamp",
        "duplicates",
        F.lit(BLUEPRINT_PARSER_VERSION).alias("parser_version"),
    )


def scan_report(lines: DataFrame, files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per file: status, lines read, recognized and unrecognized notifications."""
    counts = lines.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(blueprint_name(F.col("text")).isNotNull()).alias("recognized"),
        F.count_if(F.contains("text", F.lit("Added notification")) & blueprint_name(F.col("text")).isNull()).alias("unrecognized"),
    )
    known = files.join(profiles, "build", "left").join(counts, "source_id", "left")
    ok = F.col("profile_id").isNotNull()
    zero = F.lit(0).cast("bigint")
    return known.select(
        "source_id",
        "build",
        F.when(ok, "ready").otherwise("unsupported").alias("status"),
        *[F.when(ok, F.coalesce(c, zero)).otherwise(zero).alias(c) for c in ("lines", "recognized", "unrecognized")],
    )


def validate_catalogue(records: DataFrame) -> DataFrame:
    """Defects of export records (name, type, shared, name_key) as (name, reason)."""
    checks = F.array_compact(
        F.array(
            F.when((F.trim(F.coalesce("name", F.lit(""))) == "") | (F.length("name") > 512), F.lit("invalid_name")),
            F.when(F.col("type").isNull() | (F.length("type") > 256), F.lit("invalid_type")),
        )
    )
    single = records.select("name", F.explode(checks).alias("reason"))
    twice = records.groupBy("name_key").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("name")).where("_n > 1")
    return single.unionByName(twice.select("name", F.lit("duplicate_name").alias("reason")))
