"""The event table on Parquet: idempotent append, checkpoints, retention rewrites, and catalogue export/import."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PARTITIONS = ["environment_key", "event_date"]


class EventConflict(Exception):
    """An event id was offered again with different content."""


def identity_hash(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    return events.withColumn("identity_hash", F.sha2(F.to_json(F.struct(*columns)), 256))


def read_events(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or null before the first append. Each batch folder is complete once it has its marker."""
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException:
        return None


def conflicts(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Ids offered with content other than stored, or twice in the batch with different content."""
    inside = batch.groupBy("event_id").agg(F.min("identity_hash").alias("_lo"), F.max("identity_hash").alias("_hi"))
    bad = inside.where(F.col("_lo") != F.col("_hi")).select("event_id")
    if stored is None:
        return bad
    s = stored.select("event_id", F.col("identity_hash").alias("_stored"))
    other = batch.join(s, "event_id").where(F.col("_stored") != F.col("identity_hash")).select("event_id")
    return bad.unionByName(other).distinct()


def new_events(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """One row per id that is not stored yet."""
    rest = [c for c in batch.columns if c != "event_id"]
    once = batch.groupBy("event_id").agg(F.min_by(F.struct(*rest), "identity_hash").alias("_r")).select("event_id", "_r.*")
    return once if stored is None else once.join(stored.select("event_id"), "event_id", "left_anti")


def append_events(spark: SparkSession, batch: DataFrame, path: str, batch_id: int | None = None, checkpoint: DataFrame | None = None) -> dict:
    """Append unseen events; fail before writing when an id carries other content. The checkpoint row is written last.

    ``batch`` carries identity_hash, environment_key and event_date. A batch folder is overwritten as a whole, so running
    the same batch id again replaces its own partial output; events stored by other batches stay what decides newness.
    """
    name = f"b{batch_id:012d}" if batch_id is not None else f"u{uuid.uuid4().hex}"
    stored = read_events(spark, path)
    if stored is not None and batch_id is not None:
        stored = stored.where(F.col("batch").cast("string") != name)
    stored = stored.drop("batch") if stored is not None else None
    if not conflicts(batch, stored).isEmpty():
        raise EventConflict("event id already exists with different content")
    fresh = new_events(batch, stored)
    fresh.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{path}/batch={name}")
    if checkpoint is not None:
        write_checkpoint(checkpoint, f"{path}_checkpoints")
    attempted, inserted = batch.count(), spark.read.parquet(f"{path}/batch={name}").count() if not fresh.isEmpty() else 0
    return {"attempted": attempted, "inserted": inserted, "duplicates": attempted - inserted}


def append_stream(spark: SparkSession, events: DataFrame, path: str, checkpoint_dir: str):
    """Streaming sink: every micro-batch is one idempotent append under its batch id."""
    return (
        events.writeStream.foreachBatch(lambda df, i: append_events(df.sparkSession, df, path, i) and None)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def write_checkpoint(rows: DataFrame, path: str) -> None:
    """Append checkpoint rows (environment_key, name, version, cursor, value, updated_ms)."""
    rows.write.mode("append").parquet(path)


def latest_checkpoints(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The newest checkpoint per environment and name; other versions do not count and mean a rebuild."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("environment_key", "name")]
    latest = rows.groupBy("environment_key", "name").agg(F.max_by(F.struct(*rest), "updated_ms").alias("_c"))
    return latest.select("environment_key", "name", "_c.*").where(F.col("version") == version)


def rewrite(spark: SparkSession, kept: DataFrame, source: str, target: str) -> str:
    """Write the rows that stay to a new table; callers switch to it. The old table is never changed in place."""
    if source == target:
        raise ValueError("rewrite needs a new target")
    kept.write.mode("errorifexists").partitionBy(*PARTITIONS).parquet(f"{target}/batch=u{uuid.uuid4().hex}")
    return target


# --- catalogue files --------------------------------------------------------------------------------------------------
CATALOGUE = "name string, type string, shared boolean"


def export_catalogue(records: DataFrame, fmt: str, path: str, order: Sequence[Column] = ()) -> None:
    """Write (name, type, shared) as JSON, CSV or XML part files, sorted by name across the parts."""
    rows = records.select("name", "type", "shared")
    ordered = rows.orderBy(*(order or [F.col("name")]))
    if fmt == "json":
        ordered.write.option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        ordered.write.option("header", "true").option("quoteAll", "true").option("lineSep", "\r\n").option("nullValue", "").csv(path)
    elif fmt == "xml":
        ordered.write.format("xml").option("rootTag", "blueprints").option("rowTag", "blueprint").option("nullValue", "").save(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def read_catalogue(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.schema(CATALOGUE)
    if fmt == "json":
        return reader.option("multiLine", "false").json(path)
    if fmt == "csv":
        return reader.option("header", "true").option("lineSep", "\r\n").csv(path)
    if fmt == "xml":
        return reader.format("xml").option("rowTag", "blueprint").load(path)
    raise ValueError(f"unknown format {fmt}")
