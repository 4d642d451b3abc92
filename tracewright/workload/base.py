"""Registry of the driver queries and the inputs they share.

Every query reads whole driver tables. Log lines are rendered from ``events`` with plain expressions, one line per event,
so that the expected parse can be stated in SQL without rendering anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.instants import epoch_ms, iso_ms
from tracewright.plans.settle import fenced
from tracewright.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Text-heavy tables in fewer files than cores are spread over the cores first; with many files
    (any large table) the scan is parallel as it is.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("events", "documents", "conversations") and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table: epoch milliseconds, environment by user, correlation number ``k`` from the properties."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        epoch_ms("ts").alias("ms"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        F.concat(F.lit("env"), (F.col("user_id") % 3).cast("string")).alias("env"),
    )


#: the same table for the oracles
EV = """e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, value,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, 'env' || (user_id % 3) AS env FROM events)"""

#: event type -> type name of the event contract
TYPES = {
    "signup": "PuJoinRequested",
    "click": "MonitoredSpaceEntered",
    "view": "ArmisticeStateChanged",
    "purchase": "MissionAccepted",
    "error": "PuDisconnected",
}


def sql_case(mapping: dict[str, str], column: str = "event_type") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def type_name(column: str = "event_type") -> Column:
    out = F.lit(None).cast("string")
    for k, v in TYPES.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def as_lines(e: DataFrame, text: Column) -> DataFrame:
    """One line per event: source = user, line number and offset = event id (ids follow time)."""
    rendered = e.select(
        F.col("user_id").cast("string").alias("source_id"),
        F.lit(0).cast("bigint").alias("generation"),
        F.col("event_id").alias("line_no"),
        F.col("event_id").alias("byte_offset"),
        text.alias("text"),
    )
    # rendered once per line, as if read from a log table
    return fenced(rendered).withColumn("byte_length", F.octet_length("text").cast("bigint") + 1)


def stamp(ms: Column | None = None) -> Column:
    return F.concat(F.lit("<"), iso_ms(F.col("ms") if ms is None else ms), F.lit("> "))


def pick(**cases: Column) -> Column:
    """A value by event type."""
    out = F.lit(None)
    for t, c in cases.items():
        out = F.when(F.col("event_type") == t, c).otherwise(out)
    return out


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def session_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the reviewed 4.9 build: joins, disconnects and notifications."""
    e = events(spark, sf)
    note = '[Notice] <SHUDEvent_OnNotification> Added notification "'
    end = ' to queue. New queue size: 1, MissionId: ['
    k, ident, user = F.col("k"), F.col("event_id"), F.col("user_id")
    body = pick(
        signup=text("<Join PU> address[host", k, ".example.invalid] port[", k + 64000, "] shard[shard_", k % 7,
                    "] locationId[loc", user, "]"),
        click=text(note, 'Entered Monitored Space: " [', ident, "]", end, "m0], ObjectiveId: []"),
        view=text(note, F.when(k % 2 == 0, "Entering Armistice Zone - Combat Prohibited").otherwise(
            "Leaving Armistice Zone - Caution Advised"), ': " [', ident, "]", end, "m0], ObjectiveId: []"),
        purchase=text(note, "Contract Accepted:  job ", k, ': " [', ident, "]", end, "mission", ident, "], ObjectiveId: []"),
        error=text('[Notice] <Channel Disconnected> cause=', k + 30000, ' reason="why', k % 5,
                   '" isRemote=', k % 2, ' gamerules="SC_Default" remoteAddr=host', k, ".example.invalid:", k + 64000,
                   " uptime_secs=", k, ".5"),
    )
    return as_lines(e, F.concat(stamp(), body))


DEFAULTS = {"channel": "LIVE", "build": "4.9.188.23497"}
