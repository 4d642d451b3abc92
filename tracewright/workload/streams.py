"""Streaming queries, drained once and compared with the batch oracle; the flagship."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tracewright.operators import dedupe, emission, framing, health, projections
from tracewright.plans.settle import settle, shared_folder
from tracewright.streaming import processors
from tracewright.workload.base import DEFAULTS, EV, query, session_lines, table
from tracewright.workload.framing import _FOLD, _SPLIT


def _folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    """The event table as a file stream."""
    from tracewright.functions.instants import epoch_ms

    processors.prepare(spark)
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return raw.select("event_id", epoch_ms("ts").alias("ms"), "user_id", "event_type", k.alias("k"))


def _drain(spark, stream, mode="append"):
    base = _folder(spark)
    return processors.run_to_table(stream, f"{base}/out", f"{base}/checkpoint", mode)


@query("stream_dedupe", f"{_FOLD} SELECT event_id, ms, user_id, event_type FROM f WHERE keep")
def stream_dedupe(spark, sf):
    e = _events(spark, sf).select("event_id", "ms", "user_id", "event_type")
    return _drain(spark, processors.dedupe_stream(e, ["user_id", "event_type"], "ms", "event_id", 6 * 3600_000))


def _spend(state, row):
    paid = int(row["k"]) if row["event_type"] == "purchase" else 0
    return {"spent": state["spent"] + paid, "last_type": row["event_type"]}


@query("stream_projection", f"""WITH {EV} SELECT user_id, CAST(count(*) AS BIGINT) AS revision, CAST(sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS BIGINT) AS spent, arg_max(event_type, event_id) AS last_type FROM e GROUP BY 1""")
def stream_projection(spark, sf):
    s = processors.project_stream(_events(spark, sf), "user_id", {"spent": 0, "last_type": None}, _spend, "spent bigint, last_type string", "ms", "event_id")
    return processors.latest_updates(_drain(spark, s, "update"), "user_id").drop("top_ms")


@query("stream_interval_join", f"""WITH {EV} SELECT p.event_id, c.event_id AS open_id FROM e p JOIN e c ON p.user_id = c.user_id AND p.k % 3 = c.k % 3 AND c.event_type = 'click' AND p.ms >= c.ms AND p.ms <= c.ms + 43200000 WHERE p.event_type = 'purchase'""")
def stream_interval_join(spark, sf):
    e = _events(spark, sf).withColumns({"at": F.timestamp_millis("ms"), "vehicle": F.col("k") % 3})
    opens = e.where(F.col("event_type") == "click").select("user_id", "vehicle", "at", F.col("event_id").alias("open_id"))
    closes = e.where(F.col("event_type") == "purchase").select("user_id", "vehicle", "at", "event_id")
    joined = processors.interval_join_stream(opens, closes, ["user_id", "vehicle"], "at", "12 HOURS", "2 days")
    return _drain(spark, joined.select("c.event_id", "o.open_id"))


@query("stream_framing", f"""WITH {_SPLIT} SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(line_no AS BIGINT) AS line_no, CAST(byte_offset AS BIGINT) AS byte_offset, part AS text FROM o WHERE part <> '' AND line_no < n""")
def stream_framing(spark, sf):
    """Documents cut into 700-byte chunks, landed as files, framed across chunk borders."""
    processors.prepare(spark)
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.encode("text", "UTF-8").alias("_all"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("(octet_length(_all) - 1) div 700")).cast("int"))).alias("_i")
    cut = d.select("source_id", "_all", at).select(
        "source_id",
        F.lit(1).cast("bigint").alias("generation"),
        F.col("_i").cast("bigint").alias("sequence"),
        (F.col("_i") * 700).cast("bigint").alias("offset_start"),
        F.expr("cast(least((_i + 1) * 700, octet_length(_all)) as bigint)").alias("offset_end"),
        F.octet_length("_all").cast("bigint").alias("file_size"),
        F.lit("2024-01-01").cast("timestamp").alias("observed_at"),
        F.lit("2024-01-01").cast("timestamp").alias("ingested_at"),
        F.expr("substring(_all, _i * 700 + 1, 700)").alias("bytes"),
    )
    landed = f"{_folder(spark)}/chunks"
    cut.write.parquet(landed)
    from tracewright.sources.logs import read_chunks

    lines = _drain(spark, processors.frame_stream(read_chunks(spark, landed)))
    return lines.select("source_id", "line_no", "byte_offset", "text")


@query("stream_handoff", f"""WITH {EV} SELECT user_id, CAST(count(*) AS BIGINT) AS revision, CAST(sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS BIGINT) AS spent, arg_max(event_type, event_id) AS last_type FROM e GROUP BY 1""")
def stream_handoff(spark, sf):
    """A batch projection of the stored history continues as a stream over the live part."""
    from tracewright.workload.base import events

    half = 1705500000000
    stored = events(spark, sf).where(F.col("ms") < half)
    spend = projections.Projection("spend", 1, lambda: {"spent": 0, "last_type": None, "top_ms": 0},
                                   lambda s, r: {**_spend(s, r), "top_ms": max(s["top_ms"], int(r["ms"]))},
                                   "spent bigint, last_type string, top_ms bigint")
    history = settle(projections.project(stored, spend, ["event_id"], ["event_type", "k", "ms"], key="user_id"))
    start = history.select("user_id", "revision", "top_ms", "spent", "last_type")
    live = _events(spark, sf).where(F.col("ms") >= half)
    s = processors.project_stream(live, "user_id", {"spent": 0, "last_type": None}, _spend, "spent bigint, last_type string", "ms", "event_id",
                                  initial_state=start)
    moved = processors.latest_updates(_drain(spark, s, "update"), "user_id").drop("top_ms")
    idle = start.join(moved.select("user_id"), "user_id", "left_anti").select("user_id", "revision", "spent", "last_type")
    return moved.select("user_id", "revision", "spent", "last_type").unionByName(idle)


_TYPE = """CASE event_type WHEN 'signup' THEN 'loading' WHEN 'error' THEN 'disconnected' END"""


@query("flagship", f"""WITH {EV}, s AS (SELECT user_id, arg_max({_TYPE}, event_id) FILTER (WHERE event_type IN ('signup', 'error')) AS state, count(*) AS events FROM e GROUP BY 1)
SELECT 'LIVE::PU::4.9.188.23497::UNKNOWN::src_' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS environment_key, state, CAST(events AS BIGINT) AS records, CAST(0 AS BIGINT) AS unknown, 'compatible' AS status FROM s""")
def flagship(spark, sf):
    """Log lines to life-cycle state and parser health per environment."""
    records = framing.records_of(session_lines(spark, sf))
    parsed = emission.parse_records(records, spark, DEFAULTS)
    # a new generation of a source starts over: its lines are numbered anew and its events are no repeats of the older ones
    scope = ["environment_key", "source_id", "generation", "event_type", "dedupe_id"]
    found = settle(parsed.events)
    kept = dedupe.dedupe_bounded(found, scope, "ts_ms", "line_no", dedupe.family_window(F.col("event_type")))
    life = projections.project_lifecycle(kept).select("environment_key", "state")
    judged = health.health_of(replace(parsed, events=kept)).select("environment_key", "records", "unknown", "status")
    return judged.join(life, "environment_key", "left").select("environment_key", "state", "records", "unknown", "status")
