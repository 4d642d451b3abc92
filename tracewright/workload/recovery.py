"""Queries over living projections: expiry, saved and restored state, replay with live events, snapshots, subscribers, the stored table."""

from __future__ import annotations

from contextlib import suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tracewright.operators import health
from tracewright.operators.golden import golden_diff
from tracewright.plans.settle import settle
from tracewright.sources import store
from tracewright.sources.event_table import EventTable
from tracewright.streaming import processors, registry, timed
from tracewright.streaming.subscribers import FanOut, Subscriber
from tracewright.workload.base import EV, events, query, text
from tracewright.workload.framing import _FOLD
from tracewright.workload.streams import _events, _folder

_DAY = 86_400_000
_QUIET = 2 * _DAY
_LATE = _DAY
_HALF = 1705500000000
#: rows that both halves hold
_SEAM = _HALF - _DAY // 2


def _last_seen(state, row):
    paid = int(row["k"]) if row["event_type"] == "purchase" else 0
    return {"spent": (state["spent"] or 0) + paid, "last_type": row["event_type"]}


ACTIVITY = registry.Definition("activity", 1, _last_seen, "spent bigint, last_type string", {"last_type": _QUIET})
_READS = ["event_type", "k"]


def _changes(spark, source, late=_LATE, initial=None):
    """Changes of the projection over a stream of events, and the folder of its checkpoint."""
    base = _folder(spark)
    stream = registry.project_events(source, ACTIVITY, ["user_id"], "ms", "event_id", _READS, late, initial)
    return registry.drain(stream, f"{base}/out", f"{base}/checkpoint"), f"{base}/checkpoint"


_MOVES = f"""m AS (SELECT *, row_number() OVER w AS revision, lead(ms) OVER w AS next_ms, sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS spent
 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))"""


@query("stream_expiry", f"""WITH {EV}, {_MOVES}
SELECT user_id, 'applied' AS change, CAST(event_id AS VARCHAR) AS event_id, ms AS at_ms, revision, CAST(spent AS BIGINT) AS spent, event_type AS last_type, 'current' AS freshness FROM m
UNION ALL SELECT user_id, 'expired', NULL, ms + {_QUIET}, revision, CAST(spent AS BIGINT), event_type, 'stale' FROM m
WHERE coalesce(next_ms, (SELECT max(ms) - {_LATE} FROM e)) >= ms + {_QUIET}""")
def stream_expiry(spark, sf):
    """Every event and every silence of two days, brought out by timers where no further event comes."""
    changes, _ = _changes(spark, _events(spark, sf))
    return changes.select("user_id", "change", "event_id", "at_ms", "revision", "spent", "last_type", "freshness")


@query("state_restore", f"""WITH {EV}, {_MOVES}, n AS (SELECT user_id, count(*) FILTER (WHERE ms < {_HALF}) AS old, count(*) FILTER (WHERE ms >= {_SEAM} AND ms < {_HALF}) AS again, count(*) FILTER (WHERE ms >= {_HALF}) AS new FROM e GROUP BY 1)
SELECT n.user_id, again AS duplicates, new AS applied, m.revision, CAST(m.spent AS BIGINT) AS spent, m.event_type AS last_type FROM n JOIN m ON n.user_id = m.user_id AND m.next_ms IS NULL WHERE again + new > 0""")
def state_restore(spark, sf):
    """A stream stops half way; its saved state starts another one, which is given half a day of the old events once more."""
    e = _events(spark, sf)
    _, checkpoint = _changes(spark, e.where(F.col("ms") < _HALF))
    saved = registry.save_state(spark, checkpoint, ACTIVITY, f"{_folder(spark)}/saved")
    changes, _ = _changes(spark, e.where(F.col("ms") >= _SEAM), initial=registry.restored(saved, ACTIVITY))
    last = registry.snapshots(changes.where("change <> 'expired'").withColumn("change", F.lit("applied")), ["user_id"])
    counts = changes.groupBy("user_id").agg(
        F.count_if(F.col("change") == "duplicate").alias("duplicates"), F.count_if(F.col("change") == "applied").alias("applied")
    )
    return counts.where("duplicates + applied > 0").join(last, "user_id").select("user_id", "duplicates", "applied", "revision", "spent", "last_type")


@query("replay_live", f"""WITH {EV} SELECT user_id, CASE WHEN ms < {_HALF} THEN 'replay' ELSE 'live' END AS origin, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM e GROUP BY 1, 2""")
def replay_live(spark, sf):
    """Stored events and buffered live ones, some of which are stored or were delivered twice, each once."""
    e = events(spark, sf)
    live = e.where(F.col("ms") >= _SEAM)
    both = registry.replay_live(e.where(F.col("ms") < _HALF), live.unionByName(live.where("event_id % 5 = 0")), "event_id", "ms")
    return both.groupBy("user_id", "origin").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))


@query("recover_state", f"""WITH {EV}, {_MOVES}
SELECT v.mode, m.user_id, m.revision, CAST(m.spent AS BIGINT) AS spent, m.event_type AS last_type FROM m, (VALUES ('full_rebuild'), ('checkpoint_restore')) v(mode) WHERE next_ms IS NULL
AND (v.mode = 'full_rebuild' OR m.ms >= {_SEAM} OR m.user_id IN (SELECT user_id FROM e WHERE ms < {_HALF}))""")
def recover_state(spark, sf):
    """State after a restart: from saved state and what followed, and from all stored events because the saved version is another."""
    e = events(spark, sf)
    _, checkpoint = _changes(spark, _events(spark, sf).where(F.col("ms") < _HALF))
    saved = registry.save_state(spark, checkpoint, ACTIVITY, f"{_folder(spark)}/saved")
    out = None
    for given in (saved, saved.withColumn("version", F.lit(99))):
        stored, live = e.where(F.col("ms") < _HALF + 3 * _DAY), e.where(F.col("ms") >= _HALF + 2 * _DAY)
        mode, changes = registry.recover(stored, live, given, ACTIVITY, ["user_id"], "ms", "event_id", _READS)
        last = registry.snapshots(settle(changes).withColumn("change", F.lit("applied")), ["user_id"])
        rows = last.select(F.lit(mode).alias("mode"), "user_id", "revision", "spent", "last_type")
        out = rows if out is None else out.unionByName(rows)
    return out


_NOW = 1706659200000


@query("snapshots", f"""WITH {EV}, {_MOVES} SELECT user_id, revision, CAST(spent AS BIGINT) AS spent, event_type AS last_type, CASE WHEN {_NOW} - ms >= {_QUIET} THEN 'stale' ELSE 'known' END AS last_type_state,
CASE WHEN {_NOW} - ms >= {_QUIET} THEN 'stale' ELSE 'current' END AS freshness FROM m WHERE next_ms IS NULL""")
def snapshots(spark, sf):
    """The projection of every key as of one instant."""
    changes, _ = _changes(spark, _events(spark, sf))
    now = registry.snapshots(changes, ["user_id"], _NOW, ACTIVITY)
    return now.select("user_id", "revision", "spent", "last_type", "last_type_state", "freshness")


@query("subscribers", f"""WITH {EV} SELECT name, user_id, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM e, (VALUES ('all', 'any'), ('buyers', 'purchase'), ('faults', 'error')) v(name, kind) WHERE kind = 'any' OR event_type = kind GROUP BY 1, 2""")
def subscribers(spark, sf):
    """A stream to three subscribers whose sinks append; one fails at first, and the whole batch is run again twice."""
    base = _folder(spark)
    away = [True]

    def appends(name):
        def write(rows, batch_id):
            if name == "faults" and away[0]:
                away[0] = False
                raise OSError("the subscriber is away")
            rows.write.mode("append").parquet(f"{base}/{name}")

        return write

    wants = {"all": None, "buyers": "event_type = 'purchase'", "faults": "event_type = 'error'"}
    out = FanOut(spark, f"{base}/fan", [Subscriber(n, appends(n), w) for n, w in wants.items()])
    source = _events(spark, sf).select("event_id", "user_id", "event_type")
    for _ in range(3):  # the first run fails after two sinks, the second one ends, the third finds nothing to do
        with suppress(StreamingQueryException):
            out.start(source, f"{base}/checkpoint").awaitTermination()
    found = None
    for name in wants:
        rows = spark.read.schema("event_id bigint, user_id bigint").parquet(f"{base}/{name}").groupBy("user_id")
        counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids")).withColumn("name", F.lit(name))
        found = counted if found is None else found.unionByName(counted)
    return found


def _offered(spark, sf):
    """Events as the event table takes them: identified by their id and type, ingested when they happened."""
    e = events(spark, sf)
    rows = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("env").alias("environment_key"), F.col("ms").alias("ingested_ms"), "event_type", "user_id",
        F.when(F.col("event_type") == "signup", "personal").when(F.col("event_type") == "purchase", "secret").otherwise("local").alias("sensitivity"),
    )
    return store.identity_hash(rows, ["event_id", "event_type"])


@query("append_stored", f"""WITH {EV}, b(batch, lo, hi) AS (VALUES (0, 0, {_HALF}), (1, {_SEAM}, {_HALF + 5 * _DAY}), (2, {_HALF + 4 * _DAY}, 9000000000000)),
n AS (SELECT b.batch, count(*) AS attempted, count(*) FILTER (WHERE ms >= coalesce((SELECT max(hi) FROM b o WHERE o.batch < b.batch), 0)) AS inserted FROM b JOIN e ON ms >= lo AND ms < hi GROUP BY 1)
SELECT CAST(batch AS INTEGER) AS batch, attempted, inserted, attempted - inserted AS duplicates, (SELECT count(*) FROM e) AS stored FROM n""")
def append_stored(spark, sf):
    """Three batches, each with a part of the one before, appended to a stored table; each is run twice."""
    t, e = EventTable(spark, f"{_folder(spark)}/table", 16), _offered(spark, sf)
    ms, reports = F.col("ingested_ms"), []
    for i, (lo, hi) in enumerate(((0, _HALF), (_SEAM, _HALF + 5 * _DAY), (_HALF + 4 * _DAY, 9_000_000_000_000))):
        part = e.where((ms >= lo) & (ms < hi))
        t.append(part, i)
        reports.append((i, *t.append(part.limit(0), i).values()))
    out = spark.createDataFrame(reports, "batch int, attempted bigint, inserted bigint, duplicates bigint")
    return out.withColumn("stored", F.lit(t.read().count()))


@query("stored_conflicts", f"""WITH {EV} SELECT CAST(event_id AS VARCHAR) AS event_id FROM e WHERE ms >= {_SEAM} AND ms < {_HALF} AND k % 3 = 0 AND event_type <> 'click'""")
def stored_conflicts(spark, sf):
    """Events of a second batch whose id is stored with other content; the rest of the batch is new or equal."""
    t, e = EventTable(spark, f"{_folder(spark)}/table", 16), _offered(spark, sf)
    t.append(e.where(F.col("ingested_ms") < _HALF), 0)
    third = events(spark, sf).where("k % 3 = 0").select(F.col("event_id").cast("string").alias("event_id"), F.lit(True).alias("third"))
    later = e.where(F.col("ingested_ms") >= _SEAM).join(third, "event_id", "left")
    changed = later.withColumn("event_type", F.when(F.col("third"), "click").otherwise(F.col("event_type"))).drop("third", "identity_hash")
    return t.conflicts(store.identity_hash(changed, ["event_id", "event_type"]))


_CUT = _HALF + _DAY // 3
_GONE = f"(env = 'env1' AND ms < {_CUT}) OR (env = 'env2' AND event_type IN ('signup', 'purchase')) OR env = 'env0' AND ms < {_CUT - 3 * _DAY}"


@query("retention_table", f"""WITH {EV}
SELECT env AS environment_key, count(*) AS rows, min(ms) AS oldest, CAST(sum(event_id) AS BIGINT) AS ids, (SELECT count(*) FROM e WHERE {_GONE}) AS deleted, (SELECT count(*) FROM e WHERE ({_GONE}) AND event_id % 2 = 0) AS free
FROM e WHERE NOT ({_GONE}) GROUP BY 1""")
def retention_table(spark, sf):
    """The stored table after retention of two environments and deletion of the sensitive events of a third; deleted ids are free again."""
    t, e = EventTable(spark, f"{_folder(spark)}/table", 16), _offered(spark, sf)
    t.append(e.where(F.col("ingested_ms") < _HALF), 0)
    t.append(e.where(F.col("ingested_ms") >= _HALF), 1)
    told = []
    for cutoff, env in ((_CUT, "env1"), (_CUT - 3 * _DAY, "env0")):
        t.retain(cutoff, env, after=lambda outcome: told.append(outcome["deleted"]))
    told.append(t.delete("env2", sensitive_only=True))
    left = settle(t.read().select("environment_key", "ingested_ms", F.col("event_id").cast("bigint").alias("event_id")))
    free = t.append(e.where("event_id % 2 = 0"), 2)["inserted"]
    kept = left.groupBy("environment_key").agg(F.count(F.lit(1)).alias("rows"), F.min("ingested_ms").alias("oldest"), F.sum("event_id").alias("ids"))
    return kept.withColumns({"deleted": F.lit(sum(told)).cast("bigint"), "free": F.lit(free).cast("bigint")})


_HOURS_6, _HOURS_12 = 21_600_000, 43_200_000


@query("stream_dedupe_timed", f"{_FOLD} SELECT event_id, ms, user_id, event_type, true AS bounded FROM f WHERE keep")
def stream_dedupe_timed(spark, sf):
    """De-duplication by event time, and whether the state that is left is only that of keys seen lately."""
    base = _folder(spark)
    e = _events(spark, sf).select("event_id", "ms", "user_id", "event_type")
    out = registry.drain(timed.dedupe_timed(e, ["user_id", "event_type"], "ms", "event_id", _HOURS_6, _DAY), f"{base}/out", f"{base}/checkpoint")
    state = spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", "kept").load()
    newest = events(spark, sf).agg(F.max("ms").alias("ms")).first()["ms"]
    old = state.where(F.col("value.ms") + _HOURS_6 + _DAY < newest - 1).count()
    return out.withColumn("bounded", F.lit(old == 0))


@query("stream_interval_match", f"""WITH {EV}, m AS (SELECT *, lag(event_type) OVER w AS pt, lag(ms) OVER w AS pm, lag(event_id) OVER w AS pe FROM e WHERE event_type IN ('click', 'purchase')
WINDOW w AS (PARTITION BY user_id, k % 3 ORDER BY ms, CAST(event_id AS VARCHAR)))
SELECT user_id, CAST(event_id AS VARCHAR) AS close_ref, CAST(pe AS VARCHAR) AS open_ref, ms - pm AS elapsed_ms FROM m WHERE event_type = 'purchase' AND pt = 'click' AND ms - pm <= {_HOURS_12}
AND ms <= (SELECT max(ms) FROM e WHERE event_type IN ('click', 'purchase')) - {_DAY}""")
def stream_interval_match(spark, sf):
    """Purchases with the latest click that no other purchase has consumed, as far as the watermark has come."""
    t = F.col("event_type")
    e = _events(spark, sf).withColumn("vehicle", F.col("k") % 3)
    found = timed.release_match(e, ["user_id", "vehicle"], "ms", "event_id", t == "click", t == "purchase", _HOURS_12, _DAY)
    base = _folder(spark)
    return registry.drain(found, f"{base}/out", f"{base}/checkpoint").select("user_id", "close_ref", "open_ref", "elapsed_ms")


_HEALTH = "CASE WHEN records >= 25 AND unknown >= 15 AND unknown / records >= 0.75 THEN 'suspected_drift' ELSE 'compatible' END"


@query("health_events", f"""WITH {EV}, g AS (SELECT 'u' || user_id AS environment_key, count(*) AS records, count(*) FILTER (WHERE k % 5 > 0) AS unknown, max(ms) AS last_ms, bool_or(event_type = 'error' AND k = 50) AS drifted, max(user_id % 4) = 1 AS odd FROM e GROUP BY 1),
h AS (SELECT *, CASE WHEN odd THEN 'unverified_build' WHEN drifted THEN 'suspected_drift' ELSE {_HEALTH} END AS status, CASE WHEN odd THEN 'build_not_tested' WHEN drifted THEN 'event_family_field_shape_changed' WHEN {_HEALTH} = 'suspected_drift' THEN 'high_unknown_ratio' ELSE 'profile_compatible' END AS reason FROM g)
SELECT environment_key, v.event_type, CASE WHEN v.event_type LIKE '%Status%' THEN status END AS status, reason, CAST(records AS VARCHAR) AS seen, CAST(records - unknown AS VARCHAR) AS emitted, CAST(unknown AS VARCHAR) AS unknown, CASE WHEN v.event_type LIKE '%Drift%' THEN round(unknown / records, 6) END AS ratio,
CASE WHEN status = 'compatible' THEN 'high' ELSE 'medium' END AS confidence, last_ms AS ts_ms, true AS valid FROM h, (VALUES ('ParserCompatibilityStatusObserved'), ('ParserDriftSuspected')) v(event_type) WHERE v.event_type LIKE '%Status%' OR status = 'suspected_drift'""")
def health_events(spark, sf):
    """Verdicts of environments as events: an untested build, families whose fields changed, too many unknown records."""
    e = events(spark, sf).withColumn("environment_key", text("u", F.col("user_id")))
    counted = e.groupBy("environment_key").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("k") % 5 > 0).alias("unknown"), F.max("ms").alias("checked_ms"),
        F.max((F.col("event_type") == "error") & (F.col("k") == 50)).alias("drifted"), (F.max(F.col("user_id") % 4) == 1).alias("odd"),
    )
    zero = F.lit(0).cast("bigint")
    given = counted.withColumns({"emitted": F.col("records") - F.col("unknown"), "profile_id": F.lit("p"), "profile_version": F.lit("1"), "samples": zero, "dropped": zero})
    judged = health.with_verdict(given, F.when(F.col("odd"), "unverified_build").otherwise("compatible"), None, F.col("drifted"))
    valid, rejected = health.health_events(judged)
    p = F.col("payload")
    return valid.join(rejected.select("environment_key", F.lit(False).alias("valid")), "environment_key", "left").select(
        "environment_key", "event_type", p["status"].alias("status"), p["reason"].alias("reason"), p["recordsSeen"].alias("seen"), p["knownEventsEmitted"].alias("emitted"),
        p["unknownRecords"].alias("unknown"), p["unknownRatio"].cast("double").alias("ratio"), "confidence", "ts_ms", F.coalesce("valid", F.lit(True)).alias("valid"),
    )


@query("health_windows", f"""WITH {EV}, g AS (SELECT env AS environment_key, (ms // {_DAY} + 1) * {_DAY} AS ts_ms, count(*) AS records, count(*) FILTER (WHERE k % 5 > 0) AS unknown FROM e GROUP BY 1, 2),
h AS (SELECT *, {_HEALTH} AS status FROM g WHERE ts_ms <= (SELECT max(ms) - {_DAY // 2} FROM e))
SELECT environment_key, ts_ms, v.event_type, records, unknown, CASE WHEN status = 'suspected_drift' THEN 'high_unknown_ratio' ELSE 'profile_compatible' END AS reason FROM h, (VALUES ('ParserCompatibilityStatusObserved'), ('ParserDriftSuspected')) v(event_type)
WHERE v.event_type LIKE '%Status%' OR status = 'suspected_drift'""")
def health_windows(spark, sf):
    """Health per day and environment from a stream: a window that closes puts its events into the event table, once."""
    base = _folder(spark)
    records = _events(spark, sf).select(F.timestamp_millis("ms").alias("at"), text("env", F.col("user_id") % 3).alias("environment_key"), (F.col("k") % 5 > 0).alias("unmatched"))
    windows = processors.health_windows(records, "at", "1 day", ["environment_key"], "12 hours")
    table = EventTable(spark, f"{base}/table", 16)

    def keep(closed, batch_id):
        valid, _ = health.health_events(health.window_health(closed))
        found = valid.withColumns({"identity_hash": F.sha2("event_id", 256), "ingested_ms": F.col("ts_ms")})
        table.append(found.select("event_id", "environment_key", "ingested_ms", "event_type", "ts_ms", "payload", "identity_hash"), batch_id)

    writer = windows.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    p = F.col("payload")
    numbers = {"records": p["recordsSeen"].cast("bigint"), "unknown": p["unknownRecords"].cast("bigint"), "reason": p["reason"]}
    return table.read().select("environment_key", "ts_ms", "event_type", *[v.alias(k) for k, v in numbers.items()])


@query("golden_diff", f"""WITH {EV}, a AS (SELECT user_id, event_type FROM e WHERE k <> 7), x AS (SELECT user_id, CASE WHEN k = 9 THEN 'other' ELSE event_type END AS event_type FROM e),
n AS (SELECT user_id, event_type, sum(w) AS n FROM (SELECT *, 1 AS w FROM a UNION ALL SELECT *, -1 FROM x) GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN n < 0 THEN 'missing' ELSE 'unexpected' END AS side, CAST(abs(n) AS BIGINT) AS copies FROM n WHERE n <> 0""")
def golden(spark, sf):
    """Events of users and types that come more or less often than expected."""
    e = events(spark, sf)
    expected = e.select("user_id", F.when(F.col("k") == 9, "other").otherwise(F.col("event_type")).alias("event_type"))
    return golden_diff(e.where("k <> 7").select("user_id", "event_type"), expected)
