"""Aggregates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.instants import compact_duration, freshness_label
from tracewright.operators import aggregate, projections
from tracewright.workload.base import EV, events, query, text

KINDS = {
    "signup": ["LoginStarted", "PuJoinRequested", "PuReplicationConnectionEstablished", "PuEntered"],
    "error": ["PuDisconnected", "ReturnedToFrontend", "ApplicationExited"],
    "purchase": ["PartyCreated", "PartyMemberConnected", "PartyMemberJoined", "PartyLeft", "PartyLaunchInitiated"],
    "click": ["JurisdictionEntered", "MonitoredSpaceEntered", "MonitoredSpaceExited", "ArmisticeStateChanged"],
    "view": ["VehicleRetrieved", "VehicleControlAcquired", "VehicleControlReleased", "VehicleStored", "QuantumTargetSelected",
             "QuantumTargetChanged", "QuantumTravelArrived"],
}


def _kind():
    out = F.lit(None).cast("string")
    for t, names in KINDS.items():
        pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") % len(names) + 1).cast("int"))
        out = F.when(F.col("event_type") == t, pick).otherwise(out)
    return out


def typed(spark, sf):
    """Contract events of one environment per user."""
    e = events(spark, sf)
    h = F.expr("k div 7")

    def m(**fields):
        return [x for n, v in fields.items() for x in (F.lit(n), v.cast("string"))]

    payload = F.create_map(
        *m(
            endpoint=text("h", h % 3), shard=text("eu-", h), reason=text("r", h % 4), clean=(h % 2 == 0),
            partyId=text("p", h % 5), leaderHandle=F.when(F.col("kind") == "PartyCreated", text("L", h % 3)),
            memberHandle=F.when(F.col("kind").isin("PartyMemberConnected", "PartyMemberJoined"), text("m", h % 4)),
            jurisdiction=text("j", h % 4), state=F.when(h % 2 == 0, "entered").otherwise("left"),
            vehicleEntityId=text("v", h % 2), targetObservedId=text("t", h % 6), uptimeSeconds=h,
            loginSessionId=text("s", h % 2), accountId=text("a", h % 3), handle=F.lit("same"),
        )
    )
    return e.withColumn("kind", _kind()).select(
        text("u", F.col("user_id")).alias("environment_key"), F.col("kind").alias("event_type"), payload.alias("payload"),
        F.col("ms").alias("ts_ms"), F.col("event_id").alias("order_key"), "event_id",
    )


_K = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN CASE k % {len(ns)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(ns)) + " END" for t, ns in KINDS.items()
) + " END"
TY = f"{EV}, t AS (SELECT 'u' || user_id AS environment_key, {_K} AS kind, k // 7 AS h, ms, event_id AS o FROM e)"
_END = "('PuDisconnected', 'ReturnedToFrontend', 'ApplicationExited')"

# --- aggregates -------------------------------------------------------------------------------------------------------


@query("store_health", f"""WITH {EV} SELECT CAST(count(*) AS BIGINT) AS events, min(ms) AS oldest_ms, max(ms) AS newest_ms, CAST(count(DISTINCT env) AS BIGINT) AS environments FROM e""")
def store_health(spark, sf):
    return aggregate.store_health(events(spark, sf), "ms", "env")


_LEVEL = "CASE event_type WHEN 'signup' THEN 'personal' WHEN 'error' THEN 'secret' WHEN 'purchase' THEN 'social' ELSE 'local' END"


def _level():
    t = F.col("event_type")
    return F.when(t == "signup", "personal").when(t == "error", "secret").when(t == "purchase", "social").otherwise("local")


@query("storage_summary", f"""WITH {EV} SELECT {_LEVEL} AS sensitivity, CAST(count(*) AS BIGINT) AS events FROM e GROUP BY 1""")
def storage_summary(spark, sf):
    return aggregate.storage_summary(events(spark, sf).withColumn("sensitivity", _level()))


def _unmatched(spark, sf):
    e = events(spark, sf)
    k, t = F.col("k"), F.col("event_type")
    body = (
        F.when(t == "signup", text("<Tag", k % 5, "> key[v", k, "] handle[h", k, "]"))
        .when(t == "click", text("<Debug noise", k % 3, "> x"))
        .when(t == "view", text("plain text ", k))
        .when(t == "purchase", text("<Auth> token[t", k, "] 10.0.0.", k % 9))
        .otherwise(text("<Other> session=s", k % 4))
    )
    stamp = text("<2026-01-01T00:00:00.", F.lpad(k.cast("string"), 3, "0"), "Z> ")
    reason = F.when(t == "error", "match_conflict").otherwise("no_profile_match")
    return e.select("env", text("b", F.col("user_id") % 2).alias("build"), "ms", "event_id", F.concat(stamp, body).alias("text"), reason.alias("reason"))


_UNK = f"""{EV}, u AS (SELECT env, 'b' || (user_id % 2) AS build, ms, event_id,
CASE WHEN event_type IN ('click', 'view') THEN 'noise.low_value' WHEN event_type = 'error' THEN 'parser.conflicting_match' ELSE 'parser.unmatched_record' END AS category,
CASE event_type WHEN 'signup' THEN '<Tag' || (k % 5) || '> key[v' || k || '] handle=[REDACTED_HANDLE]]' WHEN 'click' THEN 'n' || (k % 3) WHEN 'view' THEN 'plain'
 WHEN 'purchase' THEN '<Auth> token=[REDACTED_SECRET]] [REDACTED_ENDPOINT]' ELSE '<Other> session=[REDACTED_SESSION]' END AS ident,
CASE event_type WHEN 'signup' THEN 'social' WHEN 'click' THEN 'local' WHEN 'view' THEN 'local' ELSE 'secret' END AS sensitivity FROM e)"""


@query("unknown_buckets", f"""WITH {_UNK}, b AS (SELECT env, build, category, ident, count(*) AS records, min(ms) AS first_ms, max(ms) AS last_ms, max(sensitivity) AS sensitivity FROM u GROUP BY 1, 2, 3, 4)
SELECT env, build, category, CAST(records AS BIGINT) AS records, first_ms, last_ms, sensitivity FROM b""")
def unknown_buckets(spark, sf):
    c = aggregate.classify_unknown(_unmatched(spark, sf), "text", "reason")
    out = aggregate.unknown_buckets(c, ["env", "build"], "ms")
    return out.select("env", "build", "category", "records", "first_ms", "last_ms", "sensitivity")


@query("unknown_samples", f"""WITH {_UNK}, n AS (SELECT *, row_number() OVER (PARTITION BY env, build, category, ident ORDER BY event_id) AS nth FROM u)
SELECT event_id, CAST(nth AS BIGINT) AS nth FROM n WHERE (category <> 'noise.low_value' AND nth <= 4) OR (category = 'noise.low_value' AND (nth = 1 OR (nth % 25 = 0 AND nth // 25 + 1 <= 4)))""")
def unknown_samples(spark, sf):
    c = aggregate.classify_unknown(_unmatched(spark, sf), "text", "reason")
    out = aggregate.unknown_samples(c, ["env", "build"], ["event_id"], {"max_samples": 10**9, "max_total_sample_bytes": 10**12})
    return out.select("event_id", "nth")


@query("unknown_summary", f"""WITH {_UNK}, b AS (SELECT env, build, category, ident, count(*) AS records, min(ms) AS first_ms, max(ms) AS last_ms FROM u GROUP BY 1, 2, 3, 4)
SELECT env, build, CAST(count(*) AS BIGINT) AS buckets, CAST(sum(records) AS BIGINT) AS records, min(first_ms) AS oldest_ms, max(last_ms) AS newest_ms FROM b GROUP BY ROLLUP (env, build)""")
def unknown_summary(spark, sf):
    c = aggregate.classify_unknown(_unmatched(spark, sf), "text", "reason")
    return aggregate.unknown_summary(aggregate.unknown_buckets(c, ["env", "build"], "ms"), "env", "build").drop("bytes")


@query("unknown_expiry", f"""WITH {_UNK}, b AS (SELECT env, build, category, ident, count(*) AS records, max(ms) AS last_ms FROM u GROUP BY 1, 2, 3, 4)
SELECT env, build, category, CAST(count(*) AS BIGINT) AS buckets, CAST(sum(records) AS BIGINT) AS records FROM b WHERE last_ms >= 1706659200000 - 86400000 GROUP BY 1, 2, 3""")
def unknown_expiry(spark, sf):
    c = aggregate.classify_unknown(_unmatched(spark, sf), "text", "reason")
    kept = aggregate.expire_buckets(aggregate.unknown_buckets(c, ["env", "build"], "ms"), 1706659200000, 86400000)
    return kept.groupBy("env", "build", "category").agg(F.count(F.lit(1)).alias("buckets"), F.sum("records").alias("records"))


@query("facet_counts", f"""WITH {EV}, f AS (SELECT 'kind' AS facet, event_type AS value FROM e UNION ALL SELECT 'shard', 's' || (k % 5) FROM e UNION ALL SELECT 'shard', 'r' || (k % 3) FROM e WHERE k % 2 = 0 UNION ALL SELECT 'server', 'h' || (user_id % 4) FROM e)
SELECT facet, value, CAST(count(*) AS BIGINT) AS rows FROM f GROUP BY 1, 2""")
def facet_counts(spark, sf):
    k = F.col("k")
    rows = events(spark, sf).select(
        F.col("event_type").alias("kind"), text("s", k % 5).alias("shard_id"), F.when(k % 2 == 0, text("r", k % 3)).alias("region"),
        text("h", F.col("user_id") % 4).alias("host"),
    )
    return aggregate.facet_counts(rows, {"kind": ["kind"], "shard": ["shard_id", "region"], "server": ["host"]})


@query("append_report", f"""WITH {EV} SELECT CAST(count(*) AS BIGINT) AS attempted, CAST(count(DISTINCT (user_id, k)) AS BIGINT) AS inserted, CAST(count(*) - count(DISTINCT (user_id, k)) AS BIGINT) AS duplicates FROM e""")
def append_report(spark, sf):
    from tracewright.sources import store

    batch = events(spark, sf).select(text(F.col("user_id"), "/", F.col("k")).alias("event_id"), F.lit("x").alias("identity_hash"), "value")
    return aggregate.append_report(batch, store.new_events(batch, None))


@query("append_conflicts", f"""WITH {EV} SELECT user_id || '/' || k AS event_id FROM e GROUP BY 1 HAVING count(DISTINCT event_type) > 1""")
def append_conflicts(spark, sf):
    from tracewright.sources import store

    batch = store.identity_hash(
        events(spark, sf).select(text(F.col("user_id"), "/", F.col("k")).alias("event_id"), "event_type"), ["event_type"]
    )
    return store.conflicts(batch, None)


# --- projections ------------------------------------------------------------------------------------------------------


@query("late_filter", f"""WITH {EV}, l AS (SELECT *, ms < max(ms) OVER (PARTITION BY env ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM e)
SELECT env, CAST(count(*) FILTER (WHERE coalesce(late, false)) AS BIGINT) AS late, CAST(count(*) FILTER (WHERE NOT coalesce(late, false)) AS BIGINT) AS accepted, CAST(sum(event_id) FILTER (WHERE NOT coalesce(late, false)) AS BIGINT) AS accepted_ids FROM l GROUP BY 1""")
def late_filter(spark, sf):
    marked = projections.late_filter(events(spark, sf), ["env"], ["k", "event_id"], "ms")
    ok = ~F.col("late")
    return marked.groupBy("env").agg(F.count_if("late").alias("late"), F.count_if(ok).alias("accepted"),
                                     F.sum(F.when(ok, F.col("event_id"))).alias("accepted_ids"))


_NOW = 1706659200000


@query("freshness", f"""WITH {EV}, s AS (SELECT user_id, arg_max(k, event_id) FILTER (WHERE event_type = 'signup') AS shard, max(ms) FILTER (WHERE event_type = 'signup') AS shard_ms,
arg_max(k, event_id) FILTER (WHERE event_type = 'purchase' AND k = 3) AS party, max(ms) FILTER (WHERE event_type = 'purchase' AND k = 3) AS party_ms FROM e GROUP BY 1),
f AS (SELECT *, CASE WHEN shard IS NULL THEN 'unknown' WHEN {_NOW} - shard_ms >= 172800000 THEN 'stale' ELSE 'known' END AS shard_state, CASE WHEN party IS NULL THEN 'unknown' WHEN {_NOW} - party_ms >= 864000000 THEN 'stale' ELSE 'known' END AS party_state FROM s)
SELECT user_id, shard, party, shard_state, party_state, CASE WHEN 'stale' IN (shard_state, party_state) THEN 'stale' WHEN 'unknown' IN (shard_state, party_state) THEN 'unknown' ELSE 'current' END AS freshness FROM f""")
def freshness(spark, sf):
    t, k = F.col("event_type"), F.col("k")
    s, p = t == "signup", (t == "purchase") & (k == 3)
    state = projections.latest_facts(
        events(spark, sf), {"shard": (k, s), "shard_ms": (F.col("ms"), s), "party": (k, p), "party_ms": (F.col("ms"), p)}, "event_id", ["user_id"]
    )
    out = projections.with_freshness(state, {"shard": 172800000, "party": 864000000}, _NOW)
    return out.select("user_id", "shard", "party", "shard_state", "party_state", "freshness")


_LIFE = f"""{TY}, l AS (SELECT *, CASE kind WHEN 'LoginStarted' THEN 'authenticating' WHEN 'PuJoinRequested' THEN 'loading' WHEN 'PuReplicationConnectionEstablished' THEN 'loading' WHEN 'PuEntered' THEN 'in_game'
 WHEN 'PuDisconnected' THEN 'disconnected' WHEN 'ReturnedToFrontend' THEN 'frontend' WHEN 'ApplicationExited' THEN 'exited' END AS state FROM t),
f AS (SELECT environment_key, arg_max(state, o) AS state, arg_max(kind, o) AS kind, arg_max(h, o) AS h, arg_max(ms, o) AS changed_ms, max(o) FILTER (WHERE state <> 'loading') AS other, count(*) AS n FROM l WHERE state IS NOT NULL GROUP BY 1)"""


@query("lifecycle_state", f"""WITH {_LIFE} SELECT f.environment_key, f.state, changed_ms, CASE WHEN f.kind IN {_END} THEN 'r' || (f.h % 4) ELSE f.kind END AS reason,
CASE WHEN f.state = 'loading' THEN (SELECT arg_min(ms, o) FROM l WHERE l.environment_key = f.environment_key AND l.state = 'loading' AND (f.other IS NULL OR l.o > f.other)) END AS loading_since_ms,
CASE WHEN f.kind = 'ApplicationExited' AND f.h % 2 = 1 THEN 'failure' ELSE 'known' END AS status, CASE WHEN f.kind = 'ApplicationExited' THEN f.h % 2 = 0 END AS clean_exit, CAST(n AS BIGINT) AS transitions FROM f""")
def lifecycle_state(spark, sf):
    return projections.project_lifecycle(typed(spark, sf))


@query("identity_claims", f"""WITH {TY}, c AS (SELECT environment_key, 'loginSessionId' AS field, 's' || (h % 2) AS value, o FROM t WHERE kind = 'LoginStarted' UNION ALL SELECT environment_key, 'accountId', 'a' || (h % 3), o FROM t WHERE kind = 'LoginStarted'
UNION ALL SELECT environment_key, 'handle', 'same', o FROM t WHERE kind = 'LoginStarted')
SELECT environment_key, field, arg_max(value, o) AS value, CAST(count(DISTINCT value) AS BIGINT) AS claims, CASE WHEN count(DISTINCT value) > 1 THEN 'conflicting' ELSE 'known' END AS status FROM c GROUP BY 1, 2""")
def identity_claims(spark, sf):
    return projections.project_identity(projections.identity_claims(typed(spark, sf)))


@query("connection_state", f"""WITH {TY}, a AS (SELECT *, max(CASE WHEN kind IN ('PuJoinRequested', 'PuReplicationConnectionEstablished') THEN o END) OVER w AS cur,
 last_value(CASE WHEN kind IN ('PuJoinRequested', 'PuReplicationConnectionEstablished') THEN h % 3 END IGNORE NULLS) OVER w AS host FROM t WINDOW w AS (PARTITION BY environment_key ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, kind = 'PuDisconnected' AND (cur IS NULL OR host = h % 3) AS eq FROM a), c AS (SELECT *, max(CASE WHEN eq THEN o END) OVER (PARTITION BY environment_key ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl FROM b),
d AS (SELECT *, kind = 'PuDisconnected' AND (eq OR coalesce(cl > cur, false)) AS off FROM c)
SELECT environment_key, arg_max('eu-' || h, o) FILTER (WHERE kind = 'PuJoinRequested') AS shard,
coalesce(arg_max(CASE WHEN kind = 'PuJoinRequested' THEN 'transitioning' WHEN kind = 'PuReplicationConnectionEstablished' THEN 'connected' ELSE 'disconnected' END, o) FILTER (WHERE kind IN ('PuJoinRequested', 'PuReplicationConnectionEstablished') OR off), 'unknown') AS connection_state,
coalesce(arg_max(CASE WHEN kind = 'PuJoinRequested' THEN 'connecting' WHEN kind = 'PuEntered' THEN 'in_game' ELSE 'disconnected' END, o) FILTER (WHERE kind IN ('PuJoinRequested', 'PuEntered') OR off), 'unknown') AS session_state,
arg_min(ms, o) FILTER (WHERE kind = 'PuJoinRequested') AS requested_ms FROM d GROUP BY 1""")
def connection_state(spark, sf):
    out = projections.project_connection(typed(spark, sf), "order_key", arrival=["order_key"])
    return out.select("environment_key", "shard", "connection_state", "session_state", "requested_ms")


@query("session_elapsed", f"""WITH {TY}, s AS (SELECT environment_key, arg_max(ms, o) FILTER (WHERE kind = 'PuEntered') AS entered_ms, arg_max(ms, o) FILTER (WHERE kind = 'PuJoinRequested') AS requested_ms,
arg_max(ms, o) FILTER (WHERE kind = 'PuDisconnected') AS ended_ms, arg_max(h, o) FILTER (WHERE kind = 'PuDisconnected' AND h % 2 = 0) AS d FROM t GROUP BY 1)
SELECT environment_key, coalesce(CAST(d AS DOUBLE), CASE WHEN coalesce(ended_ms, {_NOW}) >= coalesce(entered_ms, requested_ms) THEN CAST((coalesce(ended_ms, {_NOW}) - coalesce(entered_ms, requested_ms)) // 1000 AS DOUBLE) END) AS elapsed_seconds FROM s""")
def session_elapsed(spark, sf):
    t = F.col("event_type")
    h = F.try_element_at(F.col("payload"), F.lit("uptimeSeconds")).cast("double")
    ms = F.col("ts_ms")
    facts = {"entered_ms": (ms, t == "PuEntered"), "requested_ms": (ms, t == "PuJoinRequested"), "ended_ms": (ms, t == "PuDisconnected"),
             "duration_seconds": (h, (t == "PuDisconnected") & (h % 2 == 0))}
    return projections.session_elapsed(projections.latest_facts(typed(spark, sf), facts, "order_key"), _NOW).select("environment_key", "elapsed_seconds")


_PARTY = f"""{TY}, b AS (SELECT environment_key, max(o) FILTER (WHERE kind = 'PartyLeft') AS lft, max(o) FILTER (WHERE kind IN {_END}) AS bnd, max(o) FILTER (WHERE kind = 'PartyCreated') AS cre,
 min(o) FILTER (WHERE kind = 'PartyMemberJoined') AS fj, arg_max('L' || (h % 3), o) FILTER (WHERE kind = 'PartyCreated') AS ldr, arg_max('p' || (h % 5), o) FILTER (WHERE kind = 'PartyCreated') AS pid, max(o) FILTER (WHERE kind LIKE 'Party%') AS mv FROM t GROUP BY 1),
m AS (SELECT environment_key, CASE WHEN kind = 'PartyCreated' THEN 'L' || (h % 3) ELSE 'm' || (h % 4) END AS handle, arg_max(kind, o) AS kind, max(o) AS po FROM t WHERE kind IN ('PartyCreated', 'PartyMemberConnected', 'PartyMemberJoined') GROUP BY 1, 2),
r AS (SELECT m.environment_key, handle, CASE WHEN coalesce(bnd > po, false) THEN 'stale' WHEN kind = 'PartyMemberConnected' THEN 'possible' ELSE 'confirmed' END AS membership,
 CASE WHEN kind = 'PartyCreated' THEN 'unknown' WHEN coalesce(bnd > po, false) THEN 'stale' ELSE 'connected' END AS connection FROM m JOIN b USING (environment_key) WHERE lft IS NULL OR po > lft)"""


@query("party_roster", f"WITH {_PARTY} SELECT * FROM r")
def party_roster(spark, sf):
    return projections.party_members(typed(spark, sf)).drop("created")


@query("party_state", f"""WITH {_PARTY}, s AS (SELECT *, cre IS NOT NULL AND (lft IS NULL OR cre > lft) AS led FROM b), x AS (SELECT *, CASE WHEN led THEN 'in_party' WHEN lft IS NOT NULL THEN 'not_in_party' WHEN fj IS NOT NULL THEN 'in_party' ELSE 'unknown' END AS st FROM s),
y AS (SELECT *, st = 'in_party' AND coalesce(bnd > CASE WHEN led THEN cre ELSE fj END, false) AS stale FROM x)
SELECT environment_key, CASE WHEN stale THEN 'stale' ELSE st END AS state, CASE WHEN led THEN pid END AS party_id, CASE WHEN led THEN ldr END AS leader,
CAST(coalesce((SELECT count(*) FROM r WHERE r.environment_key = y.environment_key AND membership = 'confirmed'), 0) AS BIGINT) AS confirmed,
CAST(coalesce((SELECT count(*) FROM r WHERE r.environment_key = y.environment_key AND membership = 'possible'), 0) AS BIGINT) AS possible, CASE WHEN stale THEN 'stale' WHEN mv IS NOT NULL THEN 'current' ELSE 'unknown' END AS freshness FROM y""")
def party_state(spark, sf):
    return projections.project_party(typed(spark, sf))


@query("party_transitions", f"""WITH {TY} SELECT environment_key, o AS event_id, kind AS event_type FROM t WHERE kind LIKE 'Party%' QUALIFY row_number() OVER (PARTITION BY environment_key ORDER BY o DESC) <= 10""")
def party_transitions(spark, sf):
    return projections.party_transitions(typed(spark, sf)).select("environment_key", "event_id", "event_type")


@query("location_facts", f"""WITH {TY}, a AS (SELECT environment_key, max(o) FILTER (WHERE kind IN {_END}) AS bnd, arg_max('j' || (h % 4), o) FILTER (WHERE kind = 'JurisdictionEntered') AS jurisdiction, max(o) FILTER (WHERE kind = 'JurisdictionEntered') AS jo,
arg_max(CASE WHEN kind = 'MonitoredSpaceEntered' THEN 'entered' ELSE 'exited' END, o) FILTER (WHERE kind LIKE 'Monitored%') AS ms0, max(o) FILTER (WHERE kind LIKE 'Monitored%') AS mo,
arg_max(CASE WHEN h % 2 = 0 THEN 'entered' ELSE 'left' END, o) FILTER (WHERE kind = 'ArmisticeStateChanged') AS as0, max(o) FILTER (WHERE kind = 'ArmisticeStateChanged') AS ao FROM t GROUP BY 1),
s AS (SELECT *, CASE WHEN jo IS NULL THEN 'unknown' WHEN coalesce(bnd > jo, false) THEN 'stale' ELSE 'last_confirmed' END AS jurisdiction_state, CASE WHEN mo IS NULL THEN 'unknown' WHEN coalesce(bnd > mo, false) THEN 'stale' ELSE ms0 END AS monitored_state,
CASE WHEN ao IS NULL THEN 'unknown' WHEN coalesce(bnd > ao, false) THEN 'stale' ELSE as0 END AS armistice_state FROM a)
SELECT environment_key, CASE WHEN jurisdiction_state NOT IN ('unknown', 'stale') OR monitored_state NOT IN ('unknown', 'stale') OR armistice_state NOT IN ('unknown', 'stale') THEN 'known' WHEN 'stale' IN (jurisdiction_state, monitored_state, armistice_state) THEN 'stale' ELSE 'unknown' END AS state,
jurisdiction_state, jurisdiction, monitored_state, CASE WHEN ms0 = 'entered' THEN 'true' WHEN ms0 = 'exited' THEN 'false' END AS monitored, armistice_state, CASE WHEN as0 = 'entered' THEN 'true' WHEN as0 = 'left' THEN 'false' END AS armistice FROM s""")
def location_facts(spark, sf):
    return projections.project_location(typed(spark, sf))


@query("destination_state", f"""WITH {TY}, a AS (SELECT environment_key, max(o) FILTER (WHERE kind IN {_END}) AS bnd, max(o) FILTER (WHERE kind LIKE 'Quantum%') AS qo, arg_max(kind, o) FILTER (WHERE kind LIKE 'Quantum%') AS qk, arg_max('t' || (h % 6), o) FILTER (WHERE kind LIKE 'Quantum%') AS tg,
arg_max('t' || (h % 6), o) FILTER (WHERE kind = 'QuantumTravelArrived') AS last_arrival FROM t GROUP BY 1), s AS (SELECT *, CASE WHEN qo IS NULL THEN 'unknown' WHEN coalesce(bnd > qo, false) THEN 'stale' WHEN qk = 'QuantumTravelArrived' THEN 'arrived' ELSE 'target_selected' END AS state FROM a)
SELECT environment_key, state, CASE WHEN state = 'target_selected' THEN tg END AS current_target, last_arrival, CASE WHEN state IN ('unknown', 'stale') THEN state ELSE 'current' END AS freshness FROM s""")
def destination_state(spark, sf):
    return projections.project_destination(typed(spark, sf))


def _slot(slot, acquire, updates):
    return f"""{slot}0 AS (SELECT environment_key, arg_max('v' || (h % 2), o) AS id, max(o) AS po FROM t WHERE kind = '{acquire}' GROUP BY 1),
{slot}1 AS (SELECT g.environment_key, any_value(id) AS id, any_value(po) AS po, max(t.o) AS uo, arg_max(t.kind, t.o) AS uk FROM {slot}0 g LEFT JOIN t ON t.environment_key = g.environment_key AND t.kind IN ({updates}) AND 'v' || (t.h % 2) = g.id AND t.o > g.po GROUP BY 1)"""


@query("vehicle_state", f"""WITH {TY}, {_slot('hg', 'VehicleRetrieved', "'VehicleStored'")}, {_slot('ct', 'VehicleControlAcquired', "'VehicleControlReleased', 'VehicleStored'")},
b AS (SELECT environment_key, max(o) FILTER (WHERE kind IN {_END}) AS bnd FROM t GROUP BY 1)
SELECT b.environment_key, hg1.id AS hangar_vehicle, CASE WHEN coalesce(bnd > coalesce(hg1.uo, hg1.po), false) THEN 'disconnected' WHEN hg1.id IS NULL THEN NULL WHEN hg1.uo IS NULL THEN 'known' ELSE 'stored' END AS hangar_state,
ct1.id AS controlled_vehicle, CASE WHEN coalesce(bnd > coalesce(ct1.uo, ct1.po), false) THEN 'disconnected' WHEN ct1.id IS NULL THEN NULL WHEN ct1.uo IS NULL THEN 'known' WHEN ct1.uk = 'VehicleStored' THEN 'stored' ELSE 'released' END AS controlled_state
FROM b LEFT JOIN hg1 USING (environment_key) LEFT JOIN ct1 USING (environment_key)""")
def vehicle_state(spark, sf):
    return projections.project_vehicle(typed(spark, sf))


@query("generic_projection", f"""WITH {EV} SELECT user_id, CAST(count(*) AS BIGINT) AS revision, CAST(sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS BIGINT) AS spent, arg_max(event_type, event_id) AS last_type FROM e WHERE event_type IN ('purchase', 'view') GROUP BY 1""")
def generic_projection(spark, sf):
    def reduce(state, row):
        paid = int(row["k"]) if row["event_type"] == "purchase" else 0
        return {"spent": state["spent"] + paid, "last_type": row["event_type"]}

    spend = projections.Projection("spend", 1, lambda: {"spent": 0, "last_type": None}, reduce, "spent bigint, last_type string", ("purchase", "view"))
    return projections.project(events(spark, sf), spend, ["event_id"], ["event_type", "k"], key="user_id")


@query("change_feed", f"""WITH {EV}, a AS (SELECT user_id, arg_max(event_type, event_id) AS state FROM e WHERE ms < 1706400000000 GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS state FROM e GROUP BY 1)
SELECT b.user_id, b.state FROM b LEFT JOIN a USING (user_id) WHERE a.state IS DISTINCT FROM b.state""")
def change_feed(spark, sf):
    e = events(spark, sf)

    def state(rows):
        return projections.latest_facts(rows, {"state": (F.col("event_type"), F.lit(True))}, "event_id", ["user_id"])

    return projections.changed_snapshots(state(e.where(F.col("ms") < 1706400000000)), state(e))


@query("alert_lifecycle", f"""WITH {EV}, h AS (SELECT user_id, ms < 1705500000000 AS early, CASE WHEN count(*) FILTER (WHERE event_type = 'error') * 4 > count(*) THEN 'parser-drift' WHEN user_id % 3 = 0 THEN 'unverified-build' END AS alert_id FROM e GROUP BY 1, 2),
d AS (SELECT user_id, ms < 1705500000000 AS early, 'diagnostic-' || event_type AS alert_id FROM e WHERE k = 5 GROUP BY 1, 2, 3), a AS (SELECT * FROM h WHERE alert_id IS NOT NULL UNION ALL SELECT * FROM d)
SELECT 'u' || user_id AS environment_key, alert_id, CASE WHEN bool_or(NOT early) THEN 'active' ELSE 'cleared' END AS state FROM a GROUP BY 1, 2""")
def alert_lifecycle(spark, sf):
    e = events(spark, sf).withColumn("environment_key", text("u", F.col("user_id")))

    def of(rows):
        n = F.count(F.lit(1))
        drift = F.count_if(F.col("event_type") == "error") * 4 > n
        status = F.when(drift, "suspected_drift").when(F.max("user_id") % 3 == 0, "unverified_build").otherwise("compatible")
        health = rows.groupBy("environment_key").agg(status.alias("status"))
        return projections.alerts(health, rows.where(F.col("k") == 5).select("environment_key", F.col("event_type").alias("code")))

    early = F.col("ms") < 1705500000000
    return projections.alert_lifecycle(of(e.where(early)), of(e.where(~early)))


@query("activity_recency", f"""WITH {EV}, s AS (SELECT user_id, max(ms) FILTER (WHERE event_type = 'view' AND k > 60) AS seen FROM e GROUP BY 1), d AS (SELECT *, greatest(0, ({_NOW} - seen) // 1000) AS sec, greatest(0, ({_NOW} - seen) // 60000) AS mi FROM s)
SELECT user_id, CASE WHEN seen IS NULL THEN 'none' WHEN {_NOW} - seen > 60000 THEN 'quiet' ELSE 'recent' END AS activity, CASE WHEN seen IS NULL THEN 'Unknown' WHEN sec < 5 THEN 'Now' WHEN sec < 60 THEN sec || 's' WHEN sec < 3600 THEN (sec // 60) || 'm' ELSE (sec // 3600) || 'h' END AS freshness,
CASE WHEN seen IS NULL THEN 'Unknown' WHEN mi >= 60 THEN (mi // 60) || 'h ' || (mi % 60) || 'm' ELSE (mi % 60) || 'm' END AS duration FROM d""")
def activity_recency(spark, sf):
    seen = F.max(F.when((F.col("event_type") == "view") & (F.col("k") > 60), F.col("ms")))
    s = events(spark, sf).groupBy("user_id").agg(seen.alias("seen"))
    now = F.lit(_NOW)
    return s.select("user_id", projections.activity_state(F.col("seen"), now).alias("activity"), freshness_label(F.col("seen"), now).alias("freshness"),
                    compact_duration(F.col("seen"), now).alias("duration"))


@query("current_summary", f"""WITH {TY} SELECT environment_key, arg_max('eu-' || h, o) FILTER (WHERE kind = 'PuJoinRequested') AS shard, arg_max('j' || (h % 4), o) FILTER (WHERE kind = 'JurisdictionEntered') AS place, arg_max('v' || (h % 2), o) FILTER (WHERE kind = 'VehicleRetrieved') AS vehicle FROM t
WHERE kind IN ('PuJoinRequested', 'JurisdictionEntered', 'VehicleRetrieved') GROUP BY 1""")
def current_summary(spark, sf):
    e = typed(spark, sf)
    t = F.col("event_type")

    def one(name, kind, fieldname):
        rows = e.where(t == kind)
        return projections.latest_facts(rows, {name: (F.try_element_at(F.col("payload"), F.lit(fieldname)), F.lit(True))}, "order_key")

    return aggregate.current_summary(
        [one("shard", "PuJoinRequested", "shard"), one("place", "JurisdictionEntered", "jurisdiction"), one("vehicle", "VehicleRetrieved", "vehicleEntityId")],
        "environment_key",
    )


