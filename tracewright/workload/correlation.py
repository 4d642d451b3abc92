"""Environment timeline, compatibility, as-of joins, sequences, sessions, inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import correlate, environment, inventory, sessions
from tracewright.plans.scans import asof, split_keys
from tracewright.workload.base import EV, as_lines, events, pick, query, stamp, table, text

# --- environment ------------------------------------------------------------------------------------------------------
_ORDER = ["event_id"]


def _evidence(spark, sf):
    """Environment facts by event type: source and tag on signup, build on click, branch on view, name on purchase."""
    e = events(spark, sf)
    k, t = F.col("k"), F.col("event_type")
    none = F.lit(None).cast("string")
    channel = F.element_at(F.array(*[F.lit(c) for c in ("LIVE", "PTU", "EPTU", "odd")]), (k % 4 + 1).cast("int"))
    other = F.when((t == "signup") & (k % 10 == 0), "HOTFIX")
    return e.withColumns(
        {
            "ev_source": F.when((t == "signup") & (k % 3 == 0), text("src", k % 2)),
            "ev_init_tag": F.when(t == "signup", channel),
            "ev_game_tag": other,
            "ev_tag": F.when(t == "signup", channel),
            "ev_name": F.when(t == "purchase", text("n", k % 2)),
            "ev_build": F.when(t == "click", text("4.", k % 3)),
            "ev_branch": F.when(t == "view", text("b", k % 3)),
            "ev_changelist": none,
            "ev_database": none,
        }
    )


def _timeline(spark, sf):
    cut, lane = split_keys(_evidence(spark, sf), ["user_id"], _ORDER)
    return environment.environment_timeline(cut, lane), lane


_NORM = "CASE WHEN {0} IN ('LIVE','PTU','EPTU','HOTFIX','TECH-PREVIEW') THEN {0} END"
_TL = f"""{EV}, c AS (SELECT *, CASE k % 4 WHEN 0 THEN 'LIVE' WHEN 1 THEN 'PTU' WHEN 2 THEN 'EPTU' ELSE 'odd' END AS ch FROM e),
r AS (SELECT *, (event_type = 'signup' AND k % 10 = 0 AND ch <> 'odd') AS conflict FROM c),
v AS (SELECT event_id, user_id, conflict, CASE WHEN NOT conflict AND event_type = 'signup' AND k % 3 = 0 THEN 'src' || (k % 2) END AS src,
 CASE WHEN NOT conflict AND event_type = 'signup' THEN ch END AS tag, CASE WHEN event_type = 'purchase' THEN 'n' || (k % 2) END AS nm,
 CASE WHEN event_type = 'click' THEN '4.' || (k % 3) END AS bld, CASE WHEN event_type = 'view' THEN 'b' || (k % 3) END AS br FROM r),
p AS (SELECT *, coalesce(last_value(src IGNORE NULLS) OVER pw, 'UNKNOWN_SOURCE') AS src0, coalesce(last_value(tag IGNORE NULLS) OVER pw, 'UNKNOWN') AS tag0
 FROM v WINDOW pw AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, (coalesce(src <> src0, false) OR coalesce({_NORM.format('tag')} <> {_NORM.format('tag0')}, false)) AS bound FROM p),
g AS (SELECT *, sum(CASE WHEN bound THEN 1 ELSE 0 END) OVER w AS epoch, coalesce(last_value(src IGNORE NULLS) OVER w, 'UNKNOWN_SOURCE') AS env_source,
 coalesce(last_value(tag IGNORE NULLS) OVER w, 'UNKNOWN') AS env_tag, coalesce(last_value(nm IGNORE NULLS) OVER w, 'UNKNOWN') AS env_name
 FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, coalesce({_NORM.format('env_tag')}, 'UNKNOWN') AS env_channel, coalesce(last_value(bld IGNORE NULLS) OVER x, 'UNKNOWN_BUILD') AS env_build,
 coalesce(last_value(br IGNORE NULLS) OVER x, 'UNKNOWN') AS env_branch FROM g WINDOW x AS (PARTITION BY user_id, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, env_channel || '::PU::' || env_build || '::' || env_branch || '::src_' || substr(sha256(lower(env_source)), 1, 16) AS environment_key FROM f)"""


@query("environment_timeline", f"""WITH {_TL} SELECT event_id, conflict, CAST(epoch AS BIGINT) AS epoch, env_source, env_tag, env_name, env_build, env_branch, environment_key FROM t""")
def environment_timeline(spark, sf):
    t, _ = _timeline(spark, sf)
    return t.select("event_id", "conflict", "epoch", "env_source", "env_tag", "env_name", "env_build", "env_branch", "environment_key")


@query("environment_switches", f"""WITH {_TL}, s AS (SELECT *, lag(environment_key) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_key FROM t)
SELECT event_id, previous_key, environment_key FROM s WHERE previous_key <> environment_key""")
def environment_switches(spark, sf):
    t, lane = _timeline(spark, sf)
    return environment.environment_switches(t, lane).select("event_id", "previous_key", "environment_key")


@query("environment_partitions", f"""WITH {_TL} SELECT environment_key, CAST(count(*) AS BIGINT) AS rows, arg_max(env_name, event_id) AS env_name,
arg_max(env_tag, event_id) AS env_tag FROM t GROUP BY 1""")
def environment_partitions(spark, sf):
    t, _ = _timeline(spark, sf)
    return environment.environment_partitions(t, ["event_id"]).select("environment_key", "rows", "env_name", "env_tag")


@query("channel_gate", f"""WITH {EV} SELECT user_id, min(CASE WHEN k % 50 = 0 THEN 'PTU' ELSE 'LIVE' END) AS channel_low, max(CASE WHEN k % 50 = 0 THEN 'PTU' ELSE 'LIVE' END) AS channel_high,
CASE WHEN count(DISTINCT CASE WHEN k % 50 = 0 THEN 'PTU' ELSE 'LIVE' END) > 1 OR max(CASE WHEN k % 50 = 0 THEN 'PTU' ELSE 'LIVE' END) <> 'LIVE' THEN 'environment_mismatch' ELSE 'ok' END AS status
FROM e WHERE event_type = 'signup' GROUP BY 1""")
def channel_gate(spark, sf):
    e = events(spark, sf).where(F.col("event_type") == "signup")
    lines = as_lines(e, text("<Init> Tag[", F.when(F.col("k") % 50 == 0, "ptu").otherwise("LIVE"), "] Environment[PUB]"))
    seen = lines.select("source_id", F.explode_outer(environment.observed_channels(F.col("text"))).alias("channel"))
    gate = environment.channel_gate(seen, ["source_id"], F.lit("LIVE"))
    return gate.select(F.col("source_id").cast("bigint").alias("user_id"), "channel_low", "channel_high", "status")


def _builds(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.col("l_partkey")
    build = text("4.", key % 4 + 8, ".", key % 5)
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"), key, build.alias("build"),
        F.when(key % 2 == 0, "LIVE").otherwise("PTU").alias("channel"), F.lit("PU").alias("universe"), F.lit("UNKNOWN").alias("branch"),
    )


def _profiles(spark, sf):
    """Profiles derived from parts: one per brand, family and tested builds by key."""
    p = table(spark, sf, "part").where(F.col("p_size") <= 3)
    return p.select(
        text("profile-", F.col("p_partkey")).alias("profile_id"), F.lit("1").alias("version"),
        F.col("p_size").alias("priority"), F.lit(4).alias("major"), (F.col("p_partkey") % 4 + 8).cast("int").alias("minor"),
        F.array(F.when(F.col("p_partkey") % 3 == 0, "LIVE").otherwise("PTU")).alias("channels"),
        F.array(F.lit("PU")).alias("universes"), F.array(F.lit("UNKNOWN")).alias("branches"),
        F.array(text("4.", F.col("p_partkey") % 4 + 8, ".0")).alias("tested_builds"),
        F.array(text("4.", F.col("p_partkey") % 4 + 8, ".1")).alias("exclusions"),
    ).groupBy("minor", "channels").agg(F.max(F.struct("priority", "profile_id", "version", "major", "universes", "branches", "tested_builds", "exclusions")).alias("p")).select(
        "minor", "channels", "p.*"
    )


_PROF = """b AS (SELECT l_orderkey, l_linenumber, l_partkey, '4.' || (l_partkey % 4 + 8) || '.' || (l_partkey % 5) AS build, l_partkey % 4 + 8 AS minor, CASE WHEN l_partkey % 2 = 0 THEN 'LIVE' ELSE 'PTU' END AS channel FROM lineitem),
q AS (SELECT p_partkey % 4 + 8 AS minor, CASE WHEN p_partkey % 3 = 0 THEN 'LIVE' ELSE 'PTU' END AS channel, arg_max('profile-' || p_partkey, (p_size, 'profile-' || p_partkey)) AS profile_id FROM part WHERE p_size <= 3 GROUP BY 1, 2),
s AS (SELECT b.*, q.profile_id FROM b LEFT JOIN q ON b.minor = q.minor AND b.channel = q.channel)"""


@query("profile_selection", f"""WITH {_PROF} SELECT channel, build, profile_id, CAST(count(*) AS BIGINT) AS rows FROM s GROUP BY 1, 2, 3""")
def profile_selection(spark, sf):
    picked = environment.select_profile(_builds(spark, sf), _profiles(spark, sf))
    return picked.groupBy("channel", "build", "profile_id").agg(F.count(F.lit(1)).alias("rows"))


@query("build_compatibility", f"""WITH {_PROF} SELECT CASE WHEN profile_id IS NULL OR build LIKE '%.1' THEN 'unsupported_profile' WHEN build LIKE '%.0' THEN 'compatible' ELSE 'unverified_build' END AS status,
CASE WHEN profile_id IS NULL THEN 'no_compatible_profile' WHEN build LIKE '%.1' THEN 'build_explicitly_excluded' WHEN build LIKE '%.0' THEN 'profile_compatible' ELSE 'build_not_tested' END AS reason,
CAST(count(*) AS BIGINT) AS rows FROM s GROUP BY 1, 2""")
def build_compatibility(spark, sf):
    judged = environment.build_compatibility(environment.select_profile(_builds(spark, sf), _profiles(spark, sf)))
    return judged.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query("build_coverage", """WITH o AS (SELECT CAST(10400000 + l_partkey * 1300 AS VARCHAR) AS build, count(*) AS files FROM lineitem GROUP BY 1),
s AS (SELECT DISTINCT CAST(10400000 + p_partkey * 1300 AS VARCHAR) AS build FROM part WHERE p_size % 2 = 0),
c AS (SELECT o.build, files, s.build IS NOT NULL AS ok, CASE WHEN CAST(o.build AS BIGINT) >= 12500000 THEN '4.10' WHEN CAST(o.build AS BIGINT) >= 12200000 THEN '4.9'
 WHEN CAST(o.build AS BIGINT) >= 11800000 THEN '4.8' WHEN CAST(o.build AS BIGINT) >= 11400000 THEN '4.7' WHEN CAST(o.build AS BIGINT) >= 11100000 THEN '4.6'
 WHEN CAST(o.build AS BIGINT) >= 10800000 THEN '4.5' WHEN CAST(o.build AS BIGINT) >= 10600000 THEN '4.4' ELSE 'pre-4.4' END AS family FROM o LEFT JOIN s USING (build))
SELECT family, CAST(count(*) AS BIGINT) AS builds, CAST(sum(files) AS BIGINT) AS files, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS supported_builds,
CAST(coalesce(sum(files) FILTER (WHERE ok), 0) AS BIGINT) AS supported_files FROM c GROUP BY 1""")
def build_coverage(spark, sf):
    build = F.expr("cast(10400000 + {0} * 1300 as string)".format("l_partkey"))
    observed = table(spark, sf, "lineitem").select(build.alias("build"))
    supported = table(spark, sf, "part").where(F.col("p_size") % 2 == 0).select(
        F.expr("cast(10400000 + p_partkey * 1300 as string)").alias("build")
    )
    return environment.coverage_by_family(environment.build_coverage(observed, supported))


@query("profile_quality", """WITH d AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand AS profile_id, p_name AS rule_id, 'duplicate_extractor_id' AS code FROM d WHERE n > 1
UNION ALL SELECT p_brand, p_name, 'invalid_dispatch_literals' FROM part WHERE p_size % 10 = 0
UNION ALL SELECT p_brand, p_name, 'unknown_event_type' FROM part WHERE p_type = 'ECONOMY'
UNION ALL SELECT p_brand, p_name, 'invalid_required_fields' FROM part WHERE p_type IS NOT NULL AND p_size % 7 = 0
UNION ALL SELECT p_brand, p_name, 'unknown_required_field' FROM part WHERE p_type <> 'ECONOMY' AND p_size % 7 = 1""")
def profile_quality(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    rules = p.select(
        F.col("p_brand").alias("profile_id"), F.col("p_name").alias("rule_id"), F.col("p_type").alias("event_type"),
        F.when(size % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("literals"),
        F.when(size % 7 == 0, F.array().cast("array<string>")).when(size % 7 == 1, F.array(F.lit("nope"))).otherwise(F.array(F.lit("size"))).alias("required"),
    )
    profiles = p.select(F.col("p_brand").alias("profile_id")).distinct().select(
        "profile_id", F.array(F.lit("1")).alias("tested_builds"), F.lit(4).alias("major"), F.lit(9).alias("minor")
    )
    fields = p.where(F.col("p_type") != "ECONOMY").select(F.col("p_type").alias("event_type"), F.lit("size").alias("field")).distinct()
    return environment.validate_profiles(profiles, rules, fields)


@query("shard_region", """WITH l AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'pub-use1b-' WHEN 1 THEN 'pub_euw_' WHEN 2 THEN 'oceeast.' WHEN 3 THEN 'x-apse-' ELSE 'shard-' END || s_suppkey AS label FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'EU' WHEN 2 THEN 'AUS' ELSE 'UNKNOWN' END AS region,
CASE s_suppkey % 5 WHEN 0 THEN 'use1b' WHEN 1 THEN 'euw' WHEN 2 THEN 'oceeast' END AS segment, CASE WHEN s_suppkey % 5 < 3 THEN 'medium' ELSE 'unknown' END AS confidence FROM l WHERE s_suppkey % 5 <> 3
UNION ALL SELECT s_suppkey, 'ASIA', 'apse', 'medium' FROM l WHERE s_suppkey % 5 = 3""")
def shard_region(spark, sf):
    s = table(spark, sf, "supplier")
    m = F.col("s_suppkey") % 5
    label = F.when(m == 0, "pub-use1b-").when(m == 1, "pub_euw_").when(m == 2, "oceeast.").when(m == 3, "x-apse-").otherwise("shard-")
    return s.select("s_suppkey", environment.shard_region(text(label, F.col("s_suppkey"))).alias("r")).select("s_suppkey", "r.*")


# --- as-of and sequences ----------------------------------------------------------------------------------------------
_KEY = ["user_id"]


@query("asof_last", f"""WITH {EV} SELECT event_id, f1 AS last_signup_k, f2 AS last_view_k FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN k END IGNORE NULLS) OVER w AS f1,
last_value(CASE WHEN event_type = 'view' THEN k END IGNORE NULLS) OVER w AS f2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'purchase'""")
def asof_last(spark, sf):
    e = events(spark, sf)
    t, k = F.col("event_type"), F.col("k")
    out = correlate.asof_last(e, _KEY, _ORDER, t == "purchase",
                              {"last_signup_k": F.when(t == "signup", k), "last_view_k": F.when(t == "view", k)})
    return out.select("event_id", "last_signup_k", "last_view_k")


@query("asof_by_key", f"""WITH {EV} SELECT p.event_id, s.event_id AS request_event, s.value AS request_value FROM (SELECT * FROM e WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') s ON p.user_id = s.user_id AND p.k % 20 = s.k % 20 AND p.event_id > s.event_id""")
def asof_by_key(spark, sf):
    e = events(spark, sf).withColumn("port", F.col("k") % 20)
    left = e.where(F.col("event_type") == "purchase").select("user_id", "port", "event_id")
    right = e.where(F.col("event_type") == "click").select(
        "user_id", "port", "event_id", F.col("event_id").alias("request_event"), F.col("value").alias("request_value")
    )
    return asof(left, right, ["user_id", "port"], _ORDER, ["request_event", "request_value"]).select("event_id", "request_event", "request_value")


@query("asof_semi", f"""WITH {EV}, w AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN k % 5 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS known FROM e)
SELECT event_id, k FROM w WHERE event_type = 'error' AND k % 5 = known""")
def asof_semi(spark, sf):
    t, k = F.col("event_type"), F.col("k")
    out = correlate.asof_semi(events(spark, sf), _KEY, _ORDER, t == "error", k % 5, F.when(t == "signup", k % 5))
    return out.select("event_id", "k")


@query("pair_begin_end", f"""WITH {EV}, m AS (SELECT *, lag(event_type) OVER w AS pt, lag(ms) OVER w AS pm, lag(event_id) OVER w AS pe, lag(k) OVER w AS pk FROM e
WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, pe AS begin_ref, greatest(0, ms - pm) AS duration_ms FROM m WHERE event_type = 'purchase' AND pt = 'click' AND pk % 4 > 0""")
def pair_begin_end(spark, sf):
    e = events(spark, sf)
    t = F.col("event_type")
    out = correlate.pair_begin_end(e, _KEY, _ORDER, t == "click", t == "purchase", "ms", F.col("k") % 4 > 0)
    return out.select("event_id", "begin_ref", "duration_ms")


_H = 12 * 3600_000


@query("sequence_match", f"""WITH {EV}, a AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER p AS j, max(CASE WHEN event_type = 'error' AND k % 3 = 0 THEN event_id END) OVER p AS x,
max(CASE WHEN event_type = 'click' THEN event_id END) OVER p AS c1 FROM e WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT a.*, (j IS NOT NULL AND (x IS NULL OR x < j) AND c1 > j) AS live, jm.ms AS jms, cm.ms AS cms FROM a LEFT JOIN e jm ON jm.event_id = a.j LEFT JOIN e cm ON cm.event_id = a.c1),
c AS (SELECT *, max(CASE WHEN event_type = 'view' AND live AND ms - cms BETWEEN 0 AND {_H} THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM b),
d AS (SELECT c.*, vm.ms AS vms FROM c LEFT JOIN e vm ON vm.event_id = c.v)
SELECT min(event_id) AS event_id, j AS start_ref, arg_min(ms - jms, event_id) AS elapsed_ms FROM d WHERE event_type = 'purchase' AND live AND v > c1
AND cms - jms BETWEEN 0 AND {_H} AND vms - cms BETWEEN 0 AND {_H} AND ms - vms BETWEEN 0 AND {_H} GROUP BY user_id, j""")
def sequence_match(spark, sf):
    t = F.col("event_type")
    out = correlate.sequence_match(
        events(spark, sf), _KEY, _ORDER, "ms", t == "signup", [t == "click", t == "view", t == "purchase"],
        (t == "error") & (F.col("k") % 3 == 0), _H,
    )
    return out.select("event_id", "start_ref", "elapsed_ms")


@query("anchored_entities", f"""WITH {EV}, s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ep FROM e),
h AS (SELECT *, bool_or(event_type = 'view') OVER (PARTITION BY user_id, ep, k % 6 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM s)
SELECT event_id, CAST(ep AS BIGINT) AS session_epoch FROM h WHERE event_type = 'purchase' AND held""")
def anchored_entities(spark, sf):
    t = F.col("event_type")
    e = events(spark, sf).withColumn("vehicle", F.col("k") % 6)
    out = correlate.anchored(e, _KEY, _ORDER, t == "signup", t == "view", "vehicle", t == "purchase")
    return out.select("event_id", "session_epoch")


@query("interval_match", f"""WITH {EV}, m AS (SELECT *, lag(event_type) OVER w AS pt, lag(ms) OVER w AS pm, lag(event_id) OVER w AS pe FROM e WHERE event_type IN ('click', 'purchase')
WINDOW w AS (PARTITION BY user_id, k % 3 ORDER BY event_id)) SELECT event_id, pe AS open_ref, ms - pm AS elapsed_ms FROM m WHERE event_type = 'purchase' AND pt = 'click' AND ms - pm <= {_H}""")
def interval_match(spark, sf):
    t = F.col("event_type")
    e = events(spark, sf).withColumn("vehicle", F.col("k") % 3)
    out = correlate.interval_match(e, ["user_id", "vehicle"], _ORDER, "ms", t == "click", t == "purchase", _H)
    return out.select("event_id", "open_ref", "elapsed_ms")


@query("target_transitions", f"""WITH {EV}, m AS (SELECT *, lag(event_type) OVER w AS pt, lag(k % 4) OVER w AS pk FROM e WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, 'arrived' AS transition, NULL AS previous_target, CAST(pk AS VARCHAR) AS current_target FROM m WHERE event_type = 'purchase' AND pt = 'click'
UNION ALL SELECT event_id, 'selected', NULL, CAST(k % 4 AS VARCHAR) FROM m WHERE event_type = 'click' AND coalesce(pt, 'purchase') = 'purchase'
UNION ALL SELECT event_id, 'changed', CAST(pk AS VARCHAR), CAST(k % 4 AS VARCHAR) FROM m WHERE event_type = 'click' AND pt = 'click' AND pk <> k % 4""")
def target_transitions(spark, sf):
    t = F.col("event_type")
    out = correlate.target_transitions(events(spark, sf), _KEY, _ORDER, t == "click", t == "purchase", F.col("k") % 4)
    return out.select("event_id", "transition", "previous_target", "current_target")


_OPEN = "STRUCT(id BIGINT, ms BIGINT, req VARCHAR)[]"


@query("match_purchases", f"""WITH RECURSIVE {EV}, q AS (SELECT user_id, event_id, ms, event_type = 'click' AS asks, CASE WHEN k % 2 = 0 THEN CAST(k % 5 AS VARCHAR) END AS req,
CASE WHEN k % 10 = 9 THEN 'unknown' WHEN k % 3 = 0 THEN 'failure' ELSE 'success' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM e WHERE event_type IN ('click', 'purchase')),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS {_OPEN}) AS opened, false AS unsure, true AS asks, CAST(NULL AS BIGINT) AS ident, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS BIGINT) AS hit, '' AS outcome FROM q WHERE n = 1
UNION ALL SELECT user_id, n, CASE WHEN asks THEN list_concat(alive, CAST([{{'id': event_id, 'ms': ms, 'req': req}}] AS {_OPEN})) WHEN hit IS NOT NULL THEN list_filter(alive, lambda x: x.id <> hit) ELSE alive END,
flag OR (asks AND len(alive) > 0), asks, event_id, ms, hit, outcome FROM (
SELECT *, CASE WHEN NOT asks AND outcome <> 'unknown' AND len(found) = 1 THEN found[1].id END AS hit FROM (
SELECT *, CASE WHEN req IS NOT NULL THEN list_filter(alive, lambda x: x.req = req) WHEN len(alive) = 1 AND NOT flag THEN alive ELSE CAST([] AS {_OPEN}) END AS found FROM (
SELECT *, unsure AND len(alive) > 0 AS flag FROM (
SELECT q.*, w.unsure, list_filter(w.opened, lambda x: q.ms - x.ms <= {_H}) AS alive FROM w JOIN q ON q.user_id = w.user_id AND q.n = w.n + 1)))))
SELECT user_id, ident, ms, hit AS request_ident, CASE WHEN hit IS NULL THEN 'unmatched' ELSE outcome END AS status FROM w WHERE NOT asks""")
def match_purchases(spark, sf):
    t, k = F.col("event_type"), F.col("k")
    e = events(spark, sf)
    out = correlate.match_purchases(
        e, _KEY, "ms", "event_id", t == "click", t == "purchase", F.when(k % 2 == 0, k % 5),
        F.when(k % 10 == 9, "unknown").when(k % 3 == 0, "failure").otherwise("success"), _H,
    )
    return out


@query("match_purchases_single", f"""WITH {EV}, m AS (SELECT *, lag(event_type) OVER w AS pt, lag(ms) OVER w AS pm, lag(event_id) OVER w AS pe, lag(event_type, 2) OVER w AS ppt, lag(ms, 2) OVER w AS ppm,
lead(event_type) OVER w AS nt FROM e WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id, k % 50 ORDER BY event_id))
SELECT user_id, k % 50 AS context, event_id AS ident, pe AS request_ident FROM m WHERE event_type = 'purchase' AND pt = 'click' AND ms - pm <= {_H} AND (ppt IS NULL OR ms - ppm > {2 * _H} OR (ppt = 'purchase' AND false))""")
def match_purchases_single(spark, sf):
    """Responses whose context holds exactly one request and nothing else for two windows before."""
    t = F.col("event_type")
    e = events(spark, sf).withColumn("context", F.col("k") % 50)
    out = correlate.match_purchases(e, ["user_id", "context"], "ms", "event_id", t == "click", t == "purchase",
                                    F.lit(None).cast("string"), F.lit("success"), _H)
    marks = e.where(t.isin("click", "purchase"))
    prior = correlate.asof_last(
        marks, ["user_id", "context"], _ORDER, t == "purchase", {"_rows": F.struct("event_id", "ms")}, inclusive=False
    ).select("user_id", "context", "event_id", F.col("_rows.event_id").alias("_p1"))
    before = correlate.asof_last(
        marks, ["user_id", "context"], _ORDER, F.lit(True), {"_rows": F.struct("ms")}, inclusive=False
    ).select(F.col("event_id").alias("_p1"), F.col("_rows.ms").alias("_p2_ms"))
    alone = prior.join(before, "_p1", "left")
    return (
        out.join(alone.withColumnRenamed("event_id", "ident"), ["user_id", "context", "ident"])
        .where(F.col("request_ident").isNotNull() & (F.col("_p2_ms").isNull() | (F.col("ms") - F.col("_p2_ms") > 2 * _H)))
        .select("user_id", "context", "ident", "request_ident")
    )


# --- sessions ---------------------------------------------------------------------------------------------------------
def _sessions(spark, sf):
    e = events(spark, sf)
    # a user moves to another environment from event to event in long runs
    return e.select(
        "user_id", "event_id", "ms", (F.col("event_type") == "signup").alias("is_join"), (F.col("event_type") == "error").alias("is_leave"),
        F.concat(F.lit("e"), F.expr("cast((ms div 259200000) % 3 as string)")).alias("environment_key"),
        F.concat(F.lit("h"), (F.col("k") % 4).cast("string")).alias("address"), F.lit("1").alias("port"),
        F.when(F.col("k") % 3 > 0, F.concat(F.lit("h"), (F.col("k") % 4).cast("string"), F.lit(":1"))).alias("endpoint"),
    )


_SESS = f"""{EV}, r AS (SELECT *, 'e' || ((ms // 259200000) % 3) AS env_key FROM e), m AS (SELECT *, lag(env_key) OVER (PARTITION BY user_id ORDER BY event_id) AS pk FROM r),
b AS (SELECT *, lead(event_id) OVER w AS np, lead(ms) OVER w AS nm, lead(env_key) OVER w AS ne FROM m WHERE event_type = 'signup' OR coalesce(pk <> env_key, false) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, env_key AS environment_key, event_id AS start_pos, ms AS started_ms, CASE WHEN ne <> env_key THEN np ELSE np - 1 END AS end_pos, nm AS ended_ms,
CASE WHEN np IS NULL THEN NULL WHEN ne <> env_key THEN 'environment_changed' ELSE 'superseded_by_join' END AS stale_reason FROM b WHERE event_type = 'signup')"""


@query("server_sessions", f"WITH {_SESS} SELECT * FROM s")
def server_sessions(spark, sf):
    return sessions.server_sessions(_sessions(spark, sf), _KEY, "event_id", "ms")


@query("session_stats", f"""WITH {_SESS} SELECT environment_key, CAST(count(*) AS BIGINT) AS sessions, CAST(count(ended_ms) AS BIGINT) AS closed, CAST(sum(ended_ms - started_ms) AS BIGINT) AS duration_ms,
CAST(count(*) FILTER (WHERE stale_reason = 'environment_changed') AS BIGINT) AS environment_changes FROM s GROUP BY 1""")
def session_stats(spark, sf):
    return sessions.session_stats(sessions.server_sessions(_sessions(spark, sf), _KEY, "event_id", "ms"), ["environment_key"])


#: the walk over joins and leaves as a recursion per user: the open session, and up to eight earlier ones, newest first
_SEAT = "STRUCT(env VARCHAR, pos BIGINT, ep VARCHAR)"
_WALK = f"""{EV}, q AS (SELECT user_id, event_id, ms, event_type, k, 'e' || ((ms // 259200000) % 3) AS env, 'h' || (k % 4) || ':1' AS ep,
CASE WHEN k % 3 > 0 THEN 'h' || (k % 4) || ':1' END AS endpoint, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS {_SEAT}) AS cur, CAST([] AS {_SEAT}[]) AS older, CAST(NULL AS BIGINT) AS leave_pos, CAST(NULL AS BIGINT) AS session_pos FROM q WHERE n = 1
UNION ALL SELECT user_id, n, CASE WHEN event_type = 'signup' THEN here WHEN hit = c.pos THEN NULL ELSE c END,
CASE WHEN event_type = 'signup' AND c IS NOT NULL THEN list_concat([c], older)[1:8] WHEN hit IS NOT NULL THEN list_filter(older, lambda x: x.pos <> hit) ELSE older END,
CASE WHEN event_type = 'error' THEN event_id END, hit FROM (
SELECT *, CASE WHEN event_type = 'error' THEN CASE WHEN len(same) = 1 THEN same[1].pos WHEN len(same) = 0 AND len(able) = 1 THEN able[1].pos END END AS hit FROM (
SELECT *, list_filter(able, lambda x: x.ep = endpoint) AS same FROM (
SELECT *, list_filter(CASE WHEN c IS NULL THEN older ELSE list_concat([c], older) END, lambda x: x.env = env) AS able FROM (
SELECT q.user_id, q.n, q.event_id, q.event_type, q.env, q.endpoint, w.older, CASE WHEN w.cur.env = q.env THEN w.cur END AS c,
CAST({{'env': q.env, 'pos': q.event_id, 'ep': q.ep}} AS {_SEAT}) AS here FROM w JOIN q ON q.user_id = w.user_id AND q.n = w.n + 1)))))"""
_LEFT = "SELECT user_id, leave_pos, session_pos FROM w WHERE leave_pos IS NOT NULL"


@query("leave_attribution", f"WITH RECURSIVE {_WALK} {_LEFT}")
def leave_attribution(spark, sf):
    return sessions.attribute_leaves(_sessions(spark, sf), _KEY, "event_id")


_CLOSED = f"""{_WALK}, r AS{_SESS.split("r AS", 1)[1]}, l AS ({_LEFT} AND session_pos IS NOT NULL),
o AS (SELECT s.*, l.leave_pos, x.ms AS leave_ms, least(CASE WHEN stale_reason = 'superseded_by_join' THEN end_pos + 1 ELSE end_pos END, l.leave_pos) AS until
FROM s LEFT JOIN l ON l.user_id = s.user_id AND l.session_pos = s.start_pos LEFT JOIN e x ON x.event_id = l.leave_pos),
a AS (SELECT o.user_id, o.start_pos, count(*) AS c FROM o JOIN e ON e.user_id = o.user_id AND e.event_id > o.start_pos AND (until IS NULL OR e.event_id < until)
WHERE e.event_type IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM s t WHERE t.user_id = o.user_id AND t.start_pos > o.start_pos AND t.start_pos < e.event_id) GROUP BY 1, 2),
f AS (SELECT o.user_id, environment_key, o.start_pos, started_ms, coalesce(leave_pos, end_pos) AS end_pos, CASE WHEN leave_pos IS NULL THEN ended_ms ELSE leave_ms END AS ended_ms,
CASE WHEN leave_pos IS NULL THEN stale_reason END AS stale_reason, CAST(coalesce(c, 0) + (leave_pos IS NOT NULL)::INT AS BIGINT) AS action_count FROM o LEFT JOIN a ON a.user_id = o.user_id AND a.start_pos = o.start_pos)"""


def _closed(spark, sf):
    marks = _sessions(spark, sf).join(events(spark, sf).select("event_id", F.col("event_type").isin("click", "view").alias("is_action")), "event_id")
    return sessions.closed_sessions(marks, _KEY, "event_id", "ms")


@query("closed_sessions", f"WITH RECURSIVE {_CLOSED} SELECT * FROM f")
def closed_sessions(spark, sf):
    return _closed(spark, sf)


@query("closed_session_stats", f"""WITH RECURSIVE {_CLOSED} SELECT environment_key, CAST(count(*) AS BIGINT) AS sessions, CAST(count(ended_ms) AS BIGINT) AS closed, CAST(sum(ended_ms - started_ms) AS BIGINT) AS duration_ms,
CAST(count(*) FILTER (WHERE stale_reason = 'environment_changed') AS BIGINT) AS environment_changes, CAST(sum(action_count) AS BIGINT) AS actions FROM f GROUP BY 1""")
def closed_session_stats(spark, sf):
    return sessions.session_stats(_closed(spark, sf), ["environment_key"])


def _sightings(spark, sf):
    e = events(spark, sf)
    k = F.col("k")
    body = pick(signup=text("ShardID: s", k % 9, " Build: b", k % 4), view=text("Region: r", k % 3, " shard_id=s", k % 9))
    lines = as_lines(e, F.coalesce(body, F.lit("nothing"))).join(e.select(F.col("event_id").alias("line_no"), "ms"), "line_no")
    facts = sessions.shard_facts(F.col("text"))
    return sessions.shard_sightings(lines.withColumns(facts).drop("text"), ["source_id", "generation"])


_SIGHT = f"""{EV}, i AS (SELECT event_id, user_id, ms, 's' || (k % 9) AS sid, CASE WHEN event_type = 'view' THEN 'r' || (k % 3) END AS rg, CASE WHEN event_type = 'signup' THEN 'b' || (k % 4) END AS bd FROM e WHERE event_type IN ('signup', 'view')),
n AS (SELECT a.event_id, a.user_id, a.ms, a.sid, coalesce(any_value(a.rg), arg_max(c.rg, c.event_id) FILTER (WHERE c.rg IS NOT NULL)) AS region, coalesce(any_value(a.bd), arg_max(c.bd, c.event_id) FILTER (WHERE c.bd IS NOT NULL)) AS build
FROM i a JOIN i c ON a.user_id = c.user_id AND c.event_id BETWEEN a.event_id - 6 AND a.event_id + 6 GROUP BY 1, 2, 3, 4)"""


@query("shard_sightings", f"WITH {_SIGHT} SELECT event_id AS line_no, sid AS shard_id, region, build AS shard_build FROM n")
def shard_sightings(spark, sf):
    return _sightings(spark, sf).select("line_no", "shard_id", "region", "shard_build")


@query("shard_merge", f"""WITH {_SIGHT} SELECT CAST(user_id AS VARCHAR) AS source_id, sid AS shard_id, CAST(count(*) AS BIGINT) AS sightings, min(event_id) AS line_no, arg_min(ms, event_id) AS first_ms, arg_max(ms, event_id) AS last_ms,
arg_min(region, event_id) FILTER (WHERE region IS NOT NULL) AS region, arg_min(build, event_id) FILTER (WHERE build IS NOT NULL) AS shard_build FROM n GROUP BY 1, 2""")
def shard_merge(spark, sf):
    return sessions.merge_sightings(_sightings(spark, sf), ["source_id"]).drop("shard_name")


def _activity(ident: str, ref: str, named: str) -> str:
    """Least fixed point over the ids: a line teaches its own id from any known id in it, itself included, that was known by then."""
    return f"""WITH RECURSIVE {EV}, l AS (SELECT env, event_id AS pos, {ident} AS id, {ref} AS ref, {named} AS named FROM e),
t AS (SELECT env, pos, id, id AS known_id FROM l UNION SELECT env, pos, id, ref FROM l WHERE ref IS NOT NULL),
g AS (SELECT env, id, min(pos) AS since FROM l WHERE named GROUP BY 1, 2 UNION SELECT t.env, t.id, t.pos FROM g JOIN t ON t.env = g.env AND t.known_id = g.id AND t.pos >= g.since),
b AS (SELECT env, id, min(since) AS since FROM g GROUP BY 1, 2)
SELECT env AS environment_key, pos, id AS user_id FROM l WHERE named OR EXISTS (SELECT 1 FROM t JOIN b ON b.env = t.env AND b.id = t.known_id WHERE t.env = l.env AND t.pos = l.pos AND l.pos >= b.since)"""


@query("user_activity_chain", _activity("'acc' || user_id || 'x'", "CASE WHEN k % 25 = 0 THEN 'acc' || (user_id + 3) || 'x' END", "user_id % 11 = 7 AND k < 50"))
def user_activity_chain(spark, sf):
    """Ids learned from ids: some lines also hold the id of another user of the same environment."""
    e = events(spark, sf)
    k, user = F.col("k"), F.col("user_id")
    body = F.concat(
        F.when((user % 11 == 7) & (k < 50), "handle: Pilot7 ").otherwise(""), text("accountId: acc", user, "x"),
        F.when(k % 25 == 0, text(" with (acc", user + 3, "x)")).otherwise(""),
    )
    lines = e.select(F.col("env").alias("environment_key"), F.col("event_id").alias("pos"), body.alias("text"))
    return sessions.user_activity(lines, "pilot7").select("environment_key", "pos", "user_id")


@query("user_activity", _activity("'acc' || k || 'x'", "NULL::VARCHAR", "user_id % 5 = 1"))
def user_activity(spark, sf):
    e = events(spark, sf)
    k = F.col("k")
    body = F.concat(
        F.when(F.col("user_id") % 5 == 1, "handle: pilot7 ").otherwise(""), text("accountId: acc", k, "x ref acc", (k * 7 + 3) % 100, "y")
    )
    lines = e.select(F.col("env").alias("environment_key"), F.col("event_id").alias("pos"), body.alias("text"))
    return sessions.user_activity(lines, "pilot7").select("environment_key", "pos", "user_id")


@query("party_comms", f"""WITH {EV} SELECT event_id AS line_no, 'm' || k AS member, CASE WHEN event_type = 'signup' THEN 'party_comms_connect' ELSE 'party_comms_disconnect' END AS transition
FROM e WHERE event_type IN ('signup', 'view')""")
def party_comms(spark, sf):
    e = events(spark, sf)
    tail = ". x Action: {} y [Team_CoreGameplayFeatures][Missions][Comms]"
    body = pick(signup=text("m", F.col("k"), " connected", tail.format("Add")), view=text("m", F.col("k"), " connected", tail.format("Remove")),
                click=text("m", F.col("k"), " connected. nothing"))
    return sessions.party_comms(as_lines(e, F.concat(stamp(), F.coalesce(body, F.lit("-"))))).select("line_no", "member", "transition")


@query("related_events", f"""WITH {EV}, c AS (SELECT env, event_id, ms, 'user' || user_id AS v FROM e UNION ALL SELECT env, event_id, ms, 'k' || k FROM e),
t AS (SELECT env, max(event_id) AS target_id FROM e GROUP BY 1), w AS (SELECT DISTINCT c.env, c.v, target_id FROM c JOIN t ON c.env = t.env AND c.event_id = t.target_id),
h AS (SELECT DISTINCT c.env, target_id, c.event_id, c.ms FROM c JOIN w USING (env, v) WHERE c.event_id <> target_id)
SELECT env AS environment_key, target_id, event_id, row_number() OVER (PARTITION BY env ORDER BY ms DESC, event_id) AS rank FROM h QUALIFY rank <= 20""")
def related_events(spark, sf):
    e = events(spark, sf)
    pairs = F.explode(F.array(F.concat(F.lit("user"), F.col("user_id")), F.concat(F.lit("k"), F.col("k")))).alias("value")
    corr = e.select(F.col("env").alias("environment_key"), pairs, "event_id", "ms")
    targets = e.groupBy(F.col("env").alias("environment_key")).agg(F.max("event_id").alias("event_id"))
    return correlate.related_events(corr, targets).select("environment_key", "target_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("related_contributors", f"""WITH {EV}, t AS (SELECT env, event_id AS target_id, user_id, k FROM e WHERE event_type = 'purchase'),
h AS (SELECT t.env, target_id, e.event_id, e.ms FROM t JOIN e ON e.env = t.env AND e.user_id = t.user_id UNION SELECT t.env, target_id, e.event_id, e.ms FROM t JOIN e ON e.env = t.env AND e.k = t.k
UNION SELECT t.env, target_id, e.event_id, e.ms FROM t JOIN e ON e.env = t.env AND e.event_id BETWEEN target_id - 4 AND target_id - 1)
SELECT env AS environment_key, target_id, event_id, row_number() OVER (PARTITION BY env, target_id ORDER BY ms DESC, event_id) AS rank FROM h WHERE event_id <> target_id QUALIFY rank <= 7""")
def related_contributors(spark, sf):
    """The seven newest relations of every purchase, events just before it included as contributors."""
    e = events(spark, sf).withColumnRenamed("env", "environment_key")
    pairs = F.explode(F.array(F.concat(F.lit("user"), F.col("user_id")), F.concat(F.lit("k"), F.col("k")))).alias("value")
    targets = e.where(F.col("event_type") == "purchase").select("environment_key", "event_id")
    before = targets.select("event_id", F.explode(F.sequence(F.col("event_id") - 4, F.col("event_id") - 1)).alias("contributor_id"))
    out = correlate.related_events(e.select("environment_key", pairs, "event_id", "ms"), targets, 7, before, e)
    return out.select("environment_key", "target_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("lineage", f"""WITH {EV} SELECT p.event_id, c.event_id AS contributor_id, c.event_type AS contributor_type FROM e p JOIN e c ON c.event_id IN (p.event_id - 1, p.event_id - 2) WHERE p.event_type = 'purchase'""")
def lineage(spark, sf):
    e = events(spark, sf)
    refs = F.when(F.col("event_type") == "purchase", F.filter(F.array(F.col("event_id") - 1, F.col("event_id") - 2), lambda x: x >= 0))
    return correlate.lineage(e.select("event_id", "event_type", F.coalesce(refs, F.array().cast("array<bigint>")).alias("contributors")))


@query("suppress_normalized", f"""WITH {EV} SELECT event_id, event_type FROM e WHERE NOT (event_type = 'purchase' AND k % 2 = 0)""")
def suppress_normalized(spark, sf):
    e = events(spark, sf)
    typed = e.where((F.col("event_type") == "purchase") & (F.col("k") % 2 == 0)).select("user_id", "event_id")
    return correlate.suppress_normalized(e, typed, ["user_id", "event_id"]).select("event_id", "event_type")


@query("catalogue_resolve", """WITH c AS (SELECT p_partkey // 3 AS item_id, p_name, p_size > 5 AS ok, p_size * 100 AS exp FROM part), g AS (SELECT item_id, count(*) AS n, min(p_name) AS nm, bool_or(ok) AS ok FROM c WHERE exp > 1500 GROUP BY 1),
w AS (SELECT DISTINCT l_partkey AS item_id FROM lineitem) SELECT item_id, CASE WHEN n = 1 AND ok THEN nm END AS name, CASE WHEN coalesce(n, 0) = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN NOT ok THEN 'unsupported' ELSE 'exact' END AS status
FROM w LEFT JOIN g USING (item_id)""")
def catalogue_resolve(spark, sf):
    p = table(spark, sf, "part").select(
        F.expr("p_partkey div 3").alias("item_id"), F.col("p_name").alias("name"), (F.col("p_size") > 5).alias("supported"), (F.col("p_size") * 100).alias("expires_ms")
    )
    return correlate.resolve_items(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id")), p, 1500)


# --- inventory --------------------------------------------------------------------------------------------------------
def _inventory_lines(spark, sf):
    """Requests, queues and completions of one player; the request id repeats, signups break the session."""
    e = events(spark, sf)
    k, user = F.col("k"), F.col("user_id")
    head = text("Request[", k % 3, "] Player[p", user, "] ")
    loc, box = "loc:Location:1", "box:Container:1"
    where = F.when(k % 2 == 0, F.lit(loc)).otherwise(F.lit(box))
    body = pick(
        click=text("[Notice] <Add Inventory Management Move> ", head, "Type[Move] ItemClass[item_", k % 2, "] SourceInventory[", where, "] TargetInventory[", box, "2]"),
        view=text("[Notice] <Inventory Mgmt Request Queued> ", head, "Type[Move] Source[item_", k % 2, "] Source Inventory[", where, "] Target Inventory[", box, "2] amount[", k % 4, "]"),
        purchase=text("[Notice] <Player Inventory Request Complete> ", head, "Type[Move] Result[", F.when(k % 5 == 0, "failed").otherwise("succeed"), "]"),
        signup=F.lit("<Init> start"),
        error=F.lit("[Notice] <Other> note"),
    )
    return as_lines(e, F.concat(stamp(), body))


_IW = 2 * 24 * 3600_000


def _contexts(spark, sf):
    lines, lane = split_keys(_inventory_lines(spark, sf), ["source_id", "generation"], ["byte_offset"])
    cut = inventory.inventory_records(lines).drop("text")
    reviewed = spark.createDataFrame([("LIVE", ["Move", "Drop", "Interaction"])], "scope string, operations array<string>")
    return inventory.inventory_context(cut, lane, reviewed, _IW)


_INV = f"""WITH RECURSIVE {EV}, a AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ep, k % 3 AS rq FROM e),
b AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, ep, rq ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS leg FROM a WHERE event_type IN ('click', 'view', 'purchase')),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, ep, rq, leg ORDER BY event_id) AS n FROM b WHERE event_type = 'click'),
f AS (SELECT user_id, ep, rq, leg, n, event_id, ms, ms AS opened, true AS starts FROM q WHERE n = 1 UNION ALL
 SELECT q.user_id, q.ep, q.rq, q.leg, q.n, q.event_id, q.ms, CASE WHEN q.ms - f.opened > {_IW} THEN q.ms ELSE f.opened END, q.ms - f.opened > {_IW} FROM f JOIN q ON (q.user_id, q.ep, q.rq, q.leg, q.n) = (f.user_id, f.ep, f.rq, f.leg, f.n + 1)),
o AS (SELECT b.*, last_value(f.opened IGNORE NULLS) OVER (PARTITION BY b.user_id, b.ep, b.rq, b.leg ORDER BY b.event_id ROWS UNBOUNDED PRECEDING) AS opened FROM b LEFT JOIN f ON f.event_id = b.event_id AND f.starts),
g AS (SELECT user_id, ep, rq, leg, opened, count(*) FILTER (WHERE event_type = 'click') AS nreq, arg_min(k, event_id) FILTER (WHERE event_type = 'click') AS rk,
 min(k % 2) FILTER (WHERE event_type = 'view') AS qi0, max(k % 2) FILTER (WHERE event_type = 'view') AS qi1,
 min(k % 4) FILTER (WHERE event_type = 'view' AND k % 4 > 0) AS n0, max(k % 4) FILTER (WHERE event_type = 'view' AND k % 4 > 0) AS n1,
 count(DISTINCT (k % 2, k % 4)) FILTER (WHERE event_type = 'view') AS qd, count(*) FILTER (WHERE event_type = 'view') AS qn,
 max(event_id) FILTER (WHERE event_type = 'purchase') AS done, max(k) FILTER (WHERE event_type = 'purchase') AS dk
 FROM o WHERE opened IS NOT NULL AND ms - opened <= {_IW} GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT *, rk % 2 AS item, CASE WHEN qn > 0 AND qd = 1 THEN true ELSE false END AS routed FROM g WHERE done IS NOT NULL AND nreq = 1 AND coalesce(qi0 = rk % 2, true) AND coalesce(qi1 = rk % 2, true) AND coalesce(n0 = n1, true))"""


@query("inventory_context", f"""{_INV} SELECT done AS byte_offset, 'item_' || item AS item, n0 AS quantity, CASE WHEN dk % 5 = 0 THEN 'failed' ELSE 'succeed' END AS result FROM c""")
def inventory_context(spark, sf):
    return _contexts(spark, sf).select("byte_offset", "item", "quantity", "result")


def _routed(spark, sf):
    c = _contexts(spark, sf)
    return c.withColumn("route", inventory.inventory_route(F.col("requested"), F.col("queued"), F.col("quantity"))).withColumn("matched", F.lit(True))


@query("inventory_route", f"""{_INV} SELECT done AS byte_offset, CASE WHEN routed THEN 'transfer' END AS kind, CASE WHEN routed THEN CASE WHEN rk % 2 = 0 THEN 'location_inventory' ELSE 'container' END END AS origin FROM c""")
def inventory_route(spark, sf):
    return _routed(spark, sf).select("byte_offset", F.col("route.kind").alias("kind"), F.col("route.from").alias("origin"))


@query("inventory_outcomes", f"""{_INV} SELECT CASE WHEN dk % 5 = 0 THEN 'reported_failure' WHEN NOT routed THEN 'route_unresolved' WHEN n0 IS NULL THEN 'quantity_unknown' WHEN rk % 2 = 0 THEN 'location_change_reported' ELSE 'no_location_change_identified' END AS status,
CAST(count(*) AS BIGINT) AS results, CAST(sum(CASE WHEN dk % 5 > 0 AND routed AND rk % 2 = 0 THEN -n0 END) AS BIGINT) AS source_delta FROM c GROUP BY 1""")
def inventory_outcomes(spark, sf):
    done = inventory.audit_results(_routed(spark, sf))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("results"), F.sum("source_delta").alias("source_delta"))


@query("inventory_audit", f"""WITH {EV} SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS BIGINT) AS known_records,
CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS requests_move, CAST(count(*) FILTER (WHERE event_type = 'click' AND k % 2 = 0) AS BIGINT) AS location_requests,
CAST(count(*) FILTER (WHERE event_type = 'view' AND k % 4 = 0) AS BIGINT) AS zero_queues, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS primary_results,
min(ms) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS first_ms FROM e WHERE ms >= 1704672000000 OR false GROUP BY 1""")
def inventory_audit(spark, sf):
    out = inventory.inventory_audit(_inventory_lines(spark, sf), ["source_id"], 1704672000000)
    return out.select("source_id", "known_records", "requests_move", "location_requests", "zero_queues", "primary_results", "first_ms").where("known_records > 0 or first_ms is not null")


