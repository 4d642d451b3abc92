"""Framing, dispatch, typed events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracewright.functions.identity import event_id, order_key, scoped_id
from tracewright.functions.text import bracket, keyed, notification, outcome_kind, to_integer
from tracewright.operators import contracts, dedupe, emission, framing, health, rules, signals
from tracewright.workload.base import DEFAULTS, EV, TYPES, as_lines, events, pick, query, session_lines, sql_case, stamp, table, text, type_name

_SPLIT = """p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS part, len(parts) AS n FROM p),
o AS (SELECT *, strlen(part) + CASE WHEN line_no < n THEN 1 ELSE 0 END AS byte_length,
  coalesce(sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS byte_offset FROM l)"""


def _documents(spark, sf):
    return framing.read_text_cells(spark, table(spark, sf, "documents"), "doc_id", "text")


@query("frame_lines", f"""WITH {_SPLIT} SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(line_no AS BIGINT) AS line_no,
CAST(byte_offset AS BIGINT) AS byte_offset, CAST(byte_length AS BIGINT) AS byte_length, part AS text FROM o WHERE part <> ''""")
def frame_lines(spark, sf):
    return framing.drop_empty(framing.frame_lines(_documents(spark, sf), emit_incomplete=True)).drop("generation")


@query("line_quarantine", f"""WITH {_SPLIT} SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(line_no AS BIGINT) AS line_no,
CAST(byte_offset AS BIGINT) AS byte_offset, 'line_too_long' AS code, 'warn' AS severity, CAST(byte_length AS BIGINT) AS measure
FROM o WHERE byte_length > 1024""")
def line_quarantine(spark, sf):
    lines = framing.frame_lines(_documents(spark, sf), emit_incomplete=True)
    return framing.split_oversized(lines, 1024)[1].drop("generation")


def _mixed_lines(spark, sf):
    """Continuations (error), open notifications (view), their closing lines (click), complete records (others)."""
    e = events(spark, sf)
    hour = stamp(F.expr("ms - ms % 86400000"))
    body = pick(
        error=text("  detail ", F.col("k")),
        view=text(hour, '[Notice] <SHUDEvent_OnNotification> Added notification "Seen ', F.col("k")),
        click=text(hour, "item ", F.col("k"), ' joined.: " [', F.col("event_id"), "] to queue."),
        signup=text(stamp(), "[Notice] <Signup> k[", F.col("k"), "]"),
        purchase=text(stamp(), "[Notice] <Purchase> k[", F.col("k"), "]"),
    )
    return as_lines(e, body)


_DAY = "strftime(make_timestamp((ms - ms % 86400000) * 1000), '%Y-%m-%dT%H:%M:%S.000Z')"
_ASM = f"""{EV},
t AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS pos, event_type = 'error' AS cont, event_type = 'view' AS op,
  event_type = 'click' AS cl, CASE WHEN event_type IN ('view', 'click') THEN ms // 86400000 ELSE -1 - event_id END AS st,
  CASE event_type WHEN 'error' THEN '  detail ' || k
   WHEN 'view' THEN '<' || {_DAY} || '> [Notice] <SHUDEvent_OnNotification> Added notification "Seen ' || k
   WHEN 'click' THEN '<' || {_DAY} || '> item ' || k || ' joined.: " [' || event_id || '] to queue.' ELSE NULL END AS raw FROM e),
h AS (SELECT *, max(CASE WHEN op THEN pos END) OVER w AS head, last_value(CASE WHEN op THEN st END IGNORE NULLS) OVER w AS hst,
  max(CASE WHEN cl THEN pos END) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc
  FROM t WINDOW w AS (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
j AS (SELECT *, (head IS NOT NULL AND pos > head AND (pc IS NULL OR pc < head) AND cl AND st = hst) AS joined FROM h),
b AS (SELECT *, max(CASE WHEN head IS NOT NULL AND pos > head AND NOT joined AND NOT cont THEN pos END) OVER (
  PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS brk FROM j),
r AS (SELECT *, max(CASE WHEN NOT cont AND NOT (joined AND (brk IS NULL OR brk < head)) THEN pos END) OVER (
  PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS rid FROM b),
z AS (SELECT *, row_number() OVER (PARTITION BY source_id, rid ORDER BY pos) AS nth FROM r WHERE rid IS NOT NULL),
g AS (SELECT source_id, rid, count(*) AS line_count, max(pos) AS end_line, min(CASE WHEN cont AND nth > LIMIT_N THEN pos END) AS spill
  FROM z GROUP BY 1, 2)"""


@query("assemble_records", f"""WITH {_ASM.replace('LIMIT_N', '8')} SELECT source_id, rid AS byte_offset, end_line,
CAST(line_count AS BIGINT) AS line_count FROM g WHERE spill IS NULL""")
def assemble_records(spark, sf):
    recs = framing.records_of(_mixed_lines(spark, sf))
    return recs.select("source_id", "byte_offset", "end_line", "line_count")


@query("record_text", f"""WITH {_ASM.replace('LIMIT_N', '8')} SELECT z.source_id, z.rid AS byte_offset,
regexp_replace(regexp_replace(string_agg(raw, chr(10) ORDER BY pos), '\\s*\\n\\s*', ' ', 'g'), '\\s<\\d{{4}}-\\d{{2}}-\\d{{2}}T[^>]+>\\s*', ' ', 'g') AS text
FROM z JOIN g USING (source_id, rid) WHERE spill IS NULL GROUP BY 1, 2 HAVING count(raw) = count(*)""")
def record_text(spark, sf):
    recs = framing.records_of(_mixed_lines(spark, sf))
    own = ~F.contains("text", F.lit("<Signup>")) & ~F.contains("text", F.lit("<Purchase>"))
    return recs.where(own).select("source_id", "byte_offset", "text")


@query("continuation_bounds", f"""WITH {_ASM.replace('LIMIT_N', '2')}
SELECT source_id, rid AS byte_offset, 'record_continuation_limit_exceeded' AS code FROM g WHERE spill IS NOT NULL
UNION ALL SELECT z.source_id, z.pos, 'orphan_continuation_line' FROM z JOIN g USING (source_id, rid) WHERE spill IS NOT NULL AND z.pos > spill
UNION ALL SELECT source_id, pos, 'orphan_continuation_line' FROM r WHERE rid IS NULL""")
def continuation_bounds(spark, sf):
    diag = framing.assemble_records(_mixed_lines(spark, sf), max_lines=2)[1]
    return diag.select("source_id", "byte_offset", "code")


@query("evidence_slice", f"""WITH {EV} SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(event_id AS VARCHAR) AS event_id
FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 12""")
def evidence_slice(spark, sf):
    lines = session_lines(spark, sf)
    ev = lines.select(
        "source_id", "generation", "byte_offset", F.col("byte_offset").alias("event_id"),
        F.lpad(F.col("byte_offset").cast("string"), 16, "0").alias("order_key"),
    )
    return framing.evidence_for(ev, lines, 12, 64 * 1024, 256 * 1024).select("source_id", "event_id")


# --- rendered log -----------------------------------------------------------------------------------------------------
_CASE = sql_case(TYPES)


@query("parse_rendered_log", f"""WITH {EV} SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS line_no, {_CASE} AS event_type,
strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS source_timestamp,
CASE event_type WHEN 'signup' THEN 'shard_' || (k % 7) WHEN 'click' THEN CAST(event_id AS VARCHAR) WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'entered' ELSE 'left' END
 WHEN 'purchase' THEN 'job ' || k WHEN 'error' THEN 'host' || k || '.example.invalid' END AS main_field FROM e""")
def parse_rendered_log(spark, sf):
    parsed = emission.parse_records(_records(spark, sf), spark, DEFAULTS)
    field = F.create_map(
        *[F.lit(x) for x in ("PuJoinRequested", "shard", "MonitoredSpaceEntered", "notificationId", "ArmisticeStateChanged",
                             "state", "MissionAccepted", "contractName", "PuDisconnected", "endpoint")]
    )
    return parsed.events.select(
        "source_id", "line_no", "event_type", "source_timestamp",
        F.try_element_at(F.col("payload"), F.try_element_at(field, F.col("event_type"))).alias("main_field"),
    )


def _records(spark, sf):
    return framing.records_of(session_lines(spark, sf))


@query("dispatch_rules", f"""WITH {EV}, m(t, r) AS (VALUES ('signup', 'pu.join-requested'), ('click', 'zone.monitored-entered'),
('purchase', 'mission.contract-accepted'), ('error', 'disconnect.channel')),
x AS (SELECT event_id, user_id, r FROM e JOIN m ON t = event_type UNION ALL SELECT event_id, user_id,
CASE WHEN k % 2 = 0 THEN 'zone.armistice-entered' ELSE 'zone.armistice-left' END FROM e WHERE event_type = 'view')
SELECT CAST(user_id AS VARCHAR) AS source_id, r AS rule_id, CAST(count(*) AS BIGINT) AS records FROM x GROUP BY 1, 2""")
def dispatch_rules(spark, sf):
    hits = rules.dispatch(session_lines(spark, sf), rules.LIFECYCLE_RULES)
    return hits.groupBy("source_id", "rule_id").agg(F.count(F.lit(1)).alias("records"))


@query("extract_fields", f"""WITH {EV} SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS line_no,
CASE WHEN event_type = 'signup' THEN 'host' || k || '.example.invalid' END AS address,
CASE WHEN event_type = 'signup' THEN 64000 + k END AS port,
CASE WHEN event_type = 'error' THEN CAST(30000 + k AS VARCHAR) END AS cause,
CASE WHEN event_type = 'error' THEN 'why' || (k % 5) END AS reason,
CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(event_id AS VARCHAR) END AS notification_id FROM e""")
def extract_fields(spark, sf):
    t = F.col("text")
    return session_lines(spark, sf).select(
        "source_id", "line_no", bracket(t, "address").alias("address"), to_integer(bracket(t, "port")).alias("port"),
        F.when(F.contains(t, F.lit("cause")), keyed(t, "cause")).alias("cause"),
        F.when(F.contains(t, F.lit("reason")), keyed(t, "reason")).alias("reason"),
        notification(t)["id"].alias("notification_id"),
    )


def _captured(spark, sf):
    """Captured-signal markers of the reviewed 4.10 build."""
    e = events(spark, sf)
    k, ident, user = F.col("k"), F.col("event_id"), F.col("user_id")
    body = pick(
        signup=text("[Notice] <Add Inventory Management Move> Request[", k, "] Player[p", user, "] Type[Move] ItemClass[item_", k % 9, "]"),
        click=text("[Notice] <Inventory Mgmt Request Queued> Request[", k, "] Player[p", user, "] Type[Drop] action[",
                   F.when(k % 3 == 0, "Carry").otherwise("None"), "] amount[", k % 4, "]"),
        purchase=text("[Notice] <Player Inventory Request Complete> Request[", k, "] Type[Move] Result[",
                      F.when(k % 2 == 0, "succeed").otherwise("failed"), "] Elapsed[", k, ".25]"),
        view=text("[Notice] <CEntityComponentShopUIProvider::SendShopBuyRequest> shopName[Shop ", k % 6, "] client_price[", k,
                  "] itemName[item_", k % 9, "] quantity[", k % 3, "]"),
        error=text("[Error] <CSCLoadingPlatformManager::TransitionLightGroupState> light ", ident),
    )
    return as_lines(e, F.concat(stamp(), body))


_NOTE = """CASE event_type
 WHEN 'signup' THEN 'Inventory move requested: request ' || k || '; operation Move; item_' || (k % 9)
 WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'Item carry requested' ELSE 'Inventory request queued' END || ': request ' || k || '; operation Drop; requested/source quantity ' || (k % 4)
 WHEN 'purchase' THEN 'Player inventory request result: request ' || k || '; operation Move; reported result ' || CASE WHEN k % 2 = 0 THEN 'succeed' ELSE 'failed' END || '; ' || k || '.25 s'
 WHEN 'view' THEN 'Shop purchase requested: item_' || (k % 9) || '; requested/source quantity ' || (k % 3) || '; client price ' || k || ' (basis/currency unverified); shop Shop ' || (k % 6)
 ELSE 'Platform light-state activity' END"""


@query("captured_signals", f"""WITH {EV} SELECT event_id AS line_no, CASE event_type WHEN 'signup' THEN 'INV-06'
WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'INV-07' ELSE 'INV-02' END WHEN 'purchase' THEN 'INV-04' WHEN 'view' THEN 'SHP-01' ELSE 'DIA-03' END AS signal_id,
CASE event_type WHEN 'error' THEN 'diagnostic' ELSE 'action' END AS category, {_NOTE} AS summary
FROM e WHERE NOT (event_type = 'view' AND k % 3 = 0)""")
def captured_signals(spark, sf):
    from tracewright.plans.settle import fenced

    found = fenced(signals.captured_signals(_captured(spark, sf))).where(F.col("signal").isNotNull())
    return found.select("line_no", F.col("signal.signalId").alias("signal_id"), F.col("signal.category").alias("category"),
                        F.col("signal.summary").alias("summary"))


# --- contract ---------------------------------------------------------------------------------------------------------
def _typed(spark, sf):
    """Events with a payload that breaks the contract in known ways."""
    e = events(spark, sf)
    k = F.col("k")
    payload = pick(
        signup=_map(matchmakingRequestId=F.lit("r"), shard=F.when(k % 10 > 0, F.lit("s")), endpoint=F.lit("h"),
                    port=(k - 10) * 1000, locationId=F.lit("l")),
        click=_map(notificationId=F.col("event_id"), state=F.when(k % 4 == 0, "left").otherwise("entered")),
        view=_map(notificationId=F.col("event_id"), state=F.lit("left"), extra=F.lit("x")),
        purchase=_map(notificationId=F.col("event_id"), missionId=F.when(k % 3 > 0, F.lit("m"))),
        error=_map(cause=F.lit("c"), reason=F.lit("r"), isRemote=F.when(k % 2 == 0, "true").otherwise("maybe"),
                   endpoint=F.lit("h"), uptimeSeconds=F.col("value")),
    )
    return e.select(
        "event_id", type_name().alias("event_type"), payload.alias("payload"), F.lit("observed").alias("provenance"),
        F.when(k % 11 == 0, "certain").otherwise("high").alias("confidence"), F.array().cast("array<string>").alias("contributors"),
        "k", "env",
    )


def _map(**fields):
    return F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v.cast("string"))])


@query("required_fields", f"""WITH {EV} SELECT event_id, CASE WHEN event_type = 'signup' THEN 'shard' ELSE 'missionId,contractName' END AS missing
FROM e WHERE (event_type = 'signup' AND k % 10 = 0)
OR (event_type = 'purchase' AND k % 3 = 0)
UNION ALL SELECT event_id, 'contractName' FROM e WHERE event_type = 'purchase' AND k % 3 > 0""")
def required_fields(spark, sf):
    required = emission._by_type({r.event_type: list(r.required) for r in rules.LIFECYCLE_RULES if r.event_type})
    _, incomplete = contracts.require_fields(_typed(spark, sf).withColumn("required", required))
    return incomplete.select("event_id", F.array_join("missing", ",").alias("missing"))


@query("validate_events", f"""WITH {EV}, x AS (
SELECT event_id, 'invalid_enum:confidence' AS error FROM e WHERE k % 11 = 0
UNION ALL SELECT event_id, 'invalid_payload_string:payload.shard' FROM e WHERE event_type = 'signup' AND k % 10 = 0
UNION ALL SELECT event_id, 'payload_number_too_small:payload.port' FROM e WHERE event_type = 'signup' AND k <= 10
UNION ALL SELECT event_id, 'payload_number_too_large:payload.port' FROM e WHERE event_type = 'signup' AND k >= 76
UNION ALL SELECT event_id, 'invalid_payload_enum:payload.state' FROM e WHERE event_type = 'click' AND k % 4 = 0
UNION ALL SELECT event_id, 'unknown_payload_field:payload.extra' FROM e WHERE event_type = 'view'
UNION ALL SELECT event_id, 'missing_payload_field:payload.contractName' FROM e WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'invalid_payload_string:payload.missionId' FROM e WHERE event_type = 'purchase' AND k % 3 = 0
UNION ALL SELECT event_id, 'invalid_payload_boolean:payload.isRemote' FROM e WHERE event_type = 'error' AND k % 2 = 1
UNION ALL SELECT event_id, 'payload_number_too_small:payload.uptimeSeconds' FROM e WHERE event_type = 'error' AND value < 0)
SELECT event_id, string_agg(error, ',' ORDER BY error) AS errors FROM x GROUP BY 1""")
def validate_events(spark, sf):
    _, bad = contracts.validate_events(_typed(spark, sf))
    return bad.select("event_id", F.array_join("errors", ",").alias("errors"))


_RECORD = "user_id || '/' || (ms // 3600000)"


@query("match_conflicts", f"""WITH {EV}, g AS (SELECT user_id, ms // 3600000 AS hour, event_type, count(DISTINCT k % 3) AS n, count(*) AS matches, min(event_id) AS first_id
FROM e GROUP BY 1, 2, 3) SELECT user_id, hour, event_type, CAST(matches AS BIGINT) AS matches, CASE WHEN n > 1 THEN 'conflict' ELSE 'kept' END AS verdict,
CASE WHEN n > 1 THEN NULL ELSE first_id END AS rule_id FROM g""")
def match_conflicts(spark, sf):
    e = events(spark, sf).select(
        "user_id", F.expr("ms div 3600000").alias("hour"), "event_type", F.col("event_id").alias("rule_id"),
        _map(v=F.col("k") % 3).alias("payload"),
    )
    kept, conflicts = contracts.resolve_conflicts(e, ["user_id", "hour", "event_type"])
    counted = e.groupBy("user_id", "hour", "event_type").agg(F.count(F.lit(1)).alias("matches"))
    ok = kept.select("user_id", "hour", "event_type", F.lit("kept").alias("verdict"), "rule_id").join(
        counted, ["user_id", "hour", "event_type"]
    )
    bad = conflicts.withColumns({"verdict": F.lit("conflict"), "rule_id": F.lit(None).cast("bigint")})
    return ok.unionByName(bad)


def _framed(*parts: str) -> str:
    return " || '|' || ".join(f"strlen({p}) || ':' || {p}" for p in parts)


@query("event_ids", f"""WITH {EV}, s AS (SELECT event_id, env, event_type, CAST(ms AS VARCHAR) AS t, CAST(user_id AS VARCHAR) AS u FROM e)
SELECT event_id AS source_event, 'rte_v1_' || substr(sha256({_framed('env', 'event_type', 't', 'u')}), 1, 32) AS event_id,
'session_' || substr(sha256({_framed('env', "'session'", 'u')}), 1, 24) AS session_id FROM s""")
def event_ids(spark, sf):
    e = events(spark, sf)
    return e.select(
        F.col("event_id").alias("source_event"),
        event_id([F.col("env"), F.col("event_type"), F.col("ms"), F.col("user_id")]).alias("event_id"),
        scoped_id(F.col("env"), "session", [F.col("user_id")]).alias("session_id"),
    )


@query("order_keys", f"""WITH {EV} SELECT event_id, lpad(CAST(ms AS VARCHAR), 16, '0') || '::' || lpad(CAST(event_id AS VARCHAR), 16, '0') || '::' ||
lpad('0', 16, '0') || '::' || lpad(CAST(k AS VARCHAR), 16, '0') || '::' || event_id AS order_key FROM e""")
def order_keys(spark, sf):
    e = events(spark, sf)
    key = order_key(F.col("ms"), F.col("event_id"), F.lit(0), F.col("k"), F.col("event_id"))
    return e.select("event_id", key.alias("order_key"))


@query("correlation_map", f"""WITH {EV}, x AS (SELECT event_id, env, event_type, CAST(event_id AS VARCHAR) AS n, CAST(k AS VARCHAR) AS m FROM e)
SELECT event_id, 'notificationId' AS name, 'notification_' || substr(sha256({_framed('env', "'notification'", 'n')}), 1, 24) AS value FROM x WHERE event_type IN ('click', 'view', 'purchase')
UNION ALL SELECT event_id, 'matchmakingRequestId', 'matchmaking_request_' || substr(sha256({_framed('env', "'matchmaking_request'", "'r'")}), 1, 24) FROM x WHERE event_type = 'signup'""")
def correlation_map(spark, sf):
    t = _typed(spark, sf)
    ids = contracts.correlation_ids(F.col("env"), F.col("event_type"), F.col("payload"), F.lit("d"))
    rows = t.select("event_id", F.explode(ids).alias("name", "value"))
    return rows.where(F.col("name").isin("notificationId", "matchmakingRequestId"))


# --- bounded de-duplication -------------------------------------------------------------------------------------------
_FOLD = f"""WITH RECURSIVE {EV},
s AS (SELECT event_id, ms, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS n FROM e),
f AS (SELECT n, user_id, event_type, event_id, ms, ms AS kept, true AS keep FROM s WHERE n = 1
UNION ALL SELECT s.n, s.user_id, s.event_type, s.event_id, s.ms, CASE WHEN s.ms - f.kept > 21600000 THEN s.ms ELSE f.kept END, s.ms - f.kept > 21600000
FROM f JOIN s ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.n = f.n + 1)"""


@query("dedupe_bounded", f"{_FOLD} SELECT event_id, ms, user_id, event_type FROM f WHERE keep")
def dedupe_bounded(spark, sf):
    kept = dedupe.dedupe_bounded(events(spark, sf), ["user_id", "event_type"], "ms", "event_id", 6 * 3600_000)
    return kept.select("event_id", "ms", "user_id", "event_type")


@query("dedupe_decisions", f"""{_FOLD} SELECT event_type, CASE WHEN keep THEN 'emitted' ELSE 'suppressed_duplicate' END AS decision,
CAST(count(*) AS BIGINT) AS rows FROM f GROUP BY 1, 2""")
def dedupe_decisions(spark, sf):
    marked = dedupe.decide(events(spark, sf), ["user_id", "event_type"], "ms", "event_id", 6 * 3600_000)
    return dedupe.decision_counts(marked, ["event_type"])


# --- drift, anchors, health -------------------------------------------------------------------------------------------
@query("drift_suppression", f"""WITH {EV}, b AS (SELECT env, event_type, min(event_id) AS first_failure FROM e WHERE k = 7 AND event_type IN ('click', 'view') GROUP BY 1, 2)
SELECT env, event_type, CAST(count(*) FILTER (WHERE first_failure IS NULL OR event_id <= first_failure) AS BIGINT) AS evaluated,
CAST(count(*) FILTER (WHERE event_id > first_failure) AS BIGINT) AS suppressed FROM e LEFT JOIN b USING (env, event_type) GROUP BY 1, 2""")
def drift_suppression(spark, sf):
    e = events(spark, sf).select(
        "env", F.col("event_type").alias("family"), "event_id", F.col("event_type").isin("click", "view").alias("drift"),
        (F.col("k") == 7).alias("failed"),
    )
    ok, late = rules.suppress_drifted(e, ["env"], "event_id")
    both = ok.withColumn("_l", F.lit(0)).unionByName(late.withColumn("_l", F.lit(1)))
    return both.groupBy("env", F.col("family").alias("event_type")).agg(
        F.count_if(F.col("_l") == 0).alias("evaluated"), F.count_if(F.col("_l") == 1).alias("suppressed")
    )


@query("anchor_coverage", f"""WITH {EV}, a AS (SELECT user_id, bool_or(event_type IN ('click', 'view')) AS zone, bool_or(event_type = 'signup') AS pu,
bool_or(event_type = 'error') AS disc, bool_or(event_type = 'purchase') AS mission, bool_or(event_type IN ('click', 'view', 'purchase')) AS note FROM e GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS source_id, 'zone' AS family, '<SHUDEvent_OnNotification>' AS anchor, note AS seen FROM a WHERE zone
UNION ALL SELECT CAST(user_id AS VARCHAR), 'mission', '<SHUDEvent_OnNotification>', note FROM a WHERE mission
UNION ALL SELECT CAST(user_id AS VARCHAR), 'pu', '<Join PU>', pu FROM a WHERE pu
UNION ALL SELECT CAST(user_id AS VARCHAR), 'disconnect', '<Channel Disconnected>', disc FROM a WHERE disc""")
def anchor_coverage(spark, sf):
    return rules.anchor_coverage(session_lines(spark, sf), rules.LIFECYCLE_RULES, ["source_id"])


@query("parser_health", f"""WITH {EV}, g AS (SELECT user_id, count(*) AS records, count(*) FILTER (WHERE event_type IN ('error', 'view', 'click', 'signup') AND k > 3) AS unknown,
bool_or(event_type = 'purchase' AND k = 50) AS drifted, max(user_id % 4) AS m FROM e GROUP BY 1)
SELECT user_id, CAST(records AS BIGINT) AS records, CAST(unknown AS BIGINT) AS unknown,
CASE WHEN m = 1 THEN 'unverified_build' WHEN drifted OR (records >= 25 AND unknown >= 15 AND unknown / records >= 0.75) THEN 'suspected_drift' ELSE 'compatible' END AS status,
CASE WHEN m = 1 THEN 'build_not_tested' WHEN drifted THEN 'event_family_field_shape_changed' WHEN records >= 25 AND unknown >= 15 AND unknown / records >= 0.75 THEN 'high_unknown_ratio' ELSE 'profile_compatible' END AS reason,
round(unknown / records, 6) AS ratio FROM g""")
def parser_health(spark, sf):
    e = events(spark, sf)
    agg = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("event_type").isin("error", "view", "click", "signup") & (F.col("k") > 3)).alias("unknown"),
        F.max((F.col("event_type") == "purchase") & (F.col("k") == 50)).alias("drifted"),
    )
    compat = F.when(F.col("user_id") % 4 == 1, "unverified_build").otherwise("compatible")
    verdict = rules.health_verdict(F.col("records"), F.col("unknown"), compat, F.lit("build_not_tested"), F.col("drifted"))
    return agg.select("user_id", "records", "unknown", verdict.alias("v")).select("user_id", "records", "unknown", "v.*")


_CHECKS = sum(len(r.literals) for r in rules.LIFECYCLE_RULES)


@query("funnel", f"""WITH {EV} SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(count(*) AS BIGINT) AS records, CAST(count(*) * {_CHECKS} AS BIGINT) AS literal_checks,
CAST(count(*) AS BIGINT) AS evaluations, CAST(0 AS BIGINT) AS unknown_records FROM e GROUP BY 1""")
def funnel(spark, sf):
    return rules.funnel(session_lines(spark, sf), rules.LIFECYCLE_RULES, ["source_id"])


@query("result_words", f"""WITH {EV} SELECT env, CASE event_type WHEN 'signup' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'unknown' END AS outcome, CAST(count(*) AS BIGINT) AS rows FROM e GROUP BY 1, 2""")
def result_words(spark, sf):
    e = events(spark, sf).withColumn("outcome", outcome_kind(F.when(F.col("event_type") == "signup", "Succeed").otherwise(F.col("event_type"))))
    return e.groupBy("env", "outcome").agg(F.count(F.lit(1)).alias("rows"))




def _own_rule(name: str, jurisdiction: tuple[str, str]) -> rules.Rule:
    fields = (("notificationId", "bracket", "port"), ("jurisdiction", *jurisdiction))
    return rules.Rule(name, ("<Join PU>", "locationId["), "JurisdictionEntered", ("notificationId", "jurisdiction"), ("notificationId",), fields=fields)


@query("caller_rules", f"""WITH {EV} SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(event_id AS BIGINT) AS byte_offset,
CASE WHEN k % 7 = 3 THEN 'event' ELSE 'match_conflict' END AS code, 'JurisdictionEntered' AS detail FROM e WHERE event_type = 'signup'""")
def caller_rules(spark, sf):
    """A profile with two rules of its own that read join lines: where they differ a diagnostic, where they agree one event."""
    own = (_own_rule("own.shard", ("bracket", "shard")), _own_rule("own.constant", ("constant", "shard_3")))
    profiles = [replace(p, own=own) if p.profile_id == "sc-4.9-live" else p for p in rules.PROFILES]
    parsed = emission.parse_records(_records(spark, sf), spark, DEFAULTS, profiles=profiles)
    told = health.diagnostics_of(parsed).select("source_id", "byte_offset", "code", "detail")
    found = parsed.events.where("event_type = 'JurisdictionEntered'")
    return told.unionByName(found.select("source_id", "byte_offset", F.lit("event").alias("code"), F.col("event_type").alias("detail")))
