"""Queries, feeds, governance, ledger, catalogue and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.constants import ITEM_NAMES, ITEM_TYPES
from tracewright.functions.privacy import redact_endpoint, redact_id
from tracewright.operators import catalogue, feed, govern, ledger
from tracewright.plans.scans import top_n
from tracewright.sources import logs
from tracewright.workload.base import EV, as_lines, events, pick, query, stamp, table, text
from tracewright.workload.framing import _SPLIT, _documents
from tracewright.workload.state import TY, typed

# --- pages ------------------------------------------------------------------------------------------------------------
_OK = "lpad(CAST(ms AS VARCHAR), 16, '0')"


def _stored(spark, sf):
    e = events(spark, sf)
    return e.select(
        F.col("env").alias("environment_key"), "event_id", "event_type", F.col("ms").alias("ts_ms"), "user_id", "k",
        F.lpad(F.col("ms").cast("string"), 16, "0").alias("order_key"), text("s", F.col("user_id") % 5).alias("session_id"),
    )


_MID = 1705000000000


@query("query_page", f"""WITH {EV} SELECT event_id, {_OK} AS order_key FROM e WHERE env = 'env1' AND event_type IN ('click', 'view') AND ms >= {_MID} AND ms <= {_MID} + 864000000 ORDER BY order_key, event_id LIMIT 50""")
def query_page(spark, sf):
    return feed.query_events(_stored(spark, sf), "env1", types=("click", "view"), since_ms=_MID, until_ms=_MID + 864000000, limit=50).rows.select("event_id", "order_key")


@query("query_next_page", f"""WITH {EV}, p AS (SELECT event_id, {_OK} AS order_key FROM e WHERE env = 'env1' AND 's' || (user_id % 5) = 's2') SELECT event_id, order_key FROM p
WHERE (order_key, event_id) > ('{_MID:016d}', 0) ORDER BY order_key, event_id LIMIT 40""")
def query_next_page(spark, sf):
    return feed.query_events(_stored(spark, sf), "env1", session="s2", cursor=(f"{_MID:016d}", 0), limit=40).rows.select("event_id", "order_key")


@query("offset_page", f"""WITH {EV} SELECT event_id, k FROM e ORDER BY k DESC, event_id LIMIT 30 OFFSET 60""")
def offset_page(spark, sf):
    return feed.page(events(spark, sf), [F.desc("k"), F.asc("event_id")], 60, 30).select("event_id", "k")


@query("point_lookup", f"""WITH {EV} SELECT event_id, event_type FROM e WHERE env = 'env0' AND event_id = (SELECT max(event_id) FROM e WHERE env = 'env0')""")
def point_lookup(spark, sf):
    s = _stored(spark, sf)
    top = s.where(F.col("environment_key") == "env0").agg(F.max("event_id").alias("event_id"))
    return s.where(F.col("environment_key") == "env0").join(top, "event_id", "left_semi").select("event_id", "event_type")


@query("top_n", f"""WITH {EV} SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id) AS rank FROM e QUALIFY rank <= 3""")
def top_rows(spark, sf):
    out = top_n(events(spark, sf), ["user_id", "event_type"], [F.desc("ms")], 3, ["event_id"])
    return out.select("user_id", "event_type", "event_id", F.col("rank").cast("bigint").alias("rank"))


# --- stream -----------------------------------------------------------------------------------------------------------
def _stream(spark, sf):
    e = events(spark, sf)
    k = F.col("k")
    runtime = e.where(F.col("event_type") != "view").select(
        text("r", F.col("user_id"), "-", k).alias("event_id"), F.col("event_type").alias("kind"), F.when(k % 13 > 0, F.col("ms")).alias("ts_ms"),
        F.col("event_id").alias("line_no"), text("sum ", k).alias("summary"), text("h", k % 4).alias("host"), F.col("env").alias("environment_key"),
        F.when(k % 2 == 0, "high").otherwise("low").alias("confidence"),
    )
    shards = e.where(F.col("event_type") == "view").select(
        text("s", F.col("user_id"), "-", k).alias("event_id"), F.lit("shard").alias("kind"), F.col("ms").alias("ts_ms"), F.col("event_id").alias("line_no"),
        text("shard ", k).alias("summary"), text("sh", k % 5).alias("shard_id"), F.col("env").alias("environment_key"), F.lit("medium").alias("confidence"),
    )
    return feed.last_by_id(feed.stream_union(runtime, shards), "event_id", ["line_no"])


_STREAM = f"""{EV}, a AS (SELECT 'r' || user_id || '-' || k AS id, event_type AS kind, CASE WHEN k % 13 > 0 THEN ms END AS ts_ms, event_id AS line_no, 'sum ' || k AS summary, 'h' || (k % 4) AS host, NULL AS shard_id, env, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM e WHERE event_type <> 'view'
UNION ALL SELECT 's' || user_id || '-' || k, 'shard', ms, event_id, 'shard ' || k, NULL, 'sh' || (k % 5), env, 'medium' FROM e WHERE event_type = 'view'), st AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)"""


@query("stream_view", f"""WITH {_STREAM} SELECT id AS event_id, kind, ts_ms, line_no FROM st""")
def stream_view(spark, sf):
    return _stream(spark, sf).orderBy(*feed.stream_order()).select("event_id", "kind", "ts_ms", "line_no")


@query("stream_filter", f"""WITH {_STREAM} SELECT id AS event_id FROM st WHERE env = 'env2' AND kind IN ('click', 'shard', 'error') AND kind <> 'diagnostic' AND (lower(host) = 'h1' OR false) AND confidence = 'low' AND contains(lower(summary), 'um 1') AND ts_ms >= {_MID}""")
def stream_filter(spark, sf):
    q = feed.StreamQuery(environment="env2", kinds=("click", "shard", "error"), server="H1", confidence="LOW", diagnostics="hide", search=" um 1", since_ms=_MID)
    return feed.stream_filter(_stream(spark, sf), q).select("event_id")


@query("stream_window", f"""WITH {_STREAM}, n AS (SELECT *, row_number() OVER (ORDER BY ts_ms DESC NULLS LAST, line_no DESC, id) AS pos FROM st), anch AS (SELECT pos FROM n WHERE line_no = (SELECT min(line_no) FROM st WHERE kind = 'shard')),
c AS (SELECT count(*) AS total FROM st) SELECT id AS event_id FROM n, anch, c WHERE n.pos >= least(anch.pos, greatest(1, total - 80 + 1)) AND n.pos < least(anch.pos, greatest(1, total - 80 + 1)) + 80""")
def stream_window(spark, sf):
    s = _stream(spark, sf)
    anchor = s.where(F.col("kind") == "shard").orderBy("line_no").limit(1).collect()[0]["event_id"]
    return feed.stream_window(s, anchor, 80).select("event_id")


@query("unseen_count", f"""WITH {_STREAM} SELECT CAST(count(*) FILTER (WHERE line_no > (SELECT max(event_id) - 300 FROM e)) AS BIGINT) AS unseen FROM st""")
def unseen_count(spark, sf):
    s = _stream(spark, sf)
    top = events(spark, sf).agg(F.max("event_id")).first()[0] - 300
    return feed.unseen_count(s, s.where(F.col("line_no") <= top))


# --- classification and feed ------------------------------------------------------------------------------------------
_ITEMS = list(ITEM_NAMES)
_SIGNALS = ["INV-04", "INV-05", "INV-06", "INV-07", "INV-09", "INV-13", "INV-14", "INV-15", "SHP-01", "SHP-02", "DIA-01"]


def _rows(spark, sf):
    t = typed(spark, sf).join(events(spark, sf).select("event_id", "k"), "event_id")
    k = F.col("k")
    captured = k % 2 == 0
    sig = F.element_at(F.array(*[F.lit(s) for s in _SIGNALS]), (k % 11 + 1).cast("int"))
    item = F.element_at(F.array(*[F.lit(s) for s in [*_ITEMS, "mystery"]]), (k % 21 + 1).cast("int"))
    return t.select(
        "environment_key", "event_id", "ts_ms", "order_key", "payload", "k",
        F.when(captured, "RuntimeLogSignalObserved").otherwise(F.col("event_type")).alias("event_type"),
        F.when(captured, sig).alias("signal"), F.when(captured & (k % 3 > 0), item).alias("item"),
        F.when(k % 4 == 0, "transfer").when(k % 4 == 2, "ground_drop").alias("movement"),
        F.when(k % 5 == 0, "QueryInventory").otherwise("Move").alias("operation"),
        F.when(k % 6 == 0, "Close Inventory Grid").otherwise("Player Inventory Request Complete").alias("marker"),
        F.when(k % 7 == 0, "failed").when(k % 7 == 1, "odd").otherwise("succeed").alias("result"), (k % 3).alias("quantity"),
    )


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_ROWS = f"""{TY}, w AS (SELECT t.environment_key, e.event_id, t.ms, e.k, t.h, CASE WHEN k % 2 = 0 THEN 'RuntimeLogSignalObserved' ELSE t.kind END AS kind, CASE WHEN k % 2 = 0 THEN ({_sql_list(_SIGNALS)})[k % 11 + 1] END AS sig,
CASE WHEN k % 2 = 0 AND k % 3 > 0 THEN ({_sql_list([*_ITEMS, 'mystery'])})[k % 21 + 1] END AS item, CASE k % 4 WHEN 0 THEN 'transfer' WHEN 2 THEN 'ground_drop' END AS mv, k % 5 = 0 AS qi, k % 6 = 0 AS cg FROM t JOIN e ON e.event_id = t.o),
cl AS (SELECT *, CASE WHEN sig IN ('SHP-01', 'SHP-02') THEN 'shop' WHEN sig IN ('INV-13', 'INV-14', 'INV-15') THEN 'equipment' WHEN sig IS NOT NULL THEN 'inventory' WHEN kind LIKE 'Vehicle%' THEN 'vehicle' WHEN kind LIKE 'Quantum%' THEN 'travel' WHEN kind LIKE 'Party%' THEN 'party'
 WHEN kind IN ('JurisdictionEntered', 'MonitoredSpaceEntered', 'MonitoredSpaceExited', 'ArmisticeStateChanged') THEN 'area' ELSE 'inventory' END AS category,
 CASE WHEN sig IN ('SHP-01', 'SHP-02') THEN 'purchase' WHEN sig IN ('INV-13', 'INV-14', 'INV-15') THEN 'attachment' WHEN sig = 'INV-05' THEN 'drop' WHEN sig = 'INV-06' THEN 'move' WHEN sig = 'INV-07' THEN 'carry' WHEN sig = 'INV-09' THEN 'close'
 WHEN sig = 'INV-04' AND mv = 'ground_drop' THEN 'drop' WHEN sig = 'INV-04' AND mv = 'transfer' THEN 'move' WHEN sig IS NOT NULL THEN 'inventory_result' WHEN kind = 'VehicleRetrieved' THEN 'retrieve' WHEN kind = 'VehicleStored' THEN 'store' WHEN kind LIKE 'Vehicle%' THEN 'control'
 WHEN kind = 'QuantumTravelArrived' THEN 'arrival' WHEN kind LIKE 'Quantum%' THEN 'destination' WHEN kind = 'PartyLaunchInitiated' THEN 'launch' WHEN kind LIKE 'Party%' THEN 'membership'
 WHEN kind IN ('JurisdictionEntered', 'MonitoredSpaceEntered', 'MonitoredSpaceExited', 'ArmisticeStateChanged') THEN 'area_change' ELSE 'inventory_result' END AS action,
 CASE WHEN item IS NULL THEN 'no_item' ELSE coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in ITEM_TYPES.items())}}}[item], 'unclassified') END AS item_type,
 CASE WHEN kind = 'RuntimeLogSignalObserved' THEN CASE WHEN sig = 'DIA-01' THEN false WHEN sig = 'INV-04' THEN NOT cg AND NOT qi WHEN sig = 'INV-09' THEN cg ELSE true END
  ELSE kind LIKE 'Party%' OR kind LIKE 'Vehicle%' OR kind LIKE 'Quantum%' OR kind IN ('JurisdictionEntered', 'MonitoredSpaceEntered', 'MonitoredSpaceExited', 'ArmisticeStateChanged') END AS eligible FROM w)"""


def _classified(spark, sf):
    r = _rows(spark, sf)
    c = feed.classify(F.col("event_type"), F.col("signal"), F.col("item"), F.col("movement"))
    ok = feed.gameplay_eligible(F.col("event_type"), F.col("signal"), F.col("operation"), F.col("marker"))
    return r.withColumns({"c": c, "eligible": ok})


@query("classify_rows", f"WITH {_ROWS} SELECT event_id, category, action, item_type FROM cl")
def classify_rows(spark, sf):
    return _classified(spark, sf).select("event_id", "c.category", "c.action", "c.item_type")


@query("gameplay_eligible", f"WITH {_ROWS} SELECT category, eligible, CAST(count(*) AS BIGINT) AS rows FROM cl GROUP BY 1, 2")
def gameplay_eligible(spark, sf):
    return _classified(spark, sf).groupBy(F.col("c.category").alias("category"), "eligible").agg(F.count(F.lit(1)).alias("rows"))


@query("activity_feed", f"""WITH {_ROWS}, r AS (SELECT * FROM cl WHERE eligible AND ms >= {_MID} QUALIFY row_number() OVER (PARTITION BY environment_key ORDER BY event_id DESC) <= 160)
SELECT environment_key, event_id, row_number() OVER (PARTITION BY environment_key ORDER BY event_id DESC) AS rank FROM r WHERE category IN ('inventory', 'shop', 'vehicle') AND item_type <> 'drink' QUALIFY rank <= 80""")
def activity_feed(spark, sf):
    keep = feed.classification_filter(
        F.col("c"), categories=("inventory", "shop", "vehicle"), item_types=("medical", "ammunition", "equipment", "unclassified", "no_item")
    )
    out = feed.activity_feed(_classified(spark, sf), _MID, keep=keep)
    return out.select("environment_key", "event_id", F.col("rank").cast("bigint").alias("rank"))


_NAMES1 = "map {" + ", ".join(f"'{k}': '{v[0]}'" for k, v in ITEM_NAMES.items()) + "}"
_NAMES2 = "map {" + ", ".join(f"'{k}': '{v[1]}'" for k, v in ITEM_NAMES.items()) + "}"


@query("render_messages", f"""WITH {_ROWS}, n AS (SELECT *, k % 3 AS q, CASE k % 7 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Response' ELSE 'Succeeded' END AS oc, coalesce({_NAMES1}[item], item, 'item') AS one, coalesce(CASE WHEN k % 3 = 1 THEN {_NAMES1}[item] ELSE {_NAMES2}[item] END, item, 'item') AS many FROM cl WHERE sig IS NOT NULL)
SELECT event_id, CASE sig WHEN 'SHP-01' THEN q || '× ' || many || ' purchase requested' WHEN 'SHP-02' THEN CASE oc WHEN 'Failed' THEN 'Shop reported purchase failure' WHEN 'Response' THEN 'Shop response received' ELSE 'Shop reported purchase success' END
WHEN 'INV-04' THEN CASE WHEN item IS NULL THEN CASE oc WHEN 'Failed' THEN 'Inventory action failed (item unknown)' WHEN 'Response' THEN 'Inventory response received (item unknown)' ELSE 'Inventory action completed (item unknown)' END
 ELSE CASE oc WHEN 'Failed' THEN 'Inventory update failed: ' WHEN 'Response' THEN 'Inventory response received: ' ELSE 'Inventory update completed: ' END || CASE WHEN q > 0 THEN q || '× ' || many ELSE one END END
WHEN 'INV-05' THEN 'Item drop requested' WHEN 'INV-06' THEN one || ' move requested' WHEN 'INV-07' THEN 'Item carry requested' WHEN 'INV-09' THEN 'Closing inventory' WHEN 'INV-13' THEN 'Holding ' || one || ' in left hand' WHEN 'INV-14' THEN one || ' attached to helmet hook'
WHEN 'INV-15' THEN 'Holding ' || one || ' in right hand' ELSE 'label' END AS message FROM n""")
def render_messages(spark, sf):
    r = _rows(spark, sf).where(F.col("signal").isNotNull())
    m = feed.signal_message(F.col("signal"), F.col("item"), F.col("quantity"), F.col("result"), F.lit("label"))
    return r.select("event_id", m.alias("message"))


@query("event_text", f"""WITH {_ROWS} SELECT event_id, CASE WHEN kind LIKE 'Party%' THEN 'party' WHEN kind LIKE 'Quantum%' THEN 'navigation' WHEN kind LIKE 'Vehicle%' THEN 'vehicle' WHEN kind IN ('JurisdictionEntered', 'MonitoredSpaceEntered', 'MonitoredSpaceExited', 'ArmisticeStateChanged') THEN 'zone' ELSE 'runtime' END AS category,
CASE kind WHEN 'PartyCreated' THEN 'Party created by L' || (h % 3) WHEN 'PartyLaunchInitiated' THEN 'null' WHEN 'PartyMemberConnected' THEN 'm' || (h % 4) || ' connected' WHEN 'PartyMemberJoined' THEN 'm' || (h % 4) || ' joined the party' WHEN 'PartyLeft' THEN 'Left party'
WHEN 'JurisdictionEntered' THEN 'Entered j' || (h % 4) WHEN 'MonitoredSpaceEntered' THEN 'Entered monitored space' WHEN 'MonitoredSpaceExited' THEN 'Exited monitored space' WHEN 'ArmisticeStateChanged' THEN CASE WHEN h % 2 = 0 THEN 'Entered' ELSE 'Left' END || ' armistice zone'
WHEN 'QuantumTargetSelected' THEN 'Selected quantum target t' || (h % 6) WHEN 'QuantumTargetChanged' THEN 'Changed quantum target to t' || (h % 6) WHEN 'QuantumTravelArrived' THEN 'Arrived at t' || (h % 6) WHEN 'VehicleRetrieved' THEN 'Retrieved null' WHEN 'VehicleControlAcquired' THEN 'Controlling null'
WHEN 'VehicleControlReleased' THEN 'Released control of null' WHEN 'VehicleStored' THEN 'Stored null' ELSE kind END AS summary FROM w WHERE kind <> 'RuntimeLogSignalObserved'""")
def event_text(spark, sf):
    r = _rows(spark, sf).where(F.col("event_type") != "RuntimeLogSignalObserved")
    t = F.col("event_type")
    return r.select("event_id", feed.event_category(t).alias("category"), feed.event_summary(t, F.col("payload")).alias("summary"))


# --- governance -------------------------------------------------------------------------------------------------------
_EDGE = "(^|[^A-Za-z0-9_])"


@query("redact_text", f"""WITH {EV}, s AS (SELECT event_id, k, user_id FROM e) SELECT event_id, 'note token=[REDACTED_SECRET] handle=[REDACTED_HANDLE]' || ' at [REDACTED_ENDPOINT] path [REDACTED_PATH] geid=[REDACTED_ID] end' AS snippet, 'endpoint,handle,identifier,path,secret' AS kinds, 'secret' AS sensitivity FROM s WHERE k % 2 = 0
UNION ALL SELECT event_id, 'plain words ' || k || ' and more', '', 'local' FROM s WHERE k % 2 = 1""")
def redact_text(spark, sf):
    e = events(spark, sf)
    k = F.col("k")
    body = F.when(
        k % 2 == 0, text("note token: t", k, "\n handle=h", F.col("user_id"), " at 10.1.", k, ".7:80 path /home/u", k, "/x geid=", k, " end")
    ).otherwise(text("plain words ", k, " and more"))
    out = govern.redact(e.select("event_id", body.alias("text")), "text")
    return out.select("event_id", "snippet", F.array_join("kinds", ",").alias("kinds"), "sensitivity")


def _re2(pattern):
    """A scan pattern without look-around: word edges as ``\\b``."""
    return pattern.replace("(?<!\\w)", "\\b").replace("(?!\\w)", "\\b").replace("'", "''")


def _privacy_sql(name):
    from tracewright.constants import PRIVACY_PATTERNS

    col, key = ("text", "lang") if name == "documents" else ("text", "role")
    return " UNION ALL ".join(
        f"SELECT {key}, '{n}' AS pattern, CAST(count(*) AS BIGINT) AS rows FROM {name} WHERE regexp_matches({col}, '{_re2(p)}') GROUP BY 1"
        for n, p in PRIVACY_PATTERNS
    )


@query("privacy_scan", _privacy_sql("documents"))
def privacy_scan(spark, sf):
    return govern.privacy_scan(table(spark, sf, "documents"), "text", ["lang"])


@query("privacy_scan_turns", _privacy_sql("conversations"))
def privacy_scan_turns(spark, sf):
    return govern.privacy_scan(table(spark, sf, "conversations"), "text", ["role"])


@query("sensitivity", f"""SELECT lang, CASE WHEN regexp_matches(text, '(?i)\\b(authorization|auth|token|secret|password|apikey)\\b') THEN 'secret' WHEN regexp_matches(text, '(?i)\\b(handle|nickname|leader|member)\\b\\s*[:=\\[]') THEN 'social'
WHEN regexp_matches(text, '(?i)\\b(accountId|playerGEID|characterGEID|geid|node_id|session|sessionId|loginSessionId)\\b\\s*[:=\\[]') THEN 'personal' ELSE 'local' END AS sensitivity, CAST(count(*) AS BIGINT) AS rows FROM documents GROUP BY 1, 2""")
def sensitivity(spark, sf):
    from tracewright.functions.privacy import infer_sensitivity

    d = table(spark, sf, "documents")
    return d.groupBy("lang", infer_sensitivity(F.col("text")).alias("sensitivity")).agg(F.count(F.lit(1)).alias("rows"))


@query("redact_ids", """WITH s AS (SELECT s_suppkey, s_name, '10.' || (s_suppkey % 250) || '.3.4' AS ip, 'host' || s_suppkey || '.example.invalid' AS host FROM supplier)
SELECT s_suppkey, substr(s_name, 1, 2) || '…' || right(s_name, 2) AS name, '10.' || (s_suppkey % 250) || '.*.*' AS ip, 'ho…' || right('host' || s_suppkey, 2) || '.example.invalid' AS host FROM s""")
def redact_ids(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    return s.select("s_suppkey", redact_id(F.col("s_name")).alias("name"), redact_endpoint(text("10.", key % 250, ".3.4")).alias("ip"),
                    redact_endpoint(text("host", key, ".example.invalid")).alias("host"))


@query("public_view", f"""WITH {TY} SELECT environment_key, '••' AS endpoint, arg_max(kind, o) AS kind FROM t WHERE kind = 'PuJoinRequested' GROUP BY 1""")
def public_view(spark, sf):
    from tracewright.operators import projections

    e = typed(spark, sf).where(F.col("event_type") == "PuJoinRequested")
    facts = {"endpoint": (F.try_element_at(F.col("payload"), F.lit("endpoint")), F.lit(True)), "kind": (F.col("event_type"), F.lit(True))}
    return govern.public_view(projections.latest_facts(e, facts, "order_key"), ids=["endpoint"])


@query("evidence_masking", f"""WITH {EV} SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'redacted=true' ELSE 'note=at [redacted];userId=[redacted]' END AS payload, CASE WHEN event_type IN ('signup', 'purchase') THEN 'redacted' ELSE 'available' END AS availability FROM e""")
def evidence_masking(spark, sf):
    e = events(spark, sf)
    t = F.col("event_type")
    rows = e.select("event_id", F.when(t == "signup", "personal").when(t == "purchase", "social").otherwise("local").alias("sensitivity"),
                    F.create_map(F.lit("note"), text("at 10.0.0.", F.col("k")), F.lit("userId"), F.col("user_id").cast("string")).alias("payload"))
    out = govern.evidence_detail(rows)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return out.select("event_id", flat.alias("payload"), "availability")


@query("sanitize_report", f"""WITH {EV}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE k % 2 = 0) AS m FROM e) SELECT 'stable_identifier' AS category, CAST(n AS BIGINT) AS rows FROM c UNION ALL SELECT 'network_address', CAST(n AS BIGINT) FROM c UNION ALL SELECT 'credential', CAST(m AS BIGINT) FROM c""")
def sanitize_report(spark, sf):
    one = F.lit("x")
    base = [F.lit("userId"), one, F.lit("note"), one, F.lit("endpoint"), one]
    m = F.when(F.col("k") % 2 == 0, F.create_map(*base, F.lit("token"), one)).otherwise(F.create_map(*base))
    return govern.sanitize_report(events(spark, sf).select(m.alias("m")), "m")


@query("retention", f"""WITH {EV} SELECT env, CAST(count(*) AS BIGINT) AS rows, min(ms) AS oldest FROM e WHERE ms >= 1706659200000 - 10 * 86400000 OR env <> 'env1' GROUP BY 1""")
def retention(spark, sf):
    e = events(spark, sf).withColumns({"environment_key": F.col("env"), "ingested_ms": F.col("ms")})
    kept = govern.apply_retention(e, 1706659200000, 10, "env1")
    return kept.groupBy("env").agg(F.count(F.lit(1)).alias("rows"), F.min("ms").alias("oldest"))


@query("scoped_delete", f"""WITH {EV} SELECT event_id, env FROM e WHERE NOT (env = 'env2' AND event_type IN ('signup', 'purchase'))""")
def scoped_delete(spark, sf):
    t = F.col("event_type")
    e = events(spark, sf).withColumns({"environment_key": F.col("env"), "sensitivity": F.when(t == "signup", "personal").when(t == "purchase", "secret").otherwise("local")})
    return govern.delete_scope(e, "env2", sensitive_only=True).select("event_id", "env")


# --- ledger -----------------------------------------------------------------------------------------------------------
def _changes(spark, sf):
    li = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_suppkey").alias("context"), F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("item_id"), F.lit("r1").alias("rule"),
        F.when(flag == "R", "loss").otherwise("acquire").alias("kind"), F.when(F.col("l_linestatus") == "O", "high").otherwise("confirmed").alias("confidence"),
        F.when(F.col("l_linenumber") == 7, "extracted").otherwise("observed").alias("provenance"), F.lit("items").alias("unit"),
        F.col("l_quantity").alias("quantity"),
    )


@query("qualified_changes", """WITH q AS (SELECT l_suppkey, l_orderkey, count(DISTINCT (l_partkey, l_returnflag = 'R', l_quantity)) AS variants, count(*) AS offers FROM lineitem WHERE l_linenumber <> 7 AND l_quantity > 0 GROUP BY 1, 2),
u AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_linenumber = 7)
SELECT 'accepted' AS verdict, CAST(count(*) AS BIGINT) AS ids, CAST(sum(offers) AS BIGINT) AS offers FROM q WHERE variants = 1 UNION ALL SELECT 'conflicting_content', CAST(count(*) AS BIGINT), NULL FROM q WHERE variants > 1 UNION ALL SELECT 'not_qualified', CAST(count(*) AS BIGINT), NULL FROM u""")
def qualified_changes(spark, sf):
    ok, bad = ledger.qualified_changes(_changes(spark, sf), ["context"], ["event", "rule"], ["item_id", "kind", "quantity"])
    a = ok.agg(F.lit("accepted").alias("verdict"), F.count(F.lit(1)).alias("ids"), F.sum("offers").alias("offers"))
    b = bad.groupBy(F.col("reason").alias("verdict")).agg(F.count(F.lit(1)).alias("ids"), F.lit(None).cast("bigint").alias("offers"))
    return a.unionByName(b)


@query("snapshot_consistency", """WITH p AS (SELECT l_orderkey, l_linenumber AS page, l_partkey % 50 AS id, l_suppkey % 40 = 0 AS odd, l_linestatus = 'O' AS done FROM lineitem), u AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (WHERE n > 1) AS duplicates FROM (SELECT l_orderkey, id, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT l_orderkey, count(DISTINCT odd) AS revs, max(page) AS last, min(page) FILTER (WHERE done) AS closed FROM p GROUP BY 1)
SELECT l_orderkey, CAST(items AS BIGINT) AS items, CAST(duplicates AS BIGINT) AS duplicates, CASE WHEN revs > 1 THEN 'changed_during_pagination' WHEN duplicates > 0 THEN 'duplicate_ids' WHEN closed IS NULL OR closed <> last THEN 'not_closed' ELSE 'consistent' END AS status FROM a JOIN u USING (l_orderkey)""")
def snapshot_consistency(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 50).alias("id"), (F.col("l_suppkey") % 40 == 0).alias("revision"),
        (F.col("l_linestatus") == "O").alias("complete"),
    )
    return ledger.snapshot_consistency(li, ["l_orderkey"], ["revision"], "id", "page", "complete")


@query("ledger_apply", """WITH i AS (SELECT p_partkey // 2 * 2 AS item_id, p_size AS q, CASE WHEN p_size % 9 = 0 THEN 'kg' ELSE 'items' END AS unit FROM part WHERE p_partkey % 5 > 0), h AS (SELECT item_id, count(*) AS n, min(q) AS q, min(unit) AS unit FROM i GROUP BY 1),
c AS (SELECT DISTINCT p_partkey AS item_id FROM part WHERE p_size > 20), x AS (SELECT l_partkey AS item_id, CASE WHEN l_returnflag = 'R' THEN 'loss' ELSE 'acquire' END AS kind, l_quantity AS quantity FROM lineitem),
s AS (SELECT x.*, coalesce(h.q, 0) AS b, coalesce(h.q, 0) + CASE WHEN kind = 'acquire' THEN quantity ELSE -quantity END AS a, CASE WHEN coalesce(n, 0) > 1 THEN 'ambiguous_mapping' WHEN coalesce(n, 0) = 0 AND NOT (kind = 'acquire' AND c.item_id IS NOT NULL) THEN 'no_mapping' WHEN n = 1 AND unit <> 'items' THEN 'unit_mismatch' END AS st
FROM x LEFT JOIN h USING (item_id) LEFT JOIN c USING (item_id)), f AS (SELECT kind, coalesce(st, CASE WHEN a < 0 THEN 'negative_balance' ELSE 'applicable' END) AS status, a, b FROM s)
SELECT kind, status, CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN status = 'applicable' THEN b END) AS BIGINT) AS before_sum, CAST(sum(CASE WHEN status = 'applicable' THEN a END) AS BIGINT) AS after_sum FROM f GROUP BY 1, 2""")
def ledger_apply(spark, sf):
    p = table(spark, sf, "part")
    inventory = p.where(F.col("p_partkey") % 5 > 0).select(
        F.expr("p_partkey div 2 * 2").alias("item_id"), F.col("p_size").alias("quantity"), F.when(F.col("p_size") % 9 == 0, "kg").otherwise("items").alias("unit")
    )
    known = p.where(F.col("p_size") > 20).select(F.col("p_partkey").alias("item_id"), F.lit("exact").alias("status"))
    out = ledger.apply_changes(_changes(spark, sf).select("item_id", "kind", "quantity", "unit"), inventory, known)
    return out.groupBy("kind", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("before").cast("bigint").alias("before_sum"), F.sum("after").cast("bigint").alias("after_sum")
    )


@query("operation_status", """SELECT CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'O' THEN 'unknown' WHEN 'P' THEN 'conflict' END AS status, CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY 1""")
def operation_status(spark, sf):
    s = F.col("o_orderstatus")
    said = F.when(s == "F", "duplicate").when(s == "O", "pending").otherwise("conflict")
    return table(spark, sf, "orders").groupBy(ledger.operation_status(said).alias("status")).agg(F.count(F.lit(1)).alias("rows"))


# --- catalogue --------------------------------------------------------------------------------------------------------
def _blueprints(spark, sf):
    e = events(spark, sf)
    k = F.col("k")
    body = pick(
        purchase=text('[Notice] <SHUDEvent_OnNotification> Added notification "Received Blueprint: ', F.when(k % 2 == 0, "Name  ").otherwise("NAME "), k % 30, ': " [', F.col("event_id"), "] to queue."),
        view=text('[Notice] <SHUDEvent_OnNotification> Added notification "Other: ', k, '" [', F.col("event_id"), "] to queue."),
        signup=text("Build(", k, ")"), click=F.lit("noise"), error=F.lit("noise"),
    )
    lines = as_lines(e, F.concat(stamp(), body))
    builds = F.array(*[F.lit(b) for b in ("11518367", "12344265", "12519617", "9999")])
    files = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("user_id").cast("string").alias("source_id"), F.col("user_id").alias("rank"), F.element_at(builds, (F.col("user_id") % 4 + 1).cast("int")).alias("build")
    )
    return lines, files, catalogue.blueprint_profiles(spark)


_BP = f"""{EV}, o AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'Name ' ELSE 'NAME ' END || (k % 30) AS name, CASE user_id % 4 WHEN 0 THEN '11518367' WHEN 1 THEN '12344265' WHEN 2 THEN '12519617' ELSE '9999' END AS build FROM e)"""


@query("blueprint_catalogue", f"""WITH {_BP} SELECT lower(name) AS name_key, arg_min(name, (user_id, event_id)) AS name, CAST(arg_min(user_id, (user_id, event_id)) AS VARCHAR) AS source_id, arg_min(event_id, (user_id, event_id)) AS line_no, arg_min(build, (user_id, event_id)) AS build,
CAST(count(*) - 1 AS BIGINT) AS duplicates FROM o WHERE event_type = 'purchase' AND build <> '9999' GROUP BY 1""")
def blueprint_catalogue(spark, sf):
    out = catalogue.blueprint_catalogue(catalogue.blueprint_observations(*_blueprints(spark, sf)))
    return out.select("name_key", "name", "source_id", "line_no", "build", "duplicates")


@query("scan_report", f"""WITH {_BP} SELECT CAST(user_id AS VARCHAR) AS source_id, build, CASE WHEN build = '9999' THEN 'unsupported' ELSE 'ready' END AS status, CAST(CASE WHEN build = '9999' THEN 0 ELSE count(*) END AS BIGINT) AS lines,
CAST(CASE WHEN build = '9999' THEN 0 ELSE count(*) FILTER (WHERE event_type = 'purchase') END AS BIGINT) AS recognized, CAST(CASE WHEN build = '9999' THEN 0 ELSE count(*) FILTER (WHERE event_type = 'view') END AS BIGINT) AS unrecognized FROM o GROUP BY 1, 2""")
def scan_report(spark, sf):
    return catalogue.scan_report(*_blueprints(spark, sf))


@query("catalogue_contract", """WITH d AS (SELECT lower(p_name) AS nk, count(*) AS n, min(p_name) AS name FROM part GROUP BY 1) SELECT name, 'duplicate_name' AS reason FROM d WHERE n > 1 UNION ALL SELECT p_name, 'invalid_type' FROM part WHERE p_size = 1""")
def catalogue_contract(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.when(F.col("p_size") != 1, F.col("p_type")).alias("type"), F.lit(None).cast("boolean").alias("shared")
    )
    return catalogue.validate_catalogue(p.withColumn("name_key", catalogue.name_key(F.col("name"))))


# --- sources ----------------------------------------------------------------------------------------------------------
_DOC = {"question": r"\?", "digit": r"\d", "quote": "\"", "the": r"(?i)(?<!\w)the(?!\w)"}


@query("source_profile", f"""WITH {_SPLIT}, s AS (SELECT * FROM o WHERE part <> ''),
m AS (SELECT doc_id, bool_or(regexp_matches(part, '\\?')) AS a, bool_or(regexp_matches(part, '\\d')) AS b, bool_or(regexp_matches(part, '"')) AS c, bool_or(regexp_matches(part, '(?i)\\bthe\\b')) AS d FROM s GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS source_id, concat_ws(',', CASE WHEN a THEN 'question' END, CASE WHEN b THEN 'digit' END, CASE WHEN c THEN 'quote' END, CASE WHEN d THEN 'the' END) AS markers FROM m""")
def source_profile(spark, sf):
    from tracewright.operators import framing

    lines = framing.frame_lines(_documents(spark, sf), emit_incomplete=True)
    prof = logs.profile_sources(framing.drop_empty(lines), _DOC)
    return prof.select("source_id", F.array_join("markers", ",").alias("markers"))


def _sources(spark, sf):
    d = table(spark, sf, "documents")
    key = F.col("doc_id")
    channel = F.element_at(F.array(*[F.lit(c) for c in ("LIVE", "PTU", "NIGHTLY", "EPTU")]), (key % 4 + 1).cast("int"))
    prof = d.select(
        key.cast("string").alias("source_id"), "source", F.when(key % 7 > 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("markers"),
        F.when(key % 9 > 0, channel).alias("raw_channel"), (key % 11 == 0).alias("channel_conflict"),
        F.when(key % 5 == 0, "restored_setting").when(key % 5 == 1, "user_selected").otherwise("automatic").alias("method"), (key % 6).alias("discovery_order"),
    )
    return logs.validate_sources(prof)


_SRC = """s AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN 'LIVE' WHEN 1 THEN 'PTU' WHEN 2 THEN 'NIGHTLY' ELSE 'EPTU' END AS ch, doc_id % 9 > 0 AS has FROM documents),
v AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'environment_mismatch' WHEN doc_id % 7 = 0 THEN 'invalid_log' WHEN has AND ch = 'NIGHTLY' THEN 'unsupported_channel' ELSE 'valid' END AS status FROM s)"""


@query("source_validation", f"""WITH {_SRC} SELECT source, status, CAST(count(*) AS BIGINT) AS sources FROM v GROUP BY 1, 2""")
def source_validation(spark, sf):
    return _sources(spark, sf).groupBy("source", "status").agg(F.count(F.lit(1)).alias("sources"))


@query("source_rank", f"""WITH {_SRC} SELECT CAST(doc_id AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY source ORDER BY status = 'valid' DESC, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, doc_id % 6, CASE WHEN NOT has THEN 99 WHEN ch = 'LIVE' THEN 0 WHEN ch = 'PTU' THEN 1 WHEN ch = 'EPTU' THEN 2 ELSE 99 END, CAST(doc_id AS VARCHAR)) AS rank FROM v""")
def source_rank(spark, sf):
    return logs.rank_sources(_sources(spark, sf), ["source"]).select("source_id", F.col("rank").cast("bigint").alias("rank"))


@query("source_lifecycle", f"""WITH {_SRC}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY status = 'valid' DESC, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, doc_id % 6, CASE WHEN NOT has THEN 99 WHEN ch = 'LIVE' THEN 0 WHEN ch = 'PTU' THEN 1 WHEN ch = 'EPTU' THEN 2 ELSE 99 END, CAST(doc_id AS VARCHAR)) AS rank FROM v)
SELECT 'RuntimeSourceDiscovered' AS event_type, CAST(count(*) AS BIGINT) AS rows FROM r UNION ALL SELECT 'RuntimeSourceSelected', CAST(count(*) AS BIGINT) FROM r WHERE rank = 1 AND status = 'valid' UNION ALL SELECT 'RuntimeSourceUnavailable', CAST(count(*) AS BIGINT) FROM r WHERE status = 'unsupported_channel'""")
def source_lifecycle(spark, sf):
    out = logs.source_lifecycle_events(logs.rank_sources(_sources(spark, sf), ["source"]))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


def _files(spark, sf):
    d = table(spark, sf, "documents")
    key = F.col("doc_id")
    name = F.when(key % 10 == 0, "game.log").when(key % 10 == 1, text("junk", key, ".txt")).otherwise(
        text("Game Build(", key + 11000000, ") 0", key % 9 + 1, " Jan 24 (10 0", key % 6, " 00).log")
    )
    return logs.log_catalogue(
        d.select("source", name.alias("file_name"), F.when(key % 10 == 0, "current").otherwise("backup").alias("kind"), F.col("n_chars").alias("size"), (key * 1000).alias("modified_ms"))
    )


_FILES = """f AS (SELECT doc_id, source, CASE doc_id % 10 WHEN 0 THEN 'game.log' WHEN 1 THEN 'junk' || doc_id || '.txt' ELSE 'Game Build(' || (doc_id + 11000000) || ') 0' || (doc_id % 9 + 1) || ' Jan 24 (10 0' || (doc_id % 6) || ' 00).log' END AS file_name, CASE WHEN doc_id % 10 = 0 THEN 'current' ELSE 'backup' END AS kind, n_chars AS size, doc_id * 1000 AS modified_ms FROM documents)"""


@query("log_catalogue", f"""WITH {_FILES} SELECT file_name, kind, CASE WHEN doc_id % 10 > 1 THEN CAST(doc_id + 11000000 AS VARCHAR) END AS build, CASE WHEN doc_id % 10 > 1 THEN '0' || (doc_id % 9 + 1) || ' Jan 24' END AS log_date, CASE WHEN doc_id % 10 > 1 THEN '10 0' || (doc_id % 6) || ' 00' END AS log_time, CASE WHEN doc_id % 10 = 1 THEN 'malformed_backup_name' END AS skipped FROM f""")
def log_catalogue(spark, sf):
    return _files(spark, sf).select("file_name", "kind", "build", "log_date", "log_time", "skipped")


@query("catalogue_fingerprint", f"""WITH {_FILES}, u AS (SELECT source, CASE WHEN kind = 'current' THEN 0 ELSE 1 END AS r, file_name, sha256(kind || ':' || file_name || ':' || size || ':' || modified_ms) AS p FROM f WHERE doc_id % 10 <> 1)
SELECT source, 'set_' || substr(sha256(string_agg(p, '|' ORDER BY r, file_name, p)), 1, 24) AS fingerprint, CAST(count(*) AS BIGINT) AS files FROM u GROUP BY 1""")
def catalogue_fingerprint(spark, sf):
    return logs.source_set_fingerprint(_files(spark, sf), ["source"])


@query("capture_window", f"""WITH {EV}, l AS (SELECT event_id, user_id, ms, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e), o AS (SELECT *, (n - 1) * 100 AS off, max(n) OVER (PARTITION BY user_id) * 100 AS fin FROM l),
s AS (SELECT user_id, min(off) FILTER (WHERE k % 4 > 0 AND ms >= 1706000000000) AS start FROM o GROUP BY 1)
SELECT event_id, false AS truncated FROM o JOIN s USING (user_id) WHERE off >= start""")
def capture_window(spark, sf):
    from tracewright.plans.scans import scan, split_keys, total

    e = events(spark, sf)
    cut, lane = split_keys(e, ["user_id"], ["event_id"])
    lines = scan(cut, lane, {"byte_offset": total(F.lit(100).cast("bigint"), False)}).withColumns(
        {"byte_length": F.lit(100).cast("bigint"), "ms": F.when(F.col("k") % 4 > 0, F.col("ms"))}
    )
    return logs.capture_window(lines, ["user_id"], 1706000000000).select("event_id", "truncated")
