"""Current state per environment: life cycle, identity, connection, party, place, destination, vehicle, alerts.

Facts are last-writer-wins, so most projections are one ``max_by`` aggregation with a bounded state per group; a session
boundary with a larger order makes a fact stale. Events carry environment_key, event_type, payload, ts_ms, order_key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import IDENTITY_FIELDS, LIFECYCLE_STATES, QUIET_AFTER_MS, SESSION_BOUNDARIES
from tracewright.operators.environment import shard_region
from tracewright.plans.scans import TARGET_ROWS, highest, last, scan, split_keys, top_n

ENV = "environment_key"


def _p(name: str) -> Column:
    return F.try_element_at(F.col("payload"), F.lit(name))


def _is(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def _latest(value: Column, when: Column, order: str) -> Column:
    return F.max_by(value, F.when(when, F.col(order)))


# --- generic ----------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Projection:
    """A keyed reducer: ``reduce(state, event) -> state`` over plain dictionaries, applied in event order."""

    name: str
    version: int
    initial: Callable[[], dict]
    reduce: Callable[[dict, dict], dict]
    schema: str
    event_types: tuple[str, ...] | None = None
    expiry_ms: dict[str, int] = field(default_factory=dict)


def project(events: DataFrame, definition: Projection, order: Sequence[str], columns: Sequence[str], key: str = ENV) -> DataFrame:
    """Final state per key of a user reducer.

    A general reducer cannot be split, so its events are streamed in order through the state of one key at a time; only
    the state is held. Express a projection with :func:`latest_facts` where last-writer-wins is enough.
    """
    wanted = events if definition.event_types is None else events.where(F.col("event_type").isin(*definition.event_types))
    names = [c.strip().split()[0] for c in definition.schema.split(",")]
    kind = {f.name: f.dataType.simpleString() for f in events.schema}[key]
    initial, reduce = definition.initial, definition.reduce

    def run(batches):
        current, state, count = None, None, 0
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row[key] != current:
                    if current is not None:
                        out.append((current, count, *[state.get(n) for n in names]))
                    current, state, count = row[key], initial(), 0
                state, count = reduce(state, row), count + 1
            yield pd.DataFrame(out, columns=[key, "revision", *names])
        if current is not None:
            yield pd.DataFrame([(current, count, *[state.get(n) for n in names])], columns=[key, "revision", *names])

    return (
        wanted.select(key, *[c for c in columns if c != key], *[c for c in order if c not in columns])
        .repartition(key)
        .sortWithinPartitions(key, *order)
        .mapInPandas(run, f"`{key}` {kind}, revision bigint, {definition.schema}")
    )


def latest_facts(events: DataFrame, facts: dict[str, tuple[Column, Column]], order: str, keys: Sequence[str] = (ENV,)) -> DataFrame:
    """Last value of each fact: ``facts[name] = (value, condition)``."""
    return events.groupBy(*keys).agg(*[_latest(v, w, order).alias(n) for n, (v, w) in facts.items()])


def late_filter(events: DataFrame, keys: Sequence[str], arrival: Sequence[str], ms: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Rows with ``late``: true when older than a row of the same key that arrived before."""
    cut, lane = split_keys(events, keys, arrival, target_rows)
    seen = scan(cut, lane, {"_top": highest(F.col(ms), False)})
    return seen.withColumn("late", F.coalesce(F.col(ms) < F.col("_top"), F.lit(False))).drop("_top", "_chunk")


def with_freshness(state: DataFrame, fields: dict[str, int], now_ms: int | Column) -> DataFrame:
    """Field states ``known``, ``unknown`` or ``stale`` from ``<field>`` and ``<field>_ms``, and the overall freshness."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    states = {
        f"{f}_state": F.when(F.col(f).isNull(), "unknown").when(now - F.col(f"{f}_ms") >= ms, "stale").otherwise("known")
        for f, ms in fields.items()
    }
    out = state.withColumns(states)
    names = F.array(*[F.col(n) for n in states])
    return out.withColumn(
        "freshness",
        F.when(F.array_contains(names, "stale"), "stale").when(F.array_contains(names, "unknown"), "unknown").otherwise("current"),
    )


def changed_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Snapshots that are new or differ from the previous table."""
    return after.exceptAll(before)


# --- life cycle -------------------------------------------------------------------------------------------------------
def lifecycle_events(events: DataFrame) -> DataFrame:
    table = F.create_map(*[x for k, v in LIFECYCLE_STATES.items() for x in (F.lit(k), F.lit(v))])
    return events.withColumn("state", F.try_element_at(table, F.col("event_type"))).where(F.col("state").isNotNull())


def project_lifecycle(events: DataFrame, order: str = "order_key", ms: str = "ts_ms") -> DataFrame:
    """State per environment, when it changed last, since when loading runs, and whether an exit was clean.

    Loading starts at the first loading event after the last event of another state. Both are plain maxima and minima
    once the last non-loading order is known, so no ordered pass is needed.
    """
    rows = lifecycle_events(events)
    other = rows.where(F.col("state") != "loading").groupBy(ENV).agg(F.max(order).alias("_other"))
    exit_clean = F.coalesce(_p("clean"), F.lit("")) == "true"
    is_exit = _is("ApplicationExited")
    reason = F.when(_is(*SESSION_BOUNDARIES), F.coalesce(_p("reason"), _p("cause"), F.col("event_type"))).otherwise(F.col("event_type"))
    final = rows.groupBy(ENV).agg(
        F.max_by(
            F.struct("state", F.col(ms).alias("changed_ms"), reason.alias("reason"), is_exit.alias("exit"), exit_clean.alias("clean")),
            order,
        ).alias("f"),
        F.count(F.lit(1)).alias("transitions"),
    )
    loading = (
        rows.where(F.col("state") == "loading")
        .join(other, ENV, "left")
        .where(F.col("_other").isNull() | (F.col(order) > F.col("_other")))
        .groupBy(ENV)
        .agg(F.min_by(ms, order).alias("_loading"))
    )
    return final.join(loading, ENV, "left").select(
        ENV,
        "f.state",
        "f.changed_ms",
        "f.reason",
        F.when(F.col("f.state") == "loading", F.col("_loading")).alias("loading_since_ms"),
        F.when(F.col("f.exit") & ~F.col("f.clean"), "failure").otherwise("known").alias("status"),
        F.when(F.col("f.exit"), F.col("f.clean")).alias("clean_exit"),
        "transitions",
    )


def project_identity(claims: DataFrame, order: str = "order_key") -> DataFrame:
    """Per (environment, field): latest value, number of distinct values, known or conflicting.

    ``claims`` is (environment_key, field, value, order). Counting per value first keeps the second step small.
    """
    values = claims.where(F.coalesce("value", F.lit("")) != "").groupBy(ENV, "field", "value").agg(F.max(order).alias("_o"))
    out = values.groupBy(ENV, "field").agg(F.max_by("value", "_o").alias("value"), F.count(F.lit(1)).alias("claims"))
    return out.withColumn("status", F.when(F.col("claims") > 1, "conflicting").otherwise("known"))


def identity_claims(events: DataFrame, order: str = "order_key") -> DataFrame:
    """Identity fields of login, authentication and identity events as rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), _p(f).alias("value")) for f in IDENTITY_FIELDS])
    kept = events.where(_is("LoginStarted", "AccountAuthenticated", "IdentityObserved"))
    return kept.select(ENV, order, F.inline(pairs))


def project_connection(events: DataFrame, order: str, ms: str = "ts_ms", target_rows: int = TARGET_ROWS, arrival: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Shard, connection and session state; a disconnect from another endpoint than the current one is ignored.

    The endpoint in force at a disconnect is the last one announced by a join or connection since the last accepted
    disconnect. An accepted disconnect clears it, after which any disconnect is accepted: so a disconnect is accepted when
    the last announced endpoint equals its own or when an equal one came between that announcement and it.
    """
    announce = _is("PuJoinRequested", "PuReplicationConnectionEstablished")
    gone = _is("PuDisconnected")
    own = _p("endpoint")
    cut, lane = split_keys(events, [ENV], arrival, target_rows)
    one = scan(cut, lane, {"_cur": last(F.when(announce, F.struct(F.col(order).alias("at"), own.alias("host"))), False)})
    equal = gone & (F.col("_cur").isNull() | own.isNull() | (own == F.col("_cur.host")))
    two = scan(one.withColumn("_equal", F.coalesce(equal, F.lit(False))), lane,
               {"_cleared": highest(F.when(F.col("_equal"), F.col(order)), False)})
    accepted = gone & (F.col("_equal") | F.coalesce(F.col("_cleared") > F.col("_cur.at"), F.lit(False)))
    rows = two.withColumn("_accepted", accepted)
    connected, entered, join, queue = (
        _is("PuReplicationConnectionEstablished"), _is("PuEntered"), _is("PuJoinRequested"), _is("MatchmakingStatusObserved"),
    )
    off = F.col("_accepted")
    shard = F.when(join, "transitioning").when(entered, "connected").when(off, "disconnected")
    link = F.when(join, "transitioning").when(connected, "connected").when(off, "disconnected")
    session = F.when(join | queue, "connecting").when(entered, "in_game").when(off, "disconnected")
    agg = rows.groupBy(ENV).agg(
        _latest(_p("shard"), join, order).alias("shard"),
        _latest(shard, join | entered | off, order).alias("_shard"),
        _latest(link, join | connected | off, order).alias("connection_state"),
        _latest(F.when(off, F.lit(None)).otherwise(own), announce | off, order).alias("endpoint"),
        _latest(session, join | queue | entered | off, order).alias("session_state"),
        F.coalesce(_latest(F.col(ms), queue, order), F.min_by(ms, F.when(join, F.col(order)))).alias("requested_ms"),
        _latest(F.col(ms), entered, order).alias("_entered"),
        _latest(F.col(ms), off, order).alias("_ended"),
        F.max(F.when(join | queue, F.col(order))).alias("_request_at"),
        F.max(F.when(entered, F.col(order))).alias("_entered_at"),
        F.max(F.when(off, F.col(order))).alias("_ended_at"),
        _latest(_p("uptimeSeconds").try_cast("double"), off, order).alias("_uptime"),
    )
    def since_request(value: str, at: str) -> Column:
        return F.when(F.col("_request_at").isNull() | (F.col(at) > F.col("_request_at")), F.col(value))

    return agg.select(
        ENV,
        "shard",
        F.when(F.col("shard").isNull() & (F.col("_shard") == "connected"), "unknown").otherwise(F.coalesce("_shard", F.lit("unknown"))).alias("shard_state"),
        shard_region(F.col("shard"))["region"].alias("region"),
        F.coalesce("connection_state", F.lit("unknown")).alias("connection_state"),
        "endpoint",
        F.coalesce("session_state", F.lit("unknown")).alias("session_state"),
        "requested_ms",
        since_request("_entered", "_entered_at").alias("entered_ms"),
        since_request("_ended", "_ended_at").alias("ended_ms"),
        since_request("_uptime", "_ended_at").alias("duration_seconds"),
    )


def session_elapsed(state: DataFrame, now_ms: int | Column) -> DataFrame:
    """Observed uptime when known, otherwise whole seconds from entry (or request) to the end (or now)."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    start = F.coalesce("entered_ms", "requested_ms")
    gap = F.coalesce(F.col("ended_ms"), now) - start
    return state.withColumn(
        "elapsed_seconds", F.coalesce(F.col("duration_seconds"), F.when(gap >= 0, F.floor(gap / 1000).cast("double")))
    )


def project_build(events: DataFrame, order: str = "order_key") -> DataFrame:
    """Build facts merged by latest event."""
    client, data, env = _is("ClientBuildObserved"), _is("GameDataVersionObserved"), _is("ReleaseEnvironmentObserved")
    facts = {n: (_p(n), client) for n in ("fileVersion", "productVersion", "branch", "changelist")}
    facts |= {n: (_p(n), data) for n in ("gameVersion", "dataCoreVersion", "archetypeVersion", "componentVersion")}
    facts["config"] = (_p("config"), env)
    return latest_facts(events, facts, order)


# --- party, place, destination, vehicle -------------------------------------------------------------------------------
def _boundary(events: DataFrame, order: str) -> DataFrame:
    return events.where(_is(*SESSION_BOUNDARIES)).groupBy(ENV).agg(F.max(order).alias("_boundary"))


def party_members(events: DataFrame, order: str = "order_key") -> DataFrame:
    """Members since the last leave, each by its latest fact; stale when a session boundary came after it.

    Aggregated per (environment, handle) first: what is joined with the last leave and boundary is one row per handle.
    """
    handle = F.coalesce(_p("leaderHandle"), _p("memberHandle"))
    rows = events.where(_is("PartyCreated", "PartyMemberConnected", "PartyMemberJoined") & (F.coalesce(handle, F.lit("")) != ""))
    latest = rows.groupBy(ENV, handle.alias("handle")).agg(
        F.max_by(F.struct("event_type", F.col(order).alias("at")), order).alias("f")
    )
    ends = events.where(_is("PartyLeft", *SESSION_BOUNDARIES)).groupBy(ENV).agg(
        F.max(F.when(_is("PartyLeft"), F.col(order))).alias("_left"),
        F.max(F.when(_is(*SESSION_BOUNDARIES), F.col(order))).alias("_boundary"),
    )
    known = latest.join(ends, ENV, "left").where(F.col("_left").isNull() | (F.col("f.at") > F.col("_left")))
    stale = F.coalesce(F.col("_boundary") > F.col("f.at"), F.lit(False))
    kind = F.col("f.event_type")
    return known.select(
        ENV,
        "handle",
        F.when(stale, "stale").when(kind == "PartyMemberConnected", "possible").otherwise("confirmed").alias("membership"),
        F.when(kind == "PartyCreated", "unknown").when(stale, "stale").otherwise("connected").alias("connection"),
        (kind == "PartyCreated").alias("created"),
    )


def project_party(events: DataFrame, order: str = "order_key", ms: str = "ts_ms") -> DataFrame:
    """Party state per environment with leader and member counts."""
    created, joined, left = _is("PartyCreated"), _is("PartyMemberJoined"), _is("PartyLeft")
    moves = _is("PartyCreated", "PartyLaunchInitiated", "PartyMemberConnected", "PartyMemberJoined", "PartyLeft")
    at = F.col(order)
    agg = events.where(moves | _is(*SESSION_BOUNDARIES)).groupBy(ENV).agg(
        F.max(F.when(left, at)).alias("_left"),
        F.max(F.when(created, at)).alias("_created"),
        F.max(F.when(joined, at)).alias("_joined"),
        F.min(F.when(joined, at)).alias("_first_joined"),
        F.max(F.when(moves, at)).alias("_moved"),
        F.min(F.when(moves, at)).alias("_first_move"),
        F.max(F.when(_is(*SESSION_BOUNDARIES), at)).alias("_boundary"),
        _latest(_p("partyId"), created, order).alias("_party"),
        _latest(_p("leaderHandle"), created, order).alias("_leader"),
        F.max(F.when(moves, F.col(ms))).alias("changed_ms"),
    )
    after_left = F.col("_left").isNull() | (F.col("_created") > F.col("_left"))
    led = F.col("_created").isNotNull() & after_left
    # a join only lifts "unknown": after a leave or a boundary the state stays as it is until the next creation
    base = F.when(F.col("_created").isNotNull() & after_left, "in_party").when(F.col("_left").isNotNull(), "not_in_party").when(
        F.col("_joined").isNotNull(), "in_party"
    )
    since = F.when(F.col("_created").isNotNull() & after_left, F.col("_created")).otherwise(F.col("_first_joined"))
    stale = (base == "in_party") & F.coalesce(F.col("_boundary") > since, F.lit(False))
    members = party_members(events, order).groupBy(ENV).agg(
        F.count_if(F.col("membership") == "confirmed").alias("confirmed"), F.count_if(F.col("membership") == "possible").alias("possible")
    )
    state = F.when(stale, "stale").otherwise(F.coalesce(base, F.lit("unknown")))
    out = agg.join(members, ENV, "left")
    return out.select(
        ENV,
        state.alias("state"),
        F.when(led, F.col("_party")).alias("party_id"),
        F.when(led, F.col("_leader")).alias("leader"),
        F.coalesce("confirmed", F.lit(0)).alias("confirmed"),
        F.coalesce("possible", F.lit(0)).alias("possible"),
        F.when(stale, "stale").when(F.col("_moved").isNotNull(), "current").otherwise("unknown").alias("freshness"),
    )


def party_transitions(events: DataFrame, order: str = "order_key", n: int = 10) -> DataFrame:
    """The latest party transitions per environment."""
    moves = events.where(_is("PartyCreated", "PartyLaunchInitiated", "PartyMemberConnected", "PartyMemberJoined", "PartyLeft"))
    return top_n(moves, [ENV], [F.desc(order)], n)


def project_location(events: DataFrame, order: str = "order_key") -> DataFrame:
    """Jurisdiction, monitored space and armistice, each stale once a session boundary follows it."""
    place = {
        "jurisdiction": (_is("JurisdictionEntered"), F.lit("last_confirmed"), _p("jurisdiction")),
        "monitored": (_is("MonitoredSpaceEntered", "MonitoredSpaceExited"),
                      F.when(_is("MonitoredSpaceEntered"), "entered").otherwise("exited"),
                      _is("MonitoredSpaceEntered").cast("string")),
        "armistice": (_is("ArmisticeStateChanged"), F.when(_p("state") == "entered", "entered").otherwise("left"),
                      (_p("state") == "entered").cast("string")),
    }
    agg = events.groupBy(ENV).agg(
        *[
            F.max_by(F.struct(s.alias("state"), v.alias("value"), F.col(order).alias("at")), F.when(w, F.col(order))).alias(n)
            for n, (w, s, v) in place.items()
        ],
        F.max(F.when(_is(*SESSION_BOUNDARIES), F.col(order))).alias("_boundary"),
    )

    def state(n: str) -> Column:
        return (
            F.when(F.col(n).isNull(), "unknown")
            .when(F.coalesce(F.col("_boundary") > F.col(f"{n}.at"), F.lit(False)), "stale")
            .otherwise(F.col(f"{n}.state"))
        )

    states = F.array(*[state(n) for n in place])
    overall = F.when(F.exists(states, lambda s: ~s.isin("unknown", "stale")), "known").when(F.array_contains(states, "stale"), "stale").otherwise("unknown")
    return agg.select(
        ENV,
        overall.alias("state"),
        *[x for n in place for x in (state(n).alias(f"{n}_state"), F.col(f"{n}.value").alias(n))],
    )


def project_destination(events: DataFrame, order: str = "order_key") -> DataFrame:
    """target_selected, arrived or stale, with the current target and the last arrival."""
    chosen, arrived, ends = _is("QuantumTargetSelected", "QuantumTargetChanged"), _is("QuantumTravelArrived"), _is(*SESSION_BOUNDARIES)
    target = _p("targetObservedId")
    agg = events.groupBy(ENV).agg(
        F.max_by(F.struct(F.when(arrived, "arrived").otherwise("target_selected").alias("state"), target.alias("target"), F.col(order).alias("at")),
                 F.when(chosen | arrived, F.col(order))).alias("m"),
        _latest(target, arrived, order).alias("last_arrival"),
        F.max(F.when(ends, F.col(order))).alias("_boundary"),
    )
    stale = F.coalesce(F.col("_boundary") > F.col("m.at"), F.lit(False))
    state = F.when(F.col("m").isNull(), "unknown").when(stale, "stale").otherwise(F.col("m.state"))
    return agg.select(
        ENV,
        state.alias("state"),
        F.when(state == "target_selected", F.col("m.target")).alias("current_target"),
        "last_arrival",
        F.when(F.col("m").isNull(), "unknown").when(stale, "stale").otherwise("current").alias("freshness"),
    )


def project_vehicle(events: DataFrame, order: str = "order_key") -> DataFrame:
    """Hangar and controlled vehicle: the last acquisition per slot, then later updates of the same entity."""
    entity = _p("vehicleEntityId")
    slots = {"hangar": (_is("VehicleRetrieved"), ["VehicleStored"]),
             "controlled": (_is("VehicleControlAcquired"), ["VehicleControlReleased", "VehicleStored"])}
    out = None
    base = events.groupBy(ENV).agg(F.max(F.when(_is(*SESSION_BOUNDARIES), F.col(order))).alias("_boundary"))
    for slot, (acquired, updates) in slots.items():
        got = events.where(acquired).groupBy(ENV).agg(F.max_by(F.struct(entity.alias("id"), F.col(order).alias("at")), order).alias(slot))
        # the latest update per entity, aggregated before it meets the slot
        later = (
            events.where(_is(*updates))
            .groupBy(ENV, entity.alias("_id"))
            .agg(F.max_by(F.struct("event_type", F.col(order).alias("at")), order).alias("_u"))
        )
        joined = got.join(later, (got[ENV] == later[ENV]) & (F.col(f"{slot}.id") == later["_id"]), "left").select(
            got[ENV], F.col(slot), F.when(F.col("_u.at") > F.col(f"{slot}.at"), F.col("_u")).alias("_u")
        )
        fact = joined.select(
            ENV,
            F.col(f"{slot}.id").alias(f"{slot}_vehicle"),
            F.coalesce("_u.at", f"{slot}.at").alias(f"_{slot}_at"),
            F.when(F.col("_u").isNull(), "known").when(F.col("_u.event_type") == "VehicleStored", "stored").otherwise("released").alias(f"_{slot}_state"),
        )
        out = fact if out is None else out.join(fact, ENV, "full_outer")
    both = base.join(out, ENV, "left")
    return both.select(
        ENV,
        *[
            x
            for s in slots
            for x in (
                F.col(f"{s}_vehicle"),
                F.when(F.coalesce(F.col("_boundary") > F.col(f"_{s}_at"), F.lit(False)), "disconnected").otherwise(F.col(f"_{s}_state")).alias(f"{s}_state"),
            )
        ],
    )


# --- alerts and activity ----------------------------------------------------------------------------------------------
def alerts(health: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Alert rows (environment_key, alert_id, severity) from parser health and environment diagnostics."""
    status = {"suspected_drift": "parser-drift", "unverified_build": "unverified-build", "unsupported_profile": "unsupported-profile"}
    named = F.create_map(*[x for k, v in status.items() for x in (F.lit(k), F.lit(v))])
    a = health.withColumn("alert_id", F.try_element_at(named, F.col("status"))).where(F.col("alert_id").isNotNull())
    d = diagnostics.groupBy(ENV, "code").agg(F.count(F.lit(1)).alias("_n"))
    return a.select(ENV, "alert_id", F.lit("warning").alias("severity")).unionByName(
        d.select(ENV, F.concat(F.lit("diagnostic-"), "code").alias("alert_id"), F.lit("warning").alias("severity"))
    )


def alert_lifecycle(before: DataFrame, now: DataFrame, keys: Sequence[str] = (ENV, "alert_id")) -> DataFrame:
    """active for current alerts, cleared for those only present before."""
    b = before.select(*keys).distinct().withColumn("_b", F.lit(True))
    n = now.select(*keys).distinct().withColumn("_n", F.lit(True))
    return b.join(n, list(keys), "full_outer").select(*keys, F.when(F.col("_n"), "active").otherwise("cleared").alias("state"))


def activity_state(last_seen_ms: Column, now_ms: Column) -> Column:
    return F.when(last_seen_ms.isNull(), "none").when(now_ms - last_seen_ms > QUIET_AFTER_MS, "quiet").otherwise("recent")


