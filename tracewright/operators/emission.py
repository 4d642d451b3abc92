"""Records to typed events: every rule kind, with the state it needs expressed as running values over the lane."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.constants import READY_WINDOW_MS, VEHICLE_STORE_WINDOW_MS
from tracewright.functions.identity import (
    channel_from_path,
    environment_confidence,
    environment_key,
    release_channel,
    source_installation_id,
)
from tracewright.functions.instants import ordered_within, with_log_instant
from tracewright.functions.text import (
    bracket,
    clean,
    endpoint_host,
    endpoint_port,
    group,
    keyed,
    location_message,
    notification,
    notification_message,
    number_text,
    quoted,
    to_boolean,
    to_integer,
    to_number,
    trim_ws,
    vehicle_display_name,
    zero_identifier,
)
from tracewright.operators import contracts
from tracewright.operators.environment import build_compatibility, build_evidence, select_profile
from tracewright.operators.framing import LANE
from tracewright.operators.rules import (
    EXTRACTORS,
    LIFECYCLE_RULES,
    PROFILES,
    PTU_MARKERS,
    SIGNAL_RULES,
    Profile,
    Rule,
    check_profiles,
    matching_rules,
    profiles_table,
)
from tracewright.operators.signals import captured_signals, signal_payload
from tracewright.plans.scans import CHUNK, TARGET_ROWS, Lane, asof, last, previous, scan, split_offsets, total
from tracewright.plans.settle import fenced, settle

ORDER = ["byte_offset"]
RULES: dict[str, Rule] = {r.rule_id: r for r in [*LIFECYCLE_RULES, *SIGNAL_RULES]}
ENV = ["environment_key", "channel", "build", "branch", "profile_id", "profile_version", "parser_version"]
_UNKNOWN_REQUEST = "UNKNOWN_MATCHMAKING_REQUEST"


@dataclass(frozen=True)
class Parsed:
    """Tables produced from one set of records; all lazy."""

    records: DataFrame
    candidates: DataFrame
    incomplete: DataFrame
    suppressed: DataFrame
    events: DataFrame
    rejected: DataFrame
    unknown: DataFrame
    conflicts: DataFrame
    drifted: DataFrame


def with_environment(
    records: DataFrame, lane: Lane, spark: SparkSession, defaults: Mapping[str, str] | None = None,
    profiles: Sequence[Profile] = tuple(PROFILES),
) -> DataFrame:
    """Records with environment facts, key, selected profile and compatibility verdict."""
    d = dict(defaults or {})

    def default(name: str, value: str | None = None) -> Column:
        return F.lit(d.get(name, value)).cast("string")

    known = build_evidence(records, lane, default("build"))
    source = F.coalesce("b_source", default("source"), F.col("source_id"))
    channel = F.coalesce(
        "b_channel", release_channel(default("channel")), channel_from_path(source), F.lit("UNKNOWN")
    )
    facts = known.withColumns(
        {
            "channel": channel,
            "universe": F.lit("PU"),
            "branch": F.coalesce("b_branch", default("branch", "UNKNOWN")),
            "build": F.coalesce("b_game", "b_file", F.lit("UNKNOWN_BUILD")),
            "location": source,
            "env_name": F.coalesce("b_name", default("name", "UNKNOWN")),
        }
    )
    # no generator and only broadcast joins from here on: partitions and order of the lane last until its next running values
    keyed_env = facts.withColumn(
        "environment_key",
        environment_key(
            F.col("channel"), F.col("universe"), F.col("build"), F.col("branch"), source_installation_id(F.col("location"))
        ),
    ).withColumn(
        "env_confidence",
        environment_confidence(F.col("channel"), F.col("build"), F.col("branch"), F.col("env_name")),
    )
    known_profiles = profiles_table(spark, profiles)
    wanted = d.get("profile_id")
    chosen = known_profiles.where(F.col("profile_id") == wanted) if wanted else known_profiles.where(~F.col("fixture_only"))
    judged = build_compatibility(select_profile(keyed_env, chosen)).withColumnRenamed("version", "profile_version")
    meta = known_profiles.select("profile_id", "rule_set", "parser_version")
    out = judged.join(F.broadcast(meta), "profile_id", "left").withColumn(
        "parser_version", F.coalesce("parser_version", F.lit("runtime-log-parser/0.1.0"))
    )
    return with_log_instant(out, "text", "ts_ms", "ts_code")


def _own_rules(profiles: Sequence[Profile]) -> list[tuple[str, Rule]]:
    """Rules that profiles bring, with the id of their profile."""
    return [(p.profile_id, r) for p in profiles for r in p.own]


def _observe(records: DataFrame, lane: Lane, profiles: Sequence[Profile] = ()) -> DataFrame:
    """Rule matches, extracted values and running lane state for records that carry an environment."""
    text = F.col("text")
    usable = F.col("status") == "compatible"
    lifecycle = usable & (F.col("rule_set") == "lifecycle")
    matched = F.when(lifecycle, matching_rules("text", LIFECYCLE_RULES)).when(
        usable & (F.col("rule_set") == "captured"), matching_rules("text", SIGNAL_RULES)
    ).when(
        usable & (F.col("rule_set") == "captured-completions"),
        matching_rules("text", [r for r in SIGNAL_RULES if r.markers[0] in PTU_MARKERS]),
    )
    none = F.array().cast("array<string>")
    rules = F.coalesce(matched, none)
    for p in profiles:
        if p.own:
            here = usable & (F.col("profile_id") == p.profile_id)
            rules = F.concat(rules, F.when(here, matching_rules("text", p.own)).otherwise(none))
    base = records.withColumn("rules", rules)

    def on(*ids: str) -> Column:
        out = F.lit(False)
        for i in ids:
            out = out | F.array_contains("rules", i)
        return out

    def take(value: Column, *ids: str) -> Column:
        return F.when(on(*ids), value)

    created, complete, dropped = "connection.channel-created", "connection.complete", "disconnect.channel"
    returned, quit_, join = "frontend.returned", "application.system-quit", "pu.join-requested"
    channels = (created, complete, dropped, returned)
    fragment, incoming, login = "identity.character-fragment", "identity.incoming-connection", "identity.account-authenticated"
    # values that the columns below use more than once are read from the text once
    told = base.withColumns(
        {
            "_remote": take(keyed(text, "remoteAddr"), *channels),
            "_port": take(bracket(text, "port"), join, "pu.matchmaking-request"),
            "_nodes": take(quoted(text, "nodeCount"), "mesh.universe-hierarchy-start"),
        }
    )
    seen = told.withColumns(
        {
            "x_host": endpoint_host(F.col("_remote")),
            "x_port": endpoint_port(F.col("_remote")),
            "x_node": take(keyed(text, "node_id"), *channels, incoming),
            "x_geid": take(keyed(text, "playerGEID"), *channels, incoming),
            "x_rules": take(keyed(text, "gamerules"), *channels, "mesh.pu-territory-setup-complete"),
            "x_host_type": take(keyed(text, "hostType"), *channels),
            "j_shard": take(bracket(text, "shard"), join),
            "j_endpoint": take(bracket(text, "address"), join),
            "j_port": to_integer(F.col("_port")),
            "j_location": take(bracket(text, "locationId"), join),
            "m_id": take(bracket(text, "id"), "pu.matchmaking-request"),
            "m_status": take(bracket(text, "status"), "pu.matchmaking-request"),
            "i_fragment_name": take(keyed(text, "name"), fragment),
            "i_fragment_geid": take(keyed(text, "geid"), fragment),
            "i_handle": take(bracket(text, "handle"), login),
            "i_account": F.coalesce(
                take(bracket(text, "accountId"), login), take(keyed(text, "accountId"), fragment)
            ),
            "i_nick": take(quoted(text, "nickname"), incoming),
            "i_session": take(keyed(text, "session"), incoming),
            "x_reason": take(keyed(text, "RequestFrontEndReason"), "frontend.reason"),
            "h_network": take(to_boolean(quoted(text, "bNetRecvd")), "mesh.universe-hierarchy-start"),
            "h_nodes": to_integer(F.col("_nodes")),
            "n": F.when(F.contains(text, F.lit("Notification")), notification(text)),
        }
    ).drop("_remote", "_port", "_nodes")
    pos, at = F.col("byte_offset"), F.col("ts_ms")
    joined = (
        on(join)
        & F.col("j_shard").isNotNull()
        & F.col("j_endpoint").isNotNull()
        & F.col("j_location").isNotNull()
        & F.coalesce(F.col("j_port").between(1, 65535), F.lit(False))
        & at.isNotNull()
    )
    is_front = on(returned) & F.contains(F.coalesce("x_host", F.lit("")), F.lit("frontend"))
    lost = on(dropped) & (F.lower(F.coalesce("x_rules", F.lit(""))) != "sc_frontend")
    hard = is_front | on(quit_)
    observed = seen.withColumns({"is_join": joined, "is_front": is_front, "is_lost": lost, "is_hard": hard})
    # over a cut lane each running value below is a job of its own, which would plan and read all of the above again
    state = scan(
        settle(observed) if lane.split else observed,
        lane,
        {
            "s_join": last(
                F.when(
                    F.col("is_join"),
                    F.struct(pos.alias("pos"), at.alias("ms"), F.col("j_endpoint").alias("endpoint"),
                             F.col("j_shard").alias("shard"), F.col("j_port").alias("port"),
                             F.col("environment_key").alias("env")),
                ),
                False,
            ),
            "s_name": last(F.coalesce("i_fragment_name", "i_nick")),
            "s_handle": last(F.col("i_handle")),
            "s_account": last(F.col("i_account")),
            "s_character": last(F.col("i_fragment_geid")),
            "s_player": last(F.when(on(incoming), F.col("x_geid"))),
            "s_front_reason": last(F.col("x_reason")),
            "s_begin": last(
                F.when(
                    on("mesh.universe-hierarchy-start"),
                    F.struct(pos.alias("pos"), F.col("line_no").alias("line_no"), at.alias("ms"),
                             F.col("h_network").alias("network"), F.col("h_nodes").alias("nodes")),
                ),
                False,
            ),
            "s_end": last(F.when(on("mesh.universe-hierarchy-complete"), pos), False),
            "s_env": previous(F.col("environment_key")),
        },
    )
    same = F.col("x_host") == F.col("s_join.endpoint")
    kills = F.col("is_hard") | (F.col("is_lost") & F.coalesce(same, F.lit(False)))
    territory = on("mesh.pu-territory-setup-complete") & (F.col("x_rules") == "SC_Default")
    two = scan(
        state.withColumn("is_kill", kills),
        lane,
        {
            "s_kill": last(F.when(F.col("is_kill"), pos), False),
            "s_territory": last(F.when(territory, F.struct(pos.alias("pos"), at.alias("ms"))), False),
            "env_epoch": total(F.coalesce(F.col("s_env") != F.col("environment_key"), F.lit(False)).cast("bigint")),
        },
    )
    alive = F.col("s_join").isNotNull() & (F.col("s_kill").isNull() | (F.col("s_kill") < F.col("s_join.pos")))
    in_session = F.coalesce(F.col("s_territory.pos") > F.col("s_join.pos"), F.lit(False))
    mode_ok = (
        on("pu.game-mode-created")
        & F.col("alive")
        & in_session
        & ordered_within(F.col("s_territory.ms"), at, READY_WINDOW_MS)
    )
    clears = F.col("is_join") | F.col("is_hard") | (
        F.col("is_lost") & (~F.col("alive") | F.coalesce(same, F.lit(False)))
    )
    entered = on("pu.entered") & (keyed(text, "rules") == "SC_Default") & to_number(keyed(text, "elapsedSecs")).isNotNull()
    three = scan(
        two.withColumn("alive", alive),
        lane,
        {
            "s_mode": last(F.when(mode_ok, F.struct(pos.alias("pos"), at.alias("ms"))), False),
            "s_entered": last(F.when(entered & at.isNotNull(), pos), False),
            "session_epoch": total(F.coalesce(clears, F.lit(False)).cast("bigint")),
        },
    )
    qualifies = (
        on("pu.entered-local-telemetry")
        & F.col("alive")
        & (F.col("s_join.env") == F.col("environment_key"))
        & in_session
        & F.coalesce(F.col("s_mode.pos") > F.col("s_territory.pos"), F.lit(False))
        & ordered_within(F.col("s_join.ms"), F.col("s_territory.ms"), READY_WINDOW_MS)
        & ordered_within(F.col("s_territory.ms"), F.col("s_mode.ms"), READY_WINDOW_MS)
        & ordered_within(F.col("s_mode.ms"), at, READY_WINDOW_MS)
        & ~F.coalesce(F.col("s_entered") > F.col("s_join.pos"), F.lit(False))
    )
    four = scan(
        three.withColumn("qualifies", F.coalesce(qualifies, F.lit(False))),
        lane,
        {"s_emitted": last(F.when(F.col("qualifies"), F.col("s_join.pos")), False)},
    )
    fresh = F.col("qualifies") & ~F.coalesce(F.col("s_emitted") == F.col("s_join.pos"), F.lit(False))
    scope = F.when(
        F.col("alive"),
        F.concat_ws("|", F.col("s_join.ms"), F.col("s_join.shard"), F.col("s_join.endpoint"), F.col("s_join.port")),
    )
    return four.withColumns({"ready": fresh, "session_scope": scope})


def _map(**fields: Column) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])


_FOUND = "array<struct<rule_id:string,event_type:string,payload:map<string,string>,dedupe_scope:string>>"


def _candidate(rule_id: str, event_type: str, when: Column, payload: Column, scope: Column | None = None) -> Column:
    """An array of one candidate, or of none."""
    one = F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(event_type).alias("event_type"),
        payload.alias("payload"),
        (scope if scope is not None else F.lit(None).cast("string")).alias("dedupe_scope"),
    )
    return F.when(when, F.array(one)).otherwise(F.array().cast(_FOUND))


def _spread(seen: DataFrame, parts: Sequence[Column]) -> DataFrame:
    """One row per candidate. The candidates are a projection below the generator, so that Spark compiles them: what a generator or a
    lambda holds is interpreted.
    """
    none = F.lit(None).cast("string").alias("marker")
    found = seen.select(*_CARRY, none, _NO_REFS(), F.array(*parts).alias("_parts"))
    return found.select(*_CARRY, "marker", "contributors", F.inline(F.flatten("_parts")))


def _of(rule_id: str, when: Column, payload: Column, scope: Column | None = None) -> Column:
    return _candidate(rule_id, RULES[rule_id].event_type, when, payload, scope)


def _by_type(values: dict[str, list[str]], column: str = "event_type") -> Column:
    """Field list of the row's event type, from one constant map."""
    table = F.from_json(F.lit(json.dumps(values)), "map<string,array<string>>")
    return F.coalesce(F.try_element_at(table, F.col(column)), F.array().cast("array<string>"))


def _finish(rows: DataFrame, own: Sequence[Rule] = ()) -> DataFrame:
    """Attach what the rule and the event type fix: family, required fields, dedupe values, confidence, provenance.

    Rules of callers fix theirs by rule, not by type: two of them may emit one type with other fields.
    """
    typed = [r for r in RULES.values() if r.event_type]
    vehicle = RULES["vehicle.control-released"]
    required = {r.event_type: list(r.required) for r in typed}
    dedupe = {r.event_type: list(r.dedupe) for r in typed}
    for t in ("VehicleRetrieved", "VehicleControlAcquired"):
        required[t], dedupe[t] = list(vehicle.required), list(vehicle.dedupe)
    medium = [r.event_type for r in typed if r.confidence == "medium"]
    inferred = ["VehicleRetrieved", "VehicleControlAcquired", "VehicleStored", "QuantumTargetChanged", "QuantumTravelArrived"]
    drifting = [r.rule_id for r in [*typed, *own] if r.drift]
    by_rule = F.col("rule_id").isin(*[r.rule_id for r in own]) if own else F.lit(False)

    def fixed(by_type: dict[str, list[str]], attribute: str) -> Column:
        if not own:
            return _by_type(by_type)
        return F.when(by_rule, _by_type({r.rule_id: list(getattr(r, attribute)) for r in own}, "rule_id")).otherwise(_by_type(by_type))

    sure = F.when(F.col("event_type").isin(*medium), "medium").otherwise("high")
    if own:
        told = F.from_json(F.lit(json.dumps({r.rule_id: r.confidence for r in own})), "map<string,string>")
        sure = F.when(by_rule, F.try_element_at(told, F.col("rule_id"))).otherwise(sure)
    derived = F.col("event_type").isin(*inferred) & ~by_rule
    return rows.withColumns(
        {
            "family": F.substring_index("rule_id", ".", 1),
            "required": fixed(required, "required"),
            "dedupe_values": F.transform(
                fixed(dedupe, "dedupe"), lambda f: F.coalesce(F.try_element_at(F.col("payload"), f), F.lit("UNKNOWN"))
            ),
            "confidence": sure,
            "provenance": F.when(derived, "inferred").otherwise("observed"),
            "drift": F.col("rule_id").isin(*drifting),
        }
    )


_CARRY = [*LANE, "line_no", "end_line", "byte_offset", "ts_ms", "ts_code", "text", *ENV, "session_epoch", "env_epoch"]


def _stateless(seen: DataFrame) -> DataFrame:
    """Candidates that need only the record and lane state, in one pass over the records."""
    text = F.col("text")

    def on(rule: str) -> Column:
        return F.array_contains("rules", rule)

    note = F.col("n")
    leave = r"<Leave group>\s+Client\s+(\S+)\s+leave group\s+(\S+)"
    contract = trim_ws(
        F.regexp_replace(group(note["message"], r"(?i)^Contract Accepted:\s*(.+?)\s*:?\z", 1), r":\s*\z", "")
    )
    mission = F.coalesce(bracket(text, "MissionId"), group(text, r"(?i)(?<!\w)MissionId\s*:\s*\[([^\]]+)\]", 1))
    joined = trim_ws(group(note["message"], r"(?i)^New Member Joined\s+(.+?)\s+has joined the party\.:?\s*\z", 1))
    # values that the candidates below use more than once, read where their rule matched
    once = {
        "_handle": ("party.notification-member-connected", group(note["message"], r"^(.+?) connected\.\z", 1)),
        "_member": ("party.notification-member-joined", joined),
        "_leaver": ("party.left-local", clean(group(text, leave, 1))),
        "_mission": ("mission.contract-accepted", mission),
        "_contract": ("mission.contract-accepted", contract),
        "_jurisdiction": ("zone.jurisdiction-entered", group(location_message(note["message"]), r"^Entered (.+?) Jurisdiction\z", 1)),
        "_exit": ("application.system-quit", keyed(text, "exitCode")),
        "_remote": ("disconnect.channel", keyed(text, "isRemote")),
        "_uptime": ("disconnect.channel", keyed(text, "uptime_secs")),
    }
    read = seen.withColumns({name: F.when(on(rule), value) for name, (rule, value) in once.items()})
    party_handle, member, leaver = F.col("_handle"), F.col("_member"), F.col("_leaver")
    mission_id, contract, jurisdiction = F.col("_mission"), F.col("_contract"), F.col("_jurisdiction")
    exit_code = to_integer(F.col("_exit"))
    tag = F.coalesce(release_channel(bracket(text, "Tag")), F.col("channel"))
    player = F.coalesce(F.col("s_player"), F.lit(""))
    has_begin = F.col("s_begin").isNotNull() & (F.col("s_end").isNull() | (F.col("s_end") < F.col("s_begin.pos")))
    entered_rules = keyed(text, "rules")
    parts = [
        _of("build.changelist", on("build.changelist"),
                   _map(fileVersion=F.col("b_file"), productVersion=F.col("b_product"), branch=F.col("b_branch"),
                        changelist=F.col("b_changelist"))),
        _of("environment.init", on("environment.init"),
                   _map(releaseChannel=tag, environmentName=bracket(text, "Environment"), config=bracket(text, "Config"),
                        sourceLocation=F.coalesce(bracket(text, "SourcePath"), F.col("location")))),
        _of("environment.database-version", on("environment.database-version"),
                   _map(gameVersion=F.col("b_game"), dataCoreVersion=F.col("b_data"),
                        archetypeVersion=F.col("b_archetype"), componentVersion=F.col("b_component"))),
        _of("identity.login-started", on("identity.login-started"),
                   _map(loginSessionId=keyed(text, "LoginSessionId"),
                        releaseChannel=F.coalesce(release_channel(bracket(text, "releaseChannel")), F.col("channel")))),
        _of("identity.account-authenticated", on("identity.account-authenticated"),
                   _map(handle=F.col("i_handle"), accountId=bracket(text, "accountId"))),
        _of("identity.incoming-connection", on("identity.incoming-connection"),
                   _map(characterName=F.col("s_name"), accountId=F.col("s_account"), characterGeid=F.col("s_character"),
                        playerGeid=F.col("x_geid"), nodeId=F.col("x_node"), clientSession=F.col("i_session"))),
        _of("pu.matchmaking-request", on("pu.matchmaking-request"),
                   _map(matchmakingRequestId=F.col("m_id"), matchmakingStatus=F.col("m_status"), port=F.col("j_port"))),
        _of("mesh.universe-hierarchy-complete",
                   on("mesh.universe-hierarchy-complete") & has_begin & F.col("s_begin.network") & F.col("s_begin.ms").isNotNull(),
                   _map(receivedFromNetwork=F.col("s_begin.network"), nodeCount=F.col("s_begin.nodes"),
                        durationMs=F.greatest(F.lit(0), F.col("ts_ms") - F.col("s_begin.ms")))),
        _of("mesh.pu-territory-setup-complete", on("mesh.pu-territory-setup-complete"),
                   _map(gamerules=F.col("x_rules"), status=keyed(text, "status"),
                        runningTimeSeconds=keyed(text, "runningTime")), F.col("session_scope")),
        _of("pu.entered", on("pu.entered") & (entered_rules == "SC_Default"),
                   _map(gamerules=entered_rules, loadDurationSeconds=number_text(to_number(keyed(text, "elapsedSecs")))),
                   F.col("session_scope")),
        _of("pu.entered-local-telemetry", F.col("ready"),
                   _map(gamerules=F.lit("SC_Default"),
                        loadDurationSeconds=number_text((F.col("ts_ms") - F.col("s_join.ms")) / 1000)),
                   F.col("session_scope")),
        _of("disconnect.channel", F.col("is_lost"),
                   _map(cause=keyed(text, "cause"), reason=keyed(text, "reason"), isRemote=to_boolean(F.col("_remote")),
                        endpoint=F.col("x_host"), uptimeSeconds=number_text(to_number(F.col("_uptime"))))),
        _of("frontend.returned", F.col("is_front"), _map(reason=F.col("s_front_reason"))),
        _of("application.system-quit", on("application.system-quit"),
                   _map(cause=keyed(text, "cause"), reason=keyed(text, "reason"), exitCode=exit_code,
                        clean=F.coalesce(exit_code == 0, F.lit(False)))),
        _of("party.created", on("party.created"),
                   _map(partyId=bracket(text, "partyId"), leaderHandle=bracket(text, "leader"))),
        _of("party.notification-launch", on("party.notification-launch"),
                   _map(notificationId=bracket(text, "NotificationId"), message=notification_message(text))),
        _of("party.notification-member-connected",
                   on("party.notification-member-connected") & party_handle.isNotNull(),
                   _map(notificationId=note["id"], memberHandle=party_handle)),
        _of("party.notification-member-joined",
                   on("party.notification-member-joined") & member.isNotNull(),
                   _map(notificationId=note["id"], memberHandle=member)),
        _of("party.left-local", on("party.left-local") & (leaver == player),
                   _map(partyId=clean(group(text, leave, 2)), playerGeid=leaver, reason=F.lit("voluntary_leave"))),
        _of("mission.contract-accepted",
                   on("mission.contract-accepted") & note["id"].isNotNull() & mission_id.isNotNull()
                   & ~zero_identifier(mission_id) & contract.isNotNull(),
                   _map(notificationId=note["id"], missionId=mission_id, contractName=contract)),
        _of("shop.purchase-requested", on("shop.purchase-requested"),
                   _map(requestId=F.coalesce(bracket(text, "requestId"), bracket(text, "request_id"), bracket(text, "reqId"),
                                             keyed(text, "requestId")),
                        itemName=bracket(text, "itemName"), quantity=to_integer(bracket(text, "quantity")),
                        shopName=bracket(text, "shopName"),
                        clientPrice=number_text(to_number(bracket(text, "client_price")))),
                   F.concat(F.lit("shop-request-line-"), F.col("line_no"))),
        _of("zone.jurisdiction-entered", on("zone.jurisdiction-entered") & jurisdiction.isNotNull(),
                   _map(notificationId=note["id"], jurisdiction=jurisdiction)),
        *[
            _of(rule, on(rule), _map(notificationId=note["id"], state=F.lit(state)))
            for rule, state in (("zone.monitored-entered", "entered"), ("zone.monitored-exited", "exited"),
                                ("zone.armistice-entered", "entered"), ("zone.armistice-left", "left"))
        ],
    ]
    return _spread(read, parts)


def _signals(seen: DataFrame) -> DataFrame:
    captured = seen.where(F.exists("rules", lambda r: F.startswith(r, F.lit("captured."))))
    found = fenced(captured_signals(captured.select(*_CARRY))).where(F.col("signal").isNotNull())
    return fenced(found.select(
        *_CARRY, "marker", _NO_REFS(), F.lit(SIGNAL_RULES[0].rule_id).alias("rule_id"),
        F.lit("RuntimeLogSignalObserved").alias("event_type"), signal_payload(F.col("signal")).alias("payload"),
        F.concat(F.lit("captured-line-"), F.col("line_no")).alias("dedupe_scope"),
    ))


def _NO_REFS() -> Column:
    return F.array().cast("array<string>").alias("contributors")


def _joins(seen: DataFrame, hot: int | None) -> DataFrame:
    """Join requests with the latest matchmaking request of the same port, connections with their created channel."""
    requests = seen.where(F.col("m_id").isNotNull() & F.col("j_port").isNotNull()).select(
        *LANE, "byte_offset", F.col("j_port").alias("_port"), F.col("m_id").alias("_request")
    )
    joins = seen.where(F.array_contains("rules", "pu.join-requested")).withColumn("_port", F.coalesce("j_port", F.lit(-1)))
    cols = [*_CARRY, "j_shard", "j_endpoint", "j_location", "_port"]
    with_request = asof(joins.select(*cols), requests, [*LANE, "_port"], ORDER, ["_request"], hot)
    join = _of(
        "pu.join-requested", F.lit(True),
        _map(matchmakingRequestId=F.coalesce("_request", F.lit(_UNKNOWN_REQUEST)), shard=F.col("j_shard"),
             endpoint=F.col("j_endpoint"), port=F.when(F.col("_port") >= 0, F.col("_port")), locationId=F.col("j_location")),
    )
    created = seen.where(F.array_contains("rules", "connection.channel-created") & F.col("x_host").isNotNull()).select(
        *LANE, "byte_offset", F.col("x_host").alias("_host"), F.col("x_node").alias("_node"), F.col("x_geid").alias("_geid"),
        F.col("x_host_type").alias("_type"),
    )
    done = seen.where(F.array_contains("rules", "connection.complete")).select(
        *_CARRY, F.coalesce("x_host", F.lit("")).alias("_host"), "x_port", "x_node", "x_rules", "x_host_type"
    )
    with_channel = asof(done, created, [*LANE, "_host"], ORDER, ["_node", "_geid", "_type"], hot)
    complete = _of(
        "connection.complete", F.lit(True),
        _map(endpoint=F.nullif("_host", F.lit("")), port=F.col("x_port"), observedNodeId=F.coalesce("x_node", "_node"),
             playerGeid=F.col("_geid"), gamerules=F.col("x_rules"), hostType=F.coalesce("x_host_type", "_type")),
    )
    return _spread(with_request, [join]).unionByName(_spread(with_channel, [complete]))


_VEHICLE_ROWS = (
    "source_id string, generation bigint, byte_offset bigint, event_type string, rule_id string, vehicle string,"
    " class_name string, target string, previous string, refs array<string>"
)


def _vehicle_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vehicle life cycle over rows sorted by (lane, session, vehicle, position).

    Rows stream through; only the state of the current vehicle is held, across batch borders too.
    """
    key, st = None, {}
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            k = (r.source_id, r.generation, r.session_epoch, r.vehicle)
            if k != key:
                key, st = k, {"anchored": False, "known": None, "release": None, "target": None}
            ms = None if pd.isna(r.ts_ms) else int(r.ts_ms)

            def emit(event_type, rule, name, refs=(), target=None, previous=None, row=r):
                out.append((row.source_id, row.generation, row.byte_offset, event_type, rule, row.vehicle, name, target,
                            previous, list(refs)))

            here = f"{r.source_id}/{r.generation}/{r.byte_offset}"
            if r.kind == "anchor":
                st["anchored"] = st["anchored"] or bool(r.local)
            elif r.kind == "stored":
                rel = st["release"]
                if st["known"] and rel and ms is not None and 0 <= ms - rel[0] <= VEHICLE_STORE_WINDOW_MS:
                    emit("VehicleStored", "vehicle.stored-correlated-removal", st["known"], [rel[1]])
                    st = {"anchored": False, "known": None, "release": None, "target": None}
            elif not st["anchored"]:
                continue
            elif r.kind == "release":
                st["known"] = st["known"] or r.class_name
                if ms is not None:
                    emit("VehicleControlReleased", "vehicle.control-released", st["known"])
                    st["release"] = (ms, f"VehicleControlReleased@{here}")
            elif r.kind == "quantum":
                prev = st["target"]
                if r.target is None or ms is None or (prev and prev[0] == r.target):
                    continue
                event = "QuantumTargetChanged" if prev else "QuantumTargetSelected"
                rule = "quantum.target-changed-local" if prev else "quantum.target-selected-local"
                if st["known"] is None:
                    st["known"] = r.class_name
                    emit("VehicleRetrieved", rule, r.class_name, [f"{event}@{here}"])
                    emit("VehicleControlAcquired", rule, r.class_name, [f"{event}@{here}"])
                emit(event, rule, r.class_name, [prev[1]] if prev else [], r.target, prev[0] if prev else None)
                st["target"] = (r.target, f"{event}@{here}")
            elif r.kind == "arrived" and st["target"] and ms is not None:
                emit("QuantumTravelArrived", "quantum.final-arrival", r.class_name, [st["target"][1]], st["target"][0])
                st["target"] = None
        cols = ["source_id", "generation", "byte_offset", "event_type", "rule_id", "vehicle", "class_name", "target",
                "previous", "refs"]
        yield pd.DataFrame(out, columns=cols)


def vehicle_observations(seen: DataFrame) -> DataFrame:
    """Rows that concern one vehicle: (kind, vehicle, class_name, target, local)."""
    text = F.col("text")

    def on(rule: str) -> Column:
        return F.array_contains("rules", rule)

    anchor = r"VehicleEntityId:\s*\[([^\]]+)\],\s*LandingArea:\s*(.+?)'s(?:\s|\z)"
    nav = r"\|\s*(?:NOT AUTH|AUTH)\s*\|\s*([A-Za-z0-9_]+)\[([^\]]+)\]\|"
    release = r"releasing control token for\s+'([A-Za-z0-9_]+)'\s+\[([^\]]+)\]"
    stored = r"removal of parent id\s*=\s*(\S+)\s+name\s*=\s*([A-Za-z0-9_]+)"
    kind = (
        F.when(on("vehicle.local-hangar-anchor"), "anchor")
        .when(on("vehicle.control-released"), "release")
        .when(on("vehicle.stored-correlated-removal"), "stored")
        .when(on("quantum.target-selected-local"), "quantum")
        .when(on("quantum.final-arrival"), "arrived")
    )
    rows = seen.withColumn("kind", kind).where(F.col("kind").isNotNull())

    def pick(a: Column, r: Column, s: Column, q: Column) -> Column:
        k = F.col("kind")
        return F.when(k == "anchor", a).when(k == "release", r).when(k == "stored", s).otherwise(q)

    none = F.lit(None).cast("string")
    vehicle = clean(pick(group(text, anchor, 1), group(text, release, 2), group(text, stored, 1), group(text, nav, 2)))
    name = clean(pick(none, group(text, release, 1), group(text, stored, 2), group(text, nav, 1)))
    tail = F.concat(F.lit("_"), F.col("vehicle"))
    owner = clean(group(text, anchor, 2))
    target = clean(group(text, r"Player has selected point\s+(.+?)\s+as their destination,\s*routing locally", 1))
    local = F.coalesce(owner == F.coalesce("s_name", "s_handle"), F.lit(False))
    return (
        rows.withColumns({"vehicle": vehicle, "_name": name, "target": target, "local": local})
        .where(F.col("vehicle").isNotNull())
        .withColumn(
            "class_name",
            F.when(
                F.col("kind").isin("release", "stored") & F.endswith("_name", tail),
                F.substring("_name", F.lit(1), F.length("_name") - F.length(tail)),
            ).otherwise(F.col("_name")),
        )
    )


def _vehicles(seen: DataFrame) -> DataFrame:
    obs = vehicle_observations(seen)
    lane = [*LANE, "session_epoch", "vehicle"]
    moved = (
        obs.select(*lane, "byte_offset", "ts_ms", "kind", "class_name", "target", "local")
        .repartition(*lane)
        .sortWithinPartitions(*lane, "byte_offset")
        .mapInPandas(_vehicle_states, _VEHICLE_ROWS)
    )
    carried = obs.select(*_CARRY).dropDuplicates([*LANE, "byte_offset"])
    rows = moved.join(carried, [*LANE, "byte_offset"])
    name = vehicle_display_name(F.col("class_name"))

    def lifecycle(relationship: str, outcome: str) -> Column:
        return _map(vehicleEntityId=F.col("vehicle"), vehicleClassName=F.col("class_name"), vehicleDisplayName=name,
                    relationship=F.lit(relationship), outcome=F.lit(outcome))

    nav = dict(vehicleEntityId=F.col("vehicle"), vehicleClassName=F.col("class_name"))
    t = F.col("event_type")
    payloads = {
        "VehicleRetrieved": lifecycle("hangar", "retrieved"),
        "VehicleControlAcquired": lifecycle("controlled", "acquired"),
        "VehicleControlReleased": lifecycle("controlled", "released"),
        "VehicleStored": lifecycle("hangar", "stored"),
        "QuantumTargetSelected": _map(**nav, targetObservedId=F.col("target")),
        "QuantumTargetChanged": _map(**nav, previousTargetObservedId=F.col("previous"), targetObservedId=F.col("target")),
        "QuantumTravelArrived": _map(**nav, targetObservedId=F.col("target")),
    }
    payload = F.lit(None).cast("map<string,string>")
    for event_type, value in payloads.items():
        payload = F.when(t == event_type, value).otherwise(payload)
    none = F.lit(None).cast("string")
    return fenced(rows.select(
        *_CARRY, none.alias("marker"), F.col("refs").alias("contributors"), "rule_id", "event_type",
        payload.alias("payload"), none.alias("dedupe_scope"),
    ))


def _callers(seen: DataFrame, own: Sequence[tuple[str, Rule]]) -> DataFrame:
    """Candidates of the rules that profiles bring, read by their extractors in one pass over the matching records."""
    text = F.col("text")
    parts = [
        _candidate(
            r.rule_id, r.event_type, (F.col("profile_id") == profile) & F.array_contains("rules", r.rule_id),
            F.map_filter(_map(**{name: EXTRACTORS[kind](text, key) for name, kind, key in r.fields}), lambda _, v: v.isNotNull()),
        )
        for profile, r in own
    ]
    hit = seen.where(F.arrays_overlap("rules", F.array(*[F.lit(r.rule_id) for _, r in own])))
    return _spread(hit, parts)


def emit_candidates(seen: DataFrame, hot: int | None = TARGET_ROWS, profiles: Sequence[Profile] = ()) -> DataFrame:
    """All candidates of all rule kinds. ``hot`` is the row count above which a port or endpoint is cut into chunks."""
    rows = _stateless(seen).unionByName(_joins(seen, hot)).unionByName(_vehicles(seen)).unionByName(_signals(seen))
    own = [(p, r) for p, r in _own_rules(profiles) if r.event_type]
    if own:
        rows = rows.unionByName(_callers(seen, own))
    return _finish(rows, [r for _, r in own])


def parse_records(
    records: DataFrame, spark: SparkSession, defaults: Mapping[str, str] | None = None, byte_scope: bool = False,
    profiles: Sequence[Profile] = tuple(PROFILES),
) -> Parsed:
    """Records to events, diagnostics and unmatched evidence.

    ``profiles`` replaces the reviewed profiles for this call; each may bring rules of its own. Raises ``ValueError`` with all defects if
    they are not sound.
    """
    if wrong := check_profiles(profiles, contracts.PAYLOADS):
        raise ValueError("; ".join(wrong))
    chunked, lane = split_offsets(settle(records), LANE)
    env = with_environment(chunked, lane, spark, defaults, profiles)
    # the observation table feeds four candidate branches and the unmatched evidence: computed once, then read
    seen = settle(_observe(env, lane, profiles).drop(CHUNK))
    # so are the candidates: events, drift and unmatched evidence all read them
    candidates = settle(emit_candidates(seen, TARGET_ROWS if lane.split else None, profiles))
    complete, incomplete = contracts.require_fields(candidates)
    failed = candidates.withColumn(
        "failed", F.size(contracts.missing_fields(F.col("payload"), F.col("required"))) > 0
    )
    broken = failed.where(F.col("drift") & F.col("failed")).groupBy(*LANE, "env_epoch", "family").agg(
        F.min("byte_offset").alias("_first")
    )
    marked = complete.join(broken, [*LANE, "env_epoch", "family"], "left")
    late = F.coalesce(F.col("byte_offset") > F.col("_first"), F.lit(False))
    suppressed = marked.where(late).drop("_first")
    timed = marked.where(~late & F.col("ts_ms").isNotNull()).drop("_first")
    scope = F.concat(F.lit("source-byte-"), F.col("byte_offset")) if byte_scope else F.col("dedupe_scope")
    identity = F.array(F.col("event_type"), F.coalesce(scope, F.lit("")))
    keyed_rows = timed.withColumn(
        "dedupe_id",
        F.concat(
            F.lit("dedupe_"),
            F.substring(
                F.sha2(F.to_json(F.struct("environment_key", F.concat(identity, F.col("dedupe_values")).alias("v"))), 256), 1, 24
            ),
        ),
    )
    drifted = failed.where(F.col("drift") & F.col("failed")).select("environment_key", "family").distinct()
    resolved, conflicts = contracts.resolve_conflicts(fenced(keyed_rows), [*LANE, "byte_offset", "event_type"])
    valid, rejected = contracts.validate_events(resolved)
    events = contracts.envelope(valid)
    # records that produced no candidate, and matched records that were incomplete or suppressed
    shape = [*LANE, "line_no", "byte_offset", "ts_ms", "text", "environment_key", "build", "profile_id"]
    reason = (
        F.when(F.col("profile_id").isNull(), "unsupported_profile")
        .when(F.col("status") != "compatible", F.col("reason"))
        .when(F.size("rules") == 0, "no_profile_match")
    )
    unmatched = seen.withColumn("unknown_reason", reason).where(F.col("unknown_reason").isNotNull())
    unknown = (
        unmatched.select(*shape, "unknown_reason")
        .unionByName(incomplete.select(*shape, F.lit("matched_missing_required_fields").alias("unknown_reason")))
        .unionByName(suppressed.select(*shape, F.lit("event_family_suppressed").alias("unknown_reason")))
        .unionByName(complete.where(F.col("ts_ms").isNull()).select(*shape, F.col("ts_code").alias("unknown_reason")))
    )
    return Parsed(seen, candidates, incomplete, suppressed, events, rejected, unknown, conflicts, drifted)


def resolve_contributors(events: DataFrame) -> DataFrame:
    """Replace position references in ``contributors`` by event ids."""
    place = F.concat(
        F.col("event_type"), F.lit("@"), F.concat_ws("/", F.col("source_id"), F.col("generation"), F.col("byte_offset"))
    )
    refs = events.where(F.size("contributors") > 0).select("event_id", F.explode("contributors").alias("_place"))
    ids = events.select(place.alias("_place"), F.col("event_id").alias("_id"))
    found = refs.join(ids, "_place").groupBy("event_id").agg(F.sort_array(F.collect_set("_id")).alias("_ids"))
    return (
        events.join(found, "event_id", "left")
        .withColumn("contributors", F.coalesce("_ids", F.array().cast("array<string>")))
        .drop("_ids")
    )


__all__ = ["Parsed", "emit_candidates", "parse_records", "resolve_contributors", "with_environment"]
