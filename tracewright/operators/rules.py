"""Versioned extraction rules: literal dispatch, anchors, drift, health. Rules are data; profiles select them."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.constants import DRIFT_MIN_RECORDS, DRIFT_MIN_UNKNOWN, DRIFT_RATIO
from tracewright.functions.text import bracket, keyed, quoted, to_boolean, to_integer


@dataclass(frozen=True)
class Rule:
    """One extraction rule: all ``literals`` must occur in the record; state rules have no event type.

    ``fields`` says how a rule that a caller brings reads its payload: (field, extractor, key), the extractors being those of ``EXTRACTORS``.
    """

    rule_id: str
    literals: tuple[str, ...]
    event_type: str | None = None
    required: tuple[str, ...] = ()
    dedupe: tuple[str, ...] = ()
    confidence: str = "high"
    drift: bool = False
    markers: tuple[str, ...] = field(default=())
    fields: tuple[tuple[str, str, str], ...] = ()

    @property
    def family(self) -> str:
        return self.rule_id.split(".")[0]


_N = "<SHUDEvent_OnNotification>"
_Q = ("<Player Selected Quantum Target - Local>", "OnPlayerSelectedQuantumTarget", "routing locally")
_V = ("vehicleEntityId", "vehicleClassName", "vehicleDisplayName", "relationship", "outcome")
_BUILD = ("fileVersion", "productVersion", "branch", "changelist")
_ENV = ("releaseChannel", "environmentName", "config", "sourceLocation")
_DATA = ("gameVersion", "dataCoreVersion", "archetypeVersion", "componentVersion")
_JOIN = ("matchmakingRequestId", "shard", "endpoint", "port", "locationId")
_REPL = ("endpoint", "port", "observedNodeId", "playerGeid", "gamerules", "hostType")
_ID = ("characterName", "accountId", "characterGeid", "playerGeid", "nodeId", "clientSession")
_STATE = ("notificationId", "state")

# --- fixed values: the lifecycle rule set -----------------------------------------------------------------------------
LIFECYCLE_RULES: list[Rule] = [
    Rule("build.file-version", ("FileVersion:",)),
    Rule("build.product-version", ("ProductVersion:",)),
    Rule("build.branch", ("Branch:",)),
    Rule("build.changelist", ("Changelist:",), "ClientBuildObserved", _BUILD, _BUILD),
    Rule("environment.init", ("<Init>", "Environment[", "Tag["), "ReleaseEnvironmentObserved", _ENV, _ENV),
    Rule("environment.game-version", ("<Game Version>",)),
    Rule("environment.database-version", ("<SetDatabaseVersion>",), "GameDataVersionObserved", _DATA, _DATA),
    Rule("identity.login-started", ("<InitiateLogin>",), "LoginStarted", ("loginSessionId", "releaseChannel"),
         ("loginSessionId",)),
    Rule("identity.account-authenticated", ("<Legacy login response>",), "AccountAuthenticated", ("handle", "accountId"),
         ("handle", "accountId")),
    Rule("identity.character-fragment", ("<AccountLoginCharacterStatus_Character>",)),
    Rule("identity.incoming-connection", ("<Expect Incoming Connection>",), "IdentityObserved", _ID,
         ("accountId", "characterGeid", "playerGeid", "clientSession")),
    Rule("pu.matchmaking-request", ("{Join PU}",), "MatchmakingStatusObserved",
         ("matchmakingRequestId", "matchmakingStatus", "port"), ("matchmakingRequestId", "matchmakingStatus", "port")),
    Rule("pu.join-requested", ("<Join PU>",), "PuJoinRequested", _JOIN, _JOIN),
    Rule("connection.channel-created", ("<Channel Created>",)),
    Rule("connection.complete", ("<Channel Connection Complete>", 'hostType="Replicant"'),
         "PuReplicationConnectionEstablished", _REPL, _REPL),
    Rule("mesh.universe-hierarchy-start", ("<RegisterUniverseHierarchy_Begin>",)),
    Rule("mesh.universe-hierarchy-complete", ("<RegisterUniverseHierarchy_End>",), "UniverseHierarchyRegistered",
         ("receivedFromNetwork", "nodeCount", "durationMs"), ("receivedFromNetwork", "nodeCount")),
    Rule("mesh.pu-territory-setup-complete",
         ("<ContextEstablisherTaskFinished>", 'taskname="SetupTerritories"', 'gamerules="SC_Default"', 'status="Finished"'),
         "PuTerritorySetupCompleted", ("gamerules", "status", "runningTimeSeconds"), ("gamerules", "status")),
    Rule("pu.entered", ("OnClientEnteredGame", "eCVS_InGame", "Finished"), "PuEntered",
         ("gamerules", "loadDurationSeconds"), ("gamerules", "loadDurationSeconds")),
    Rule("pu.game-mode-created", ("GameRulesActionEvent_GameModeCreated", "Game mode created")),
    Rule("pu.entered-local-telemetry", ("<Initializing Game Telemetry>", "local player"), "PuEntered",
         ("gamerules", "loadDurationSeconds"), ("gamerules", "loadDurationSeconds")),
    Rule("disconnect.channel", ("<Channel Disconnected>",), "PuDisconnected",
         ("cause", "reason", "isRemote", "endpoint", "uptimeSeconds"), ("endpoint", "cause", "reason")),
    Rule("frontend.reason", ("RequestFrontEndReason",)),
    Rule("frontend.returned", ("<Channel Created>", "frontend"), "ReturnedToFrontend", ("reason",), ("reason",)),
    Rule("application.system-quit", ("<SystemQuit>",), "ApplicationExited", ("cause", "reason", "exitCode", "clean"),
         ("cause", "reason", "exitCode")),
    Rule("party.created", ("PartyCreated",), "PartyCreated", ("partyId", "leaderHandle"), ("partyId",), "medium"),
    Rule("party.notification-launch", (_N, "Party launch initiated."), "PartyLaunchInitiated",
         ("notificationId", "message"), ("notificationId", "message"), "medium"),
    Rule("party.notification-member-connected", (_N, " connected."), "PartyMemberConnected",
         ("notificationId", "memberHandle"), ("notificationId", "memberHandle"), "medium"),
    Rule("party.notification-member-joined", (_N, "New Member Joined", "has joined the party."), "PartyMemberJoined",
         ("notificationId", "memberHandle"), ("notificationId", "memberHandle")),
    Rule("party.left-local", ("<Leave group>", "Client ", " leave group "), "PartyLeft",
         ("partyId", "playerGeid", "reason"), ("partyId", "playerGeid", "reason")),
    Rule("mission.contract-accepted", (_N, "Contract Accepted:", "MissionId:"), "MissionAccepted",
         ("notificationId", "missionId", "contractName"), ("notificationId", "missionId")),
    Rule("shop.purchase-requested", ("SendShopBuyRequest",), "ShopPurchaseRequested",
         ("requestId", "itemName", "quantity", "shopName", "clientPrice"), ("requestId",), "medium"),
    Rule("zone.jurisdiction-entered", (_N, "Entered ", " Jurisdiction"), "JurisdictionEntered",
         ("notificationId", "jurisdiction"), ("notificationId", "jurisdiction"), drift=True),
    Rule("zone.monitored-entered", (_N, "Entered Monitored Space"), "MonitoredSpaceEntered", _STATE, _STATE, drift=True),
    Rule("zone.monitored-exited", (_N, "Exited Monitored Space"), "MonitoredSpaceExited", _STATE, _STATE, drift=True),
    Rule("zone.armistice-entered", (_N, "Entering Armistice Zone"), "ArmisticeStateChanged", _STATE, _STATE, drift=True),
    Rule("zone.armistice-left", (_N, "Leaving Armistice Zone"), "ArmisticeStateChanged", _STATE, _STATE, drift=True),
    Rule("vehicle.local-hangar-anchor",
         ("<CEntityComponentShipListProvider::SetVehicleSpawningInformations>", "VehicleEntityId:", "LandingArea:")),
    Rule("vehicle.control-released", ("<Vehicle Control Flow>", "Local client node", "releasing control token"),
         "VehicleControlReleased", _V, ("vehicleEntityId", "outcome")),
    Rule("vehicle.stored-correlated-removal",
         ("<CEntity::OnOwnerRemoved - entity attachment>", "UnattendedVehicleMarker_", "removal of parent"),
         "VehicleStored", _V, ("vehicleEntityId", "outcome")),
    Rule("quantum.target-selected-local", _Q, "QuantumTargetSelected",
         ("vehicleEntityId", "vehicleClassName", "targetObservedId"), ("vehicleEntityId", "targetObservedId")),
    Rule("quantum.target-changed-local", _Q, "QuantumTargetChanged",
         ("vehicleEntityId", "vehicleClassName", "previousTargetObservedId", "targetObservedId"),
         ("vehicleEntityId", "previousTargetObservedId", "targetObservedId")),
    Rule("quantum.final-arrival",
         ("<Quantum Drive Arrived - Arrived at Final Destination>", "OnQuantumDriveArrived", "arrived at final destination"),
         "QuantumTravelArrived", ("vehicleEntityId", "vehicleClassName", "targetObservedId"),
         ("vehicleEntityId", "targetObservedId")),
]

#: family -> anchors that must be seen once the family is active
FAMILY_ANCHORS: dict[str, list[str]] = {
    "build": ["FileVersion:", "ProductVersion:", "Branch:", "Changelist:"],
    "environment": ["<Init>", "<Game Version>"],
    "identity": ["<Legacy login response>"],
    "pu": ["<Join PU>"],
    "connection": ["<Channel Connection Complete>"],
    "mesh": ["<RegisterUniverseHierarchy_Begin>", "<RegisterUniverseHierarchy_End>"],
    "disconnect": ["<Channel Disconnected>"],
    "frontend": ["RequestFrontEndReason"],
    "application": ["<SystemQuit>"],
    "party": [_N],
    "mission": [_N],
    "shop": ["SendShopBuyRequest"],
    "zone": [_N],
    "vehicle": ["<CEntityComponentShipListProvider::SetVehicleSpawningInformations>", "<Vehicle Control Flow>"],
    "quantum": ["<Player Selected Quantum Target - Local>"],
}

# --- fixed values: captured signal vocabulary (id, marker, label) -----------------------------------------------------
SIGNALS: list[tuple[str, str, str]] = [
    ("INV-01", "Add Inventory Management Move", "Inventory operation requested"),
    ("INV-02", "Inventory Mgmt Request Handle", "Inventory request handling"),
    ("INV-02", "Inventory Mgmt Request Queued", "Inventory request queued"),
    ("INV-03", "Inventory Mgmt Request Process", "Inventory request processing"),
    ("INV-04", "Player Inventory Request Complete", "Player inventory request result"),
    ("INV-04", "Inventory Request Completed", "Inventory request completed"),
    ("INV-05", "Inventory Drop From Container", "Drop to ground requested"),
    ("INV-08", "UnstowPendingEntities", "Entity unstow finalized"),
    ("INV-09", "Close Inventory Grid", "Inventory grid closing"),
    ("INV-09", "Remove Inventory Container UI", "Inventory container removed from UI"),
    ("INV-11", "Query Inventory", "Inventory query activity"),
    ("INV-11", "Request Personal Inventory Data", "Personal inventory data activity"),
    ("INV-12", "Inventory Token Flow", "Inventory access-token activity"),
    ("INV-12", "Request Terminate Access To Inventory", "Inventory access termination"),
    ("INV-16", "AttachmentReceived", "Item attachment observed"),
    ("INV-17", "OnDragInventoryItemModifyTarget", "Inventory drag preview"),
    ("INV-18", "Update Container Items Add New Item", "Container UI item update"),
    ("INV-19", "Inventory Terminate Location Container", "Location inventory cache invalidated"),
    ("SHP-01", "CEntityComponentShopUIProvider::SendShopBuyRequest", "Shop purchase requested"),
    ("SHP-02", "CEntityComponentShopUIProvider::RmShopFlowResponse", "Shop buying response"),
    ("VEH-01", "OnRequestFetchVehicles", "Vehicle-list query activity"),
    ("VEH-02", "`anonymous-namespace'::BuildInventoryStowedAggregateRoots", "Vehicle inventory aggregate observed"),
    ("VEH-03", "VehicleListQuery", "Vehicle-list query completed"),
    ("LOAD-01", "UI - LoadoutEditor", "Loadout data activity"),
    ("SYS-01", "ReuseChannel", "Service channel reused"),
    ("ENV-01", "CSCLoadingPlatformManager::OnLoadingPlatformStateChanged", "Loading-platform state observed"),
    ("ENV-02", "CSCLoadingPlatformManager::LoadEntitiesReference", "Platform references loading"),
    ("ENV-02", "CSCLoadingPlatformManager::LoadEntitiesReference::<lambda_1>::operator ()", "Platform reference resolved"),
    ("ENV-03", "CSCLoadingPlatformManager::StopEffectForAllTags", "Platform effects stopping"),
    ("ENV-04", "CSCLoadingPlatformManager::TransitionLightGroupState", "Platform light-state activity"),
    ("DIA-01", "AggregateBindParentOutOfSync", "Attachment-parent desynchronization"),
    ("DIA-02", "[BuildingBlocks] Invalid Url", "UI category variable unavailable"),
    ("DIA-04", "LoadingPlatformUtilities::LoadFromXmlNode", "Platform XML child missing"),
    ("DIA-04", "CSCLoadingPlatformManager::loadEntityFromXML::<lambda_1>::operator ()", "Platform XML entity missing"),
    ("DIA-05", "DuplicatedItemPorts", "Duplicate attachment-port diagnostic"),
    ("DIA-06", "CreationRefusedEntity", "Entity creation refused"),
    ("DIA-07", "Failed attachment", "Attachment parent or port missing"),
    ("DIA-08", "Failed to attach to itemport, destroying entity", "Spawned-entity attachment cleanup"),
    ("NAV-01", "Local Route Guard - Server Rerouted", "Unattributed route-guard diagnostic"),
    ("ATC-01", "ATC_Reset_VehiclesBeingStoredCleared", "ATC storage-tracking reset"),
]
#: port -> (signal id, label) for item attachments
ATTACHMENT_PORTS = {
    "weapon_attach_hand_left": ("INV-13", "Item attached to left hand"),
    "helmethook_attach": ("INV-14", "Item attached to helmet hook"),
    "weapon_attach_hand_right": ("INV-15", "Item attached to right hand"),
    "inventory_pocket": ("INV-16", "Pocket attachment observed"),
    "inventory_pocket_2": ("INV-16", "Local pocket attachment observed"),
}
SIGNAL_OPERATIONS = ["Drop", "Move", "Interaction", "QueryInventory"]
SIGNAL_RULES = [
    Rule(f"captured.signal-{i}", (f"<{marker}>",), "RuntimeLogSignalObserved",
         ("signalId", "category", "label", "summary"), ("signalId", "summary"), markers=(marker,))
    for i, (_, marker, _) in enumerate(SIGNALS)
]
PTU_MARKERS = ["Player Inventory Request Complete", "Inventory Request Completed"]


#: names of the built-in rule sets
RULE_SETS = ("", "lifecycle", "captured", "captured-completions")


@dataclass(frozen=True)
class Profile:
    """Where a rule set applies. ``fixture_only`` profiles apply only when asked for by id."""

    profile_id: str
    version: str
    priority: int
    major: int
    minor: int
    channels: tuple[str, ...]
    branches: tuple[str, ...]
    tested_builds: tuple[str, ...]
    rules: str
    parser_version: str
    exclusions: tuple[str, ...] = ()
    universes: tuple[str, ...] = ("PU",)
    fixture_only: bool = False
    #: rules of its own, applied beside the rule set that ``rules`` names ("" for none)
    own: tuple[Rule, ...] = ()


# --- fixed values: reviewed profiles ----------------------------------------------------------------------------------
PROFILES: list[Profile] = [
    Profile("sc-4.9-live", "2026-10-26.1", 100, 4, 9, ("LIVE",),
            ("UNKNOWN", "sc-alpha-4.9.0", "sc-alpha-4.9-live-synth"),
            ("4.9.0-LIVE.9000000-SYNTH", "4.9.0-LIVE.9000000", "4.9.0-LIVE.12344265-SYNTH", "4.9.0-LIVE.12344265",
             "4.9.188.23497"),
            "lifecycle", "runtime-log-parser/0.2.0", ("4.9.999.0-BLOCKED-SYNTH",)),
    Profile("sc-4.9-cross-env", "2026-10-26.1", 90, 4, 9, ("LIVE", "PTU", "EPTU", "HOTFIX"), ("UNKNOWN",),
            ("4.9.0-MULTI.9000000-SYNTH", "4.9.0-LIVE.9000000-SYNTH", "4.9.0-PTU.9000000-SYNTH"),
            "lifecycle", "runtime-log-parser/0.2.0", fixture_only=True),
    Profile("sc-4.10-live", "2026-10-29.2", 95, 4, 10, ("LIVE",), ("UNKNOWN", "sc-alpha-4.10.2"), ("4.10.197.2878",),
            "captured", "runtime-log-parser/0.3.1"),
    Profile("sc-4.10-ptu", "2026-11-02.1", 95, 4, 10, ("PTU",), ("UNKNOWN", "sc-alpha-4.10.2"), ("4.10.199.13454",),
            "captured-completions", "runtime-log-parser/0.3.1"),
]


#: how a field of a rule is read from the text of a record
EXTRACTORS: dict[str, Callable[[Column, str], Column]] = {
    "bracket": bracket,
    "keyed": keyed,
    "quoted": quoted,
    "integer": lambda text, key: to_integer(F.coalesce(bracket(text, key), keyed(text, key))),
    "boolean": lambda text, key: to_boolean(F.coalesce(bracket(text, key), keyed(text, key))),
    "constant": lambda text, key: F.lit(key),
}


def check_profiles(profiles: Sequence[Profile], event_fields: Mapping[str, Collection[str]]) -> list[str]:
    """What is wrong with profiles that a caller brings; nothing, if the list is empty.

    Ids are unique; a profile has channels and builds it was tested with; each of its own rules has literals, an id of the form ``family.name``
    that no other rule of the call has, a known event type, known extractors, and fields that the event type has, all required ones among them.
    """
    wrong: list[str] = []
    ids = [p.profile_id for p in profiles]
    wrong += [f"{i}: duplicate_profile" for i in sorted({i for i in ids if ids.count(i) > 1})]
    taken = {r.rule_id for r in [*LIFECYCLE_RULES, *SIGNAL_RULES]}
    for p in profiles:
        wrong += [f"{p.profile_id}: missing_{n}" for n, v in (("channels", p.channels), ("tested_builds", p.tested_builds)) if not v]
        wrong += [f"{p.profile_id}: unknown_rule_set {p.rules}"] * (p.rules not in RULE_SETS)
        for r in p.own:
            at = f"{p.profile_id}/{r.rule_id}"
            wrong += [f"{at}: duplicate_rule"] * (r.rule_id in taken) + [f"{at}: rule_without_family"] * ("." not in r.rule_id)
            wrong += [f"{at}: rule_without_literals"] * (not r.literals or not all(r.literals))
            taken.add(r.rule_id)
            if r.event_type is None:
                continue
            if r.event_type not in event_fields:
                wrong.append(f"{at}: unknown_event_type {r.event_type}")
                continue
            read = {name for name, _, _ in r.fields}
            wrong += [f"{at}: unknown_extractor {kind}" for _, kind, _ in r.fields if kind not in EXTRACTORS]
            wrong += [f"{at}: unknown_field {f}" for f in sorted(read - set(event_fields[r.event_type]))]
            wrong += [f"{at}: field_never_read {f}" for f in [*r.required, *r.dedupe] if f not in read]
    return wrong


def profiles_table(spark: SparkSession, profiles: Sequence[Profile] = tuple(PROFILES)) -> DataFrame:
    return spark.createDataFrame(
        [
            (p.profile_id, p.version, p.priority, p.major, p.minor, list(p.channels), list(p.universes), list(p.branches),
             list(p.tested_builds), list(p.exclusions), p.rules, p.parser_version, p.fixture_only)
            for p in profiles
        ],
        "profile_id string, version string, priority int, major int, minor int, channels array<string>,"
        " universes array<string>, branches array<string>, tested_builds array<string>, exclusions array<string>,"
        " rule_set string, parser_version string, fixture_only boolean",
    )


def rules_table(spark: SparkSession, rules: Sequence[Rule], profile_id: str = "") -> DataFrame:
    return spark.createDataFrame(
        [(profile_id, r.rule_id, r.family, r.event_type, list(r.literals), list(r.required), list(r.dedupe), r.confidence,
          r.drift) for r in rules],
        "profile_id string, rule_id string, family string, event_type string, literals array<string>,"
        " required array<string>, dedupe array<string>, confidence string, drift boolean",
    )


# --- dispatch ---------------------------------------------------------------------------------------------------------
def _quote(literal: str) -> str:
    if "'" in literal and '"' in literal:
        return " || ".join(_quote(x) for x in re.split("(')", literal) if x)
    return f"r'{literal}'" if "'" not in literal else f'r"{literal}"'


def matching_rules(text: str, rules: Sequence[Rule]) -> Column:
    """Ids of the rules whose literals all occur in the text column, in rule order.

    The rule table is compiled into one expression of substring tests; there is no join, and no lambda, inside which Spark would
    interpret the tests instead of compiling them.
    """
    tests = [
        f"if({' and '.join(f'contains(`{text}`, {_quote(x)})' for x in r.literals)}, {_quote(r.rule_id)}, '')" for r in rules
    ]
    return F.expr(f"array_remove(array({', '.join(tests)}), '')") if tests else F.array().cast("array<string>")


def dispatch(records: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per (record, candidate rule)."""
    return records.withColumn("_rules", matching_rules("text", rules)).select(
        *records.columns, F.explode("_rules").alias("rule_id")
    )


def anchor_coverage(
    records: DataFrame, rules: Sequence[Rule], keys: list[str], anchors: dict[str, list[str]] | None = None
) -> DataFrame:
    """Per key: families with a matched rule, their required anchors, and whether each anchor was seen.

    One pass: every anchor and family is a boolean aggregate, so nothing but counters is shuffled.
    """
    table = anchors or FAMILY_ANCHORS
    pairs = [(f, a) for f, xs in table.items() for a in xs]
    text = F.col("text")
    active = {f: F.max(F.size(matching_rules("text", [r for r in rules if r.family == f])) > 0) for f in table}
    agg = records.groupBy(*keys).agg(
        *[v.alias(f"_f{i}") for i, v in enumerate(active.values())],
        *[F.max(F.contains(text, F.lit(a))).alias(f"_a{i}") for i, (_, a) in enumerate(pairs)],
    )
    index = {f: i for i, f in enumerate(active)}
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("family"), F.lit(a).alias("anchor"), F.col(f"_a{i}").alias("seen"),
                F.col(f"_f{index[f]}").alias("active"),
            )
            for i, (f, a) in enumerate(pairs)
        ]
    )
    return agg.select(*keys, F.inline(rows)).where("active").drop("active")


def suppress_drifted(candidates: DataFrame, scope: list[str], position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Split candidates at the first failure of a drift-flagged rule of the same scope and family.

    ``scope`` names lane and environment epoch; columns ``family``, ``drift`` and ``failed`` are expected. The first
    failing position is a partial aggregate, so the candidates are only joined with one row per failing family.
    """
    keys = [*scope, "family"]
    first = (
        candidates.where(F.col("drift") & F.col("failed"))
        .groupBy(*keys)
        .agg(F.min(position).alias("_first_failure"))
    )
    marked = candidates.join(first, keys, "left")
    late = F.coalesce(F.col(position) > F.col("_first_failure"), F.lit(False))
    return marked.where(~late).drop("_first_failure"), marked.where(late).drop("_first_failure")


def health_verdict(
    records: Column,
    unknown: Column,
    compatible: Column,
    incompatible_reason: Column,
    drifted: Column,
    min_records: int = DRIFT_MIN_RECORDS,
    min_unknown: int = DRIFT_MIN_UNKNOWN,
    ratio: float = DRIFT_RATIO,
) -> Column:
    """``struct(status, reason, ratio)`` of one environment."""
    share = F.when(records > 0, unknown / records).otherwise(F.lit(0.0))
    noisy = (records >= min_records) & (unknown >= min_unknown) & (share >= ratio)
    ok = compatible == "compatible"
    return F.struct(
        F.when(~ok, compatible).when(drifted | noisy, "suspected_drift").otherwise("compatible").alias("status"),
        F.when(~ok, incompatible_reason)
        .when(drifted, "event_family_field_shape_changed")
        .when(noisy, "high_unknown_ratio")
        .otherwise("profile_compatible")
        .alias("reason"),
        F.round(share, 6).alias("ratio"),
    )


def funnel(records: DataFrame, rules: Sequence[Rule], keys: list[str]) -> DataFrame:
    """Records, literal checks, rule evaluations and unmatched records per key, in one aggregation."""
    checks = sum(len(r.literals) for r in rules)
    hits = F.size(matching_rules("text", rules))
    return (
        records.select(*keys, hits.alias("_hits"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("records"),
            (F.count(F.lit(1)) * checks).alias("literal_checks"),
            F.sum("_hits").alias("evaluations"),
            F.count_if(F.col("_hits") == 0).alias("unknown_records"),
        )
    )
