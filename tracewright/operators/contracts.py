"""The event contract: payload fields per event type, envelope, validation, identity and conflict handling."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.constants import CONFIDENCE, CONTRACT_VERSION, FORBIDDEN_KEYS, PROVENANCE, RELEASE_CHANNELS
from tracewright.functions.identity import event_id, order_key, scoped_id
from tracewright.functions.instants import iso_ms
from tracewright.functions.text import to_number

# --- fixed values: payload fields. "?" nullable, "int>=1" bounds, "str(a|b)" closed vocabulary, "str<=96" max length ----
_CHANNEL = "str(" + "|".join([*RELEASE_CHANNELS, "UNKNOWN"]) + ")"
_VEHICLE = {
    "vehicleEntityId": "str",
    "vehicleClassName": "str",
    "vehicleDisplayName": "str",
    "relationship": "str(hangar|controlled)",
    "outcome": "str(retrieved|acquired|released|stored)",
}
_METHOD = "str(automatic|user_selected|restored_setting)"
PAYLOADS: dict[str, dict[str, str]] = {
    "RuntimeLogSignalObserved": {
        "signalId": "str", "category": "str(action|vehicle|runtime|diagnostic)", "label": "str<=96", "summary": "str<=600",
        "requestId": "str<=24?", "operation": "str?", "itemClass": "str?", "quantity": "int>=0?", "clientPrice": "num>=0?",
        "shopName": "str?", "kioskState": "str?", "result": "str?", "elapsedSeconds": "num>=0?", "attachmentPort": "str?",
    },
    "RuntimeSourceDiscovered": {
        "sourceLocation": "str", "sourceKind": "str(game_log)", "discoveryMethod": _METHOD, "supported": "bool",
    },
    "RuntimeSourceSelected": {"sourceLocation": "str", "selectionMethod": _METHOD},
    "RuntimeMonitorStarted": {
        "sourceLocation": "str", "startMode": "str(from_current_end|from_checkpoint|from_beginning)",
    },
    "RuntimeMonitorStopped": {
        "sourceLocation": "str", "reason": "str(user_requested|source_changed|application_shutdown|runtime_error)",
    },
    "RuntimeSourceUnavailable": {
        "sourceLocation": "str", "reason": "str(missing|permission_denied|locked|rotated|unsupported)",
        "recoverable": "bool",
    },
    "ParserCompatibilityStatusObserved": {
        "status": "str(compatible|unverified_build|unsupported_profile|suspected_drift)", "profileId": "str",
        "profileVersion": "str", "reason": "str", "recordsSeen": "int>=0", "knownEventsEmitted": "int>=0",
        "unknownRecords": "int>=0", "unknownSampleCount": "int>=0", "droppedUnknownSamples": "int>=0",
    },
    "ParserDriftSuspected": {
        "profileId": "str", "profileVersion": "str", "reason": "str", "recordsSeen": "int>=0",
        "knownEventsEmitted": "int>=0", "unknownRecords": "int>=0", "unknownRatio": "num>=0<=1",
    },
    "ClientBuildObserved": {"fileVersion": "str", "productVersion": "str", "branch": "str", "changelist": "str"},
    "ReleaseEnvironmentObserved": {
        "releaseChannel": _CHANNEL, "environmentName": "str", "config": "str", "sourceLocation": "str",
    },
    "GameDataVersionObserved": {
        "gameVersion": "str", "dataCoreVersion": "str", "archetypeVersion": "str", "componentVersion": "str",
    },
    "LoginStarted": {"loginSessionId": "str", "releaseChannel": _CHANNEL},
    "AccountAuthenticated": {"handle": "str", "accountId": "str"},
    "IdentityObserved": {
        "characterName": "str", "accountId": "str", "characterGeid": "str", "playerGeid": "str", "nodeId": "str",
        "clientSession": "str",
    },
    "MatchmakingStatusObserved": {"matchmakingRequestId": "str", "matchmakingStatus": "str", "port": "int>=1<=65535"},
    "PuJoinRequested": {
        "matchmakingRequestId": "str", "shard": "str", "endpoint": "str", "port": "int>=1<=65535", "locationId": "str",
    },
    "PuReplicationConnectionEstablished": {
        "endpoint": "str", "port": "int>=1<=65535", "observedNodeId": "str", "playerGeid": "str", "gamerules": "str",
        "hostType": "str(Replicant)",
    },
    "UniverseHierarchyRegistered": {"receivedFromNetwork": "bool", "nodeCount": "int>=1", "durationMs": "int>=0"},
    "PuTerritorySetupCompleted": {
        "gamerules": "str(SC_Default)", "status": "str(Finished)", "runningTimeSeconds": "num>=0",
    },
    "PuEntered": {"gamerules": "str", "loadDurationSeconds": "num>=0"},
    "PuDisconnected": {"cause": "str", "reason": "str", "isRemote": "bool", "endpoint": "str", "uptimeSeconds": "num>=0"},
    "ReturnedToFrontend": {"reason": "str"},
    "ApplicationExited": {"cause": "str", "reason": "str", "exitCode": "int", "clean": "bool"},
    "PartyCreated": {"partyId": "str", "leaderHandle": "str"},
    "PartyLaunchInitiated": {"notificationId": "str", "message": "str"},
    "PartyMemberConnected": {"notificationId": "str", "memberHandle": "str"},
    "PartyMemberJoined": {"notificationId": "str", "memberHandle": "str"},
    "PartyLeft": {"partyId": "str", "playerGeid": "str", "reason": "str(voluntary_leave)"},
    "MissionAccepted": {"notificationId": "str", "missionId": "str", "contractName": "str"},
    "ShopPurchaseRequested": {
        "requestId": "str", "itemName": "str", "quantity": "int>=1", "shopName": "str", "clientPrice": "num>=0",
    },
    "JurisdictionEntered": {"notificationId": "str", "jurisdiction": "str"},
    "MonitoredSpaceEntered": {"notificationId": "str", "state": "str(entered)"},
    "MonitoredSpaceExited": {"notificationId": "str", "state": "str(exited)"},
    "ArmisticeStateChanged": {"notificationId": "str", "state": "str(entered|left)"},
    "VehicleRetrieved": _VEHICLE,
    "VehicleControlAcquired": _VEHICLE,
    "VehicleControlReleased": _VEHICLE,
    "VehicleStored": _VEHICLE,
    "QuantumTargetSelected": {"vehicleEntityId": "str", "vehicleClassName": "str", "targetObservedId": "str"},
    "QuantumTargetChanged": {
        "vehicleEntityId": "str", "vehicleClassName": "str", "previousTargetObservedId": "str", "targetObservedId": "str",
    },
    "QuantumTravelArrived": {"vehicleEntityId": "str", "vehicleClassName": "str", "targetObservedId": "str"},
}
_PERSONAL = ["LoginStarted", "AccountAuthenticated", "IdentityObserved", "MissionAccepted"]
TYPE_SENSITIVITY = {
    t: "social"
    if t.startswith("Party")
    else "personal"
    if t in _PERSONAL or t.startswith(("Vehicle", "Quantum"))
    else "local"
    for t in PAYLOADS
}
#: correlation name -> (namespace, payload fields); later fields of a tuple are fallbacks
CORRELATIONS: dict[str, tuple[str, list[tuple[str, ...]]]] = {
    "loginSessionId": ("login_session", [("loginSessionId",)]),
    "localAccountId": ("local_account", [("accountId",)]),
    "clientSessionId": ("client_session", [("clientSession",)]),
    "matchmakingRequestId": ("matchmaking_request", [("matchmakingRequestId",)]),
    "replicationConnectionId": (
        "replication_connection",
        [("endpoint",), ("port",), ("observedNodeId",), ("gamerules",), ("hostType",)],
    ),
    "partyId": ("party", [("partyId",)]),
    "notificationId": ("notification", [("notificationId",)]),
    "buildFingerprintId": (
        "build_fingerprint",
        [
            ("fileVersion", "gameVersion"),
            ("productVersion", "dataCoreVersion"),
            ("branch", "archetypeVersion"),
            ("changelist", "componentVersion"),
        ],
    ),
}


def _spec(text: str) -> dict:
    import re

    m = re.fullmatch(r"(str|int|num|bool)(?:\(([^)]*)\))?(?:>=([\d.]+))?(?:<=([\d.]+))?(\?)?", text)
    kind, words, low, high, nullable = m.groups()
    return {
        "kind": kind,
        "words": words.split("|") if words else None,
        "low": float(low) if low else None,
        "high": float(high) if high and kind != "str" else None,
        "max_length": int(high) if high and kind == "str" else None,
        "nullable": bool(nullable),
    }


def event_types(spark: SparkSession) -> DataFrame:
    """Dimension table: one row per (event_type, field) with its constraints and the type's sensitivity."""
    rows = []
    for event_type, fields in PAYLOADS.items():
        for name, text in fields.items():
            s = _spec(text)
            rows.append(
                (event_type, TYPE_SENSITIVITY[event_type], name, s["kind"], s["words"], s["low"], s["high"],
                 s["max_length"], s["nullable"])
            )
    return spark.createDataFrame(
        rows,
        "event_type string, sensitivity string, field string, kind string, words array<string>, low double, high double,"
        " max_length int, nullable boolean",
    )


def missing_fields(payload: Column, required: Column) -> Column:
    """Required payload fields that are absent or empty."""
    return F.filter(required, lambda f: F.coalesce(F.try_element_at(payload, f), F.lit("")) == "")


def require_fields(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split candidates with ``payload`` and ``required`` into complete ones and diagnostics with the ``missing`` list."""
    lacking = missing_fields(F.col("payload"), F.col("required"))
    tagged = events.withColumn("missing", lacking)
    return tagged.where(F.size("missing") == 0).drop("missing"), tagged.where(F.size("missing") > 0)


_SPEC = (
    "map<string,array<struct<field:string,kind:string,words:array<string>,low:double,high:double,max_length:int,"
    "nullable:boolean>>>"
)


def _registry(names: list[str]) -> Column:
    """The contract as one constant: event type -> field specifications."""
    table = {
        t: [{"field": n, **{k: v if k != "words" else v or [] for k, v in _spec(text).items()}} for n, text in PAYLOADS[t].items()]
        for t in names
    }
    return F.from_json(F.lit(json.dumps(table)), _SPEC)


def _field_error(payload: Column, s: Column) -> Column:
    """Error code of one field bound to its ``value``, null when fine. The checks of a field exclude each other."""
    value = s["value"]
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    absent_ok = s["nullable"] & value.isNull()
    text, flag, whole = s["kind"] == "str", s["kind"] == "bool", s["kind"] == "int"
    number = to_number(value)
    integral = (number == F.floor(number)) & (F.abs(number) <= 9007199254740991)
    listed = (F.size(s["words"]) == 0) | F.array_contains(s["words"], value)
    code = (
        F.when(~F.map_contains_key(payload, s["field"]), "missing_payload_field")
        .when(absent_ok, F.lit(None).cast("string"))
        .when(
            text,
            F.when(blank, "invalid_payload_string")
            .when(F.length(value) > s["max_length"], "payload_string_too_long")
            .when(~listed, "invalid_payload_enum"),
        )
        .when(flag, F.when(~F.coalesce(value.isin("true", "false"), F.lit(False)), "invalid_payload_boolean"))
        .when(number.isNull() & whole, "invalid_payload_integer")
        .when(number.isNull(), "invalid_payload_number")
        .when(whole & ~integral, "invalid_payload_integer")
        .when(number < s["low"], "payload_number_too_small")
        .when(number > s["high"], "payload_number_too_large")
    )
    return F.concat(code, F.lit(":payload."), s["field"])


def contract_errors(event_type: Column, payload: Column, provenance: Column, confidence: Column, contributors: Column,
                    types: list[str] | None = None) -> Column:
    """Error codes of an event as a sorted array; empty when it satisfies the contract.

    The registry is a constant of the expression, so validating needs no join and one generic check per field.
    """
    names = types or list(PAYLOADS)
    none = F.array().cast("array<string>")
    fields = F.try_element_at(_registry(names), event_type)
    bound = F.transform(fields, lambda s: s.withField("value", F.try_element_at(payload, s["field"])))
    found = F.array_compact(F.transform(bound, lambda s: _field_error(payload, s)))
    extra = F.transform(
        F.array_except(F.map_keys(payload), F.transform(fields, lambda s: s["field"])),
        lambda k: F.concat(F.lit("unknown_payload_field:payload."), k),
    )
    general = F.array_compact(
        F.array(
            F.when(fields.isNull(), F.lit("unknown_event_type:event_type")),
            F.when(~F.coalesce(provenance.isin(*PROVENANCE), F.lit(False)), F.lit("invalid_enum:provenance")),
            F.when(~F.coalesce(confidence.isin(*CONFIDENCE), F.lit(False)), F.lit("invalid_enum:confidence")),
            F.when((provenance == "inferred") & (F.coalesce(F.size(contributors), F.lit(0)) <= 0),
                   F.lit("missing_contributors:derivation")),
            F.when(F.arrays_overlap(F.map_keys(payload), F.array(*[F.lit(k) for k in FORBIDDEN_KEYS])),
                   F.lit("raw_evidence_forbidden:payload")),
        )
    )
    return F.array_sort(F.concat(general, F.coalesce(found, none), F.coalesce(extra, none)))


def validate_events(events: DataFrame, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split events into valid ones and rejected ones with their ``errors``."""
    checked = events.withColumn(
        "errors",
        contract_errors(F.col("event_type"), F.col("payload"), F.col("provenance"), F.col("confidence"),
                        F.col("contributors"), types),
    )
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def payload_hash(payload: Column) -> Column:
    """Hash of a payload map that ignores entry order."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(payload))), 256)


def correlation_ids(environment: Column, event_type: Column, payload: Column, dedupe_id: Column) -> Column:
    """Scoped correlation ids of an event; entries whose parts are missing are left out."""
    pairs: list[Column] = [
        F.lit("environmentSessionId"), scoped_id(environment, "environment_session", [F.lit("runtime-log-parser")]),
        F.lit("eventDedupeId"), dedupe_id,
        F.lit("eventFamilyId"), scoped_id(environment, "event_family", [event_type]),
    ]
    for name, (namespace, fields) in CORRELATIONS.items():
        parts = [
            F.coalesce(*[F.nullif(F.try_element_at(payload, F.lit(f)), F.lit("")) for f in options]) for options in fields
        ]
        complete = parts[0].isNotNull()
        for p in parts[1:]:
            complete = complete & p.isNotNull()
        pairs += [F.lit(name), F.when(complete, scoped_id(environment, namespace, parts))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def resolve_conflicts(candidates: DataFrame, keys: list[str], rule: str = "rule_id") -> tuple[DataFrame, DataFrame]:
    """Per record and type: differing payloads are all dropped and reported, equal ones collapse to the lowest rule id.

    Only the smallest and the largest payload hash are carried through the aggregation, so the group state has a fixed
    size however many candidates a record has.
    """
    rest = [c for c in candidates.columns if c not in keys]
    grouped = (
        candidates.withColumn("_hash", payload_hash(F.col("payload")))
        .groupBy(*keys)
        .agg(
            F.min("_hash").alias("_lo"),
            F.max("_hash").alias("_hi"),
            F.count(F.lit(1)).alias("matches"),
            F.min_by(F.struct(*rest), rule).alias("_row"),
        )
    )
    same = F.col("_lo") == F.col("_hi")
    kept = grouped.where(same).select(*keys, "_row.*")
    return kept, grouped.where(~same).select(*keys, "matches")


def envelope(events: DataFrame) -> DataFrame:
    """Add contract version, sensitivity, correlation ids, event id and order key.

    Expects environment_key, event_type, payload, dedupe_id, ts_ms, source_id, generation, byte_offset, line_no,
    profile_id, profile_version, parser_version, provenance, confidence.
    """
    sensitivity = F.lit("local")
    for level in ("personal", "social"):
        sensitivity = F.when(
            F.col("event_type").isin(*[t for t, s in TYPE_SENSITIVITY.items() if s == level]), level
        ).otherwise(sensitivity)
    out = events.withColumns(
        {
            "contract_version": F.lit(CONTRACT_VERSION),
            "source_timestamp": iso_ms(F.col("ts_ms")),
            "sensitivity": sensitivity,
            "sync_policy": F.lit("never"),
            "correlation_ids": correlation_ids(
                F.col("environment_key"), F.col("event_type"), F.col("payload"), F.col("dedupe_id")
            ),
        }
    )
    identity = [
        F.col("contract_version"), F.col("event_type"), F.col("environment_key"), F.col("source_id"),
        F.col("profile_id"), F.col("profile_version"), F.col("parser_version"), F.col("ts_ms"), F.col("line_no"),
        F.to_json(F.array_sort(F.map_entries("correlation_ids"))), F.to_json(F.array_sort(F.map_entries("payload"))),
    ]
    named = out.withColumn("event_id", event_id(identity))
    return named.withColumn(
        "order_key",
        order_key(F.col("ts_ms"), F.col("line_no"), F.col("generation"), F.col("byte_offset"), F.col("event_id")),
    )


def typed_view(events: DataFrame, event_type: str) -> DataFrame:
    """Events of one type with the payload as typed columns."""
    kinds = {"str": "string", "int": "bigint", "num": "double", "bool": "boolean"}
    cols = [
        F.try_element_at(F.col("payload"), F.lit(n)).try_cast(kinds[_spec(t)["kind"]]).alias(n)
        for n, t in PAYLOADS[event_type].items()
    ]
    return events.where(F.col("event_type") == event_type).select(
        *[c for c in events.columns if c != "payload"], F.struct(*cols).alias("payload")
    )


def with_variant(events: DataFrame) -> DataFrame:
    """Payload as VARIANT for the shared table."""
    return events.withColumn("payload", F.try_parse_json(F.to_json("payload")))
