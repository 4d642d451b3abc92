"""Logs of an invented client through the whole parse: rule families, cuts, environments, drift, and profiles that a caller brings."""

from dataclasses import replace
from datetime import UTC, datetime, timedelta
from functools import partial

import pytest
from pyspark.sql import functions as F

from tracewright.functions.instants import parse_instant, with_log_instant
from tracewright.functions.text import normalize_record, notification
from tracewright.operators import emission, framing, health
from tracewright.operators.rules import LIFECYCLE_RULES, Profile, Rule, matching_rules
from tracewright.plans.scans import CHUNK, Lane, split_offsets
from tracewright.plans.settle import settle

DAY = datetime(2031, 3, 4, tzinfo=UTC)
BUILD = "7.3.12.555"
OURS = Profile("seven-three", "r1", 10, 7, 3, ("LIVE",), ("dev-trunk",), (BUILD,), "lifecycle", "seven/1")
NOTE = '[Notice] <SHUDEvent_OnNotification> Added notification "{}: " [{}] to queue. New queue size: 3, MissionId: [{}]'


def log(*rows: tuple[str, str]) -> str:
    """One stamped line per (clock, text); a text may hold continuation lines."""
    return "".join(f"<{DAY:%Y-%m-%d}T{clock}Z> {text}\n" for clock, text in rows)


def note(message: str, number: int, mission: str = "none") -> str:
    return NOTE.format(message, number, mission)


def pick(target: str, vehicle: str = "ARGO_Mole[88]") -> str:
    told = f"Player has selected point {target} as their destination, routing locally"
    return f"<Player Selected Quantum Target - Local> OnPlayerSelectedQuantumTarget | NOT AUTH | {vehicle}| {told}"


START = log(
    ("06:00:00.000", "Branch: dev-trunk"),
    ("06:00:00.001", f"ProductVersion: {BUILD}"),
    ("06:00:00.002", f"FileVersion: {BUILD}"),
    ("06:00:00.500", "Changelist: 424242"),
    ("06:00:02.250", f"<Game Version> version[{BUILD}] environment[LIVE]"),
    ("06:00:03.750", "<SetDatabaseVersion> dataCore[core-a] archetype[arch-b] component[comp-c]"),
    ("06:00:04.125", "<Init> Environment[PUB] Tag[LIVE] Config[Release] SourcePath[/games/LIVE/today.log]"),
)
#: a party is met and left before the world is entered; one trip with a change of mind; a vehicle of someone else nearby
STORY = START + log(
    ("06:10:00.000", "<InitiateLogin> LoginSessionId: login-7 releaseChannel[LIVE]"),
    ("06:10:03.000", "<Legacy login response> status[Success] handle[Quill] accountId[5150]"),
    ("06:10:04.000", "<AccountLoginCharacterStatus_Character> name Quill accountId 5150 geid 60601 state Active"),
    ("06:10:05.000", '<Expect Incoming Connection> nickname="Quill" playerGEID=70707 node_id=node-1 session=sess-9'),
    ("06:12:00.000", '[Notice] <SHUDEvent_OnNotification> Added notification "New Member Joined\n'
                     f"<{DAY:%Y-%m-%d}T06:12:00.000Z> Bramble has joined the party.: \" [4] to queue. New queue size: 1, MissionId: [none]"),
    ("06:13:00.000", "[Notice] <Leave group> Client 31313 leave group crew-2 [Team]"),
    ("06:13:09.000", "[Notice] <Leave group> Client 70707 leave group crew-2 [Team]"),
    ("06:20:00.000", "{Join PU} id[match-3] status[Ready] port[51515]"),
    ("06:20:01.500", "<Join PU> address[east.example.test] port[51515] shard[east_04] locationId[harbour]"),
    ("06:20:04.000", '<Channel Created> hostType="Replicant" remoteAddr=east.example.test:51515 playerGEID=70707 node_id=node-8 session=sess-9'),
    ("06:20:06.000", '<Channel Connection Complete> hostType="Replicant" remoteAddr=east.example.test:51515 gamerules="SC_Default" node_id=node-8'),
    ("06:20:08.000", '[Notice] <RegisterUniverseHierarchy_Begin> bNetRecvd="1" nodeCount="31"'),
    ("06:20:08.640", "[Notice] <RegisterUniverseHierarchy_End> [Team]"),
    ("06:20:09.000", '[Notice] <ContextEstablisherTaskFinished> taskname="SetupTerritories" gamerules="SC_Default" status="Finished" runningTime=0.25'),
    ("06:20:10.000", "[Notice] <[GameRules] GameRulesActionEvent_GameModeCreated> Game mode created"),
    ("06:20:13.500", "[Notice] <Initializing Game Telemetry> Initializing game telemetry component of local player"),
    ("06:20:14.500", "[Notice] <Initializing Game Telemetry> Initializing game telemetry component of local player"),
    ("06:30:00.000", note("Entered Monitored Space", 11)),
    ("06:31:00.000", note("Contract Accepted:  Haul the crates", 12, "job-77")),
    ("06:40:00.000", "<CEntityComponentShipListProvider::SetVehicleSpawningInformations> q - VehicleEntityId: [88], LandingArea: Quill's Hangar"),
    ("06:41:00.000", pick("Relay-East")),
    ("06:41:30.000", pick("Relay-North")),
    ("06:41:45.000", pick("Relay-North", "MISC_Hull[99]")),
    ("06:50:00.000", "<Quantum Drive Arrived - Arrived at Final Destination> OnQuantumDriveArrived | NOT AUTH | ARGO_Mole[88]| arrived at final destination"),
    ("06:55:00.000", "[Notice] <Vehicle Control Flow> q: Local client node [5] releasing control token for 'ARGO_Mole_88' [88]"),
    ("06:55:40.000", "[Notice] <CEntity::OnOwnerRemoved - entity attachment> id = 3 name = UnattendedVehicleMarker_3 to unblock removal of "
                     "parent id = 88 name = ARGO_Mole_88"),
    ("07:05:00.000", '<Channel Disconnected> cause=7 reason="done for today" isRemote=0 gamerules="SC_Default" '
                     "remoteAddr=east.example.test:51515 uptime_secs=2694.5"),
    ("07:05:03.000", 'RequestFrontEndReason="Leaving"'),
    ("07:05:04.000", "<Channel Created> remoteAddr=frontend.example.test:40404 playerGEID=70707 node_id=node-0 session=none"),
    ("07:06:00.000", "<SystemQuit> cause=user, reason=menu, exitCode=0"),
)


def parse(spark, logs, defaults=None, profiles=(OURS,)):
    raw = spark.createDataFrame([(s, 0, t) for s, t in logs.items()], "source_id string, generation bigint, text string")
    records = framing.records_of(framing.drop_empty(framing.frame_lines(raw)))
    return emission.parse_records(records, spark, defaults, profiles=profiles)


@pytest.fixture(scope="module")
def table(spark):
    """Events of the story, and of the same story on a channel that the profile does not cover."""
    elsewhere = STORY.replace("Tag[LIVE]", "Tag[PTU]").replace("environment[LIVE]", "environment[PTU]")
    return settle(parse(spark, {"own": STORY, "ptu": elsewhere}, {"channel": "LIVE"}).events)


@pytest.fixture(scope="module")
def events(table):
    return table.where("source_id = 'own'").orderBy("byte_offset", "event_type").collect()


def test_each_step_of_the_story_is_one_event(events):
    steps = {
        "start": ["ClientBuildObserved", "GameDataVersionObserved", "ReleaseEnvironmentObserved"],
        "login": ["LoginStarted", "AccountAuthenticated", "IdentityObserved"],
        "party": ["PartyMemberJoined", "PartyLeft"],
        "enter": ["MatchmakingStatusObserved", "PuJoinRequested", "PuReplicationConnectionEstablished", "UniverseHierarchyRegistered",
                  "PuTerritorySetupCompleted", "PuEntered"],
        "work": ["MonitoredSpaceEntered", "MissionAccepted"],
        "trip": ["QuantumTargetSelected", "VehicleControlAcquired", "VehicleRetrieved", "QuantumTargetChanged", "QuantumTravelArrived",
                 "VehicleControlReleased", "VehicleStored"],
        "leave": ["PuDisconnected", "ReturnedToFrontend", "ApplicationExited"],
    }
    assert [e.event_type for e in events] == [t for part in steps.values() for t in part]
    assert {e.profile_id for e in events} == {"seven-three"} and {e.build for e in events} == {BUILD}


def test_payloads_that_join_several_lines(events):
    by = {e.event_type: e.payload for e in events}
    assert by["PuJoinRequested"]["matchmakingRequestId"] == "match-3"
    assert by["PuReplicationConnectionEstablished"]["playerGeid"] == "70707"
    assert by["UniverseHierarchyRegistered"]["durationMs"] == "640"
    assert by["PuEntered"]["loadDurationSeconds"] == "12"
    assert by["QuantumTargetChanged"]["previousTargetObservedId"] == "Relay-East"
    assert by["VehicleStored"]["vehicleDisplayName"] == "ARGO Mole"
    assert by["ReturnedToFrontend"]["reason"] == "Leaving"
    assert by["PartyMemberJoined"] == {"notificationId": "4", "memberHandle": "Bramble"}
    assert by["PartyLeft"]["partyId"] == "crew-2" and by["PartyLeft"]["playerGeid"] == "70707"


def test_contributors_point_at_events(table):
    own = table.where("source_id = 'own'")
    rows = {r.event_type: r for r in emission.resolve_contributors(own).collect()}
    for later, earlier in (("QuantumTravelArrived", "QuantumTargetChanged"), ("VehicleStored", "VehicleControlReleased")):
        assert rows[later].contributors == [rows[earlier].event_id]


def test_a_channel_without_profile_emits_nothing(table):
    # the default channel holds until the line that names another one
    assert table.where((F.col("source_id") == "ptu") & (F.col("line_no") > 5)).count() == 0


def test_records_do_not_depend_on_the_cut(spark):
    raw = spark.createDataFrame([("own", 0, STORY)], "source_id string, generation bigint, text string")
    lines = settle(framing.drop_empty(framing.frame_lines(raw)))
    whole, *others = [
        framing.records_of(lines, **how).orderBy("byte_offset").collect() for how in ({}, {"chunk_bytes": 333}, {"chunk_bytes": 1500})
    ]
    # the two lines of the party notice are one record
    assert len(whole) == STORY.count("\n") - 1 and all(o == whole for o in others)


BROKEN = "[Notice] <SHUDEvent_OnNotification> Entering Armistice Zone, but neither number nor quotes"


def test_unmatched_and_drift(spark):
    zone = "Entering Armistice Zone - Combat Prohibited"
    text = START + log(
        ("09:00:00.000", note(zone, 21)), ("09:00:01.000", BROKEN), ("09:00:02.000", note(zone, 22)), ("09:00:03.000", "plain chatter"),
    )
    p = parse(spark, {"own": text}, {"channel": "LIVE"})
    assert [r.rule_id for r in p.incomplete.collect()] == ["zone.armistice-entered"]
    assert p.suppressed.count() == 1
    told = p.events.where("event_type = 'ArmisticeStateChanged'").collect()
    assert [e.payload["notificationId"] for e in told] == ["21"]
    reasons = {r.unknown_reason for r in p.unknown.collect()}
    assert {"matched_missing_required_fields", "event_family_suppressed", "no_profile_match"} <= reasons


def test_instants(spark):
    noon = DAY + timedelta(hours=12)
    expected = {
        "2031-03-04T12:00:00.4567Z": noon + timedelta(milliseconds=456),
        "2031-03-04T12:00:00-03:15": noon + timedelta(hours=3, minutes=15),
        "2031-04-31T12:00:00Z": None,
        "2031-03-04T12:00:00": None,
        "noon": None,
    }
    rows = spark.createDataFrame([(r,) for r in expected], "t string").select("t", parse_instant(F.col("t")).alias("ms")).collect()
    assert {r.t: r.ms for r in rows} == {t: v and int(v.timestamp() * 1000) for t, v in expected.items()}
    stamped = spark.createDataFrame([(f"<{r}> hello",) for r in expected], "text string")
    codes = {r.text[1:-7]: r.code for r in with_log_instant(stamped, "text", "ms", "code").select("text", "code").collect()}
    assert list(codes.values()).count(None) == 2
    assert codes["2031-04-31T12:00:00Z"] == "timestamp_malformed" and codes["noon"] == "timestamp_missing"
    assert codes["2031-03-04T12:00:00"] == "timestamp_ambiguous"


def test_health_and_diagnostics_of_a_parse(spark):
    text = START + log(("09:00:00.000", note("Entering Armistice Zone - Combat Prohibited", 5)), ("09:00:01.000", BROKEN))
    p = parse(spark, {"own": text, "bare": log(("09:00:00.000", "plain chatter"))}, {"channel": "LIVE"})
    rows = {r.environment_key: r for r in health.health_of(p).collect()}
    told = [r for r in rows.values() if r.drifted_families]
    assert len(told) == 1 and told[0].status == "suspected_drift" and told[0].reason == "event_family_field_shape_changed"
    assert all(r.unknown <= r.records for r in rows.values())
    codes = {r.code for r in health.diagnostics_of(p).collect()}
    assert "missing_required_fields" in codes and "source_generation_changed" not in codes
    valid, rejected = health.health_events(health.health_of(p))
    assert rejected.count() == 0 and {r.event_type for r in valid.collect()} == {health.STATUS, health.DRIFT}


ZONE = Rule("own.zone", ("zone-change", "into["), "JurisdictionEntered", ("notificationId", "jurisdiction"), ("notificationId",),
            "medium", fields=(("notificationId", "keyed", "no"), ("jurisdiction", "bracket", "into")))


def test_rules_that_a_profile_brings(spark):
    """Own rules run beside the rule set of the profile, under that profile alone."""
    mine = replace(OURS, own=(ZONE,))
    other = replace(OURS, profile_id="seven-four", minor=4, tested_builds=("7.4.1",))
    text = START + log(("09:00:00.000", "zone-change no=3 into[Harbour 'A' \"B\"]"), ("09:00:01.000", note("Entered Monitored Space", 6)))
    p = parse(spark, {"own": text, "four": text.replace(BUILD, "7.4.1")}, {"channel": "LIVE"}, (mine, other))
    found = {(r.source_id, r.event_type): r for r in p.events.where("line_no > 7").collect()}
    assert set(found) == {("own", "JurisdictionEntered"), ("own", "MonitoredSpaceEntered"), ("four", "MonitoredSpaceEntered")}
    row = found["own", "JurisdictionEntered"]
    assert row.payload["notificationId"] == "3" and row.payload["jurisdiction"].startswith("Harbour")
    assert (row.confidence, row.provenance, row.profile_id) == ("medium", "observed", "seven-three")


def test_contradicting_rules_are_a_conflict(spark):
    """Two rules read one record differently: neither event is kept, and the diagnostics name the type. Equal readings are one event."""
    twice = replace(ZONE, rule_id="own.zone-again", fields=(("notificationId", "keyed", "no"), ("jurisdiction", "bracket", "from")))
    text = START + log(("09:00:00.000", "zone-change no=3 from[Quay] into[Harbour]"), ("09:00:01.000", "zone-change no=4 from[Quay] into[Quay]"))
    p = parse(spark, {"own": text}, {"channel": "LIVE"}, (replace(OURS, own=(ZONE, twice)),))
    assert [r.payload["notificationId"] for r in p.events.where("event_type = 'JurisdictionEntered'").collect()] == ["4"]
    told = health.diagnostics_of(p).where("code = 'match_conflict'").collect()
    assert [(r.detail, r.severity) for r in told] == [("JurisdictionEntered", "error")]


def test_unsound_profiles_are_refused(spark):
    bad = (
        replace(ZONE, literals=()), replace(ZONE, rule_id="build.branch"), replace(ZONE, rule_id="own.kind", event_type="NoSuchEvent"),
        replace(ZONE, rule_id="own.read", fields=(("notificationId", "guess", "no"),)),
    )
    with pytest.raises(ValueError) as told:
        parse(spark, {"own": START}, None, (replace(OURS, own=bad), replace(OURS, channels=(), rules="none")))
    for word in ("rule_without_literals", "duplicate_rule", "unknown_event_type NoSuchEvent", "unknown_extractor guess",
                 "field_never_read jurisdiction", "duplicate_profile", "missing_channels", "unknown_rule_set none"):
        assert word in str(told.value)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_shuffled_once_from_environment_to_lane_state(spark):
    records = spark.range(5).selectExpr(
        "cast(id as string) as source_id", "id % 2 as generation", "id as line_no", "id as end_line", "id as byte_offset", "cast(id as string) as text"
    )
    lane = Lane(("source_id", "generation"), ("byte_offset",))
    plan = _plan(emission._observe(emission.with_environment(records, lane, spark), lane))
    assert plan.count("Exchange hashpartitioning(source_id") == 1
    assert "SortMergeJoin" not in plan


def test_a_large_offset_alone_cuts_no_source(spark):
    rows = [(s, 0, n, n, n, start + 100 * n, 100, 1, "plain chatter") for s, start in (("early", 0), ("late", 20 << 20)) for n in range(5)]
    names = "source_id string, generation bigint, line_no bigint, end_line bigint, n bigint, byte_offset bigint, byte_length bigint, line_count bigint"
    lines = spark.createDataFrame(rows, f"{names}, text string")
    for cut, split in ((8 << 20, False), (501, False), (500, True)):
        chunked, lane = split_offsets(lines, framing.LANE, chunk_bytes=cut)
        assert lane.split == split == (CHUNK in chunked.columns)
    # without lengths the offsets are all there is to go by; lines without a known length count as one byte
    assert split_offsets(lines.drop("byte_length"), framing.LANE, chunk_bytes=501)[1].split
    bare = lines.withColumn("byte_length", F.lit(None).cast("bigint"))
    assert [split_offsets(bare, framing.LANE, chunk_bytes=n)[1].split for n in (5, 6)] == [True, False]


def test_a_cut_source_is_read_once_before_its_state(spark, monkeypatch):
    whole = parse(spark, {"own": STORY, "late": STORY.replace("sess-9", "sess-5")})
    plans, scan = [], emission.scan

    def spied(df, lane, values):
        plans.append((lane.split, _plan(df)))
        return scan(df, lane, values)

    monkeypatch.setattr(emission, "scan", spied)
    monkeypatch.setattr(emission, "split_offsets", partial(split_offsets, chunk_bytes=700))
    cut = parse(spark, {"own": STORY, "late": STORY.replace("sess-9", "sess-5")})
    assert len(plans) == 4 and all(split for split, _ in plans)
    # neither rules nor environment are planned again for each running value
    assert not any("<SystemQuit>" in plan or "FileVersion" in plan for _, plan in plans)
    for name, told in (("events", ["event_type", "event_id", "order_key"]), ("unknown", ["unknown_reason", "text"])):
        a, b = (sorted(getattr(p, name).select("source_id", "byte_offset", *told).collect()) for p in (whole, cut))
        assert a and a == b


def test_rules_and_candidates_are_compiled(spark):
    rows = spark.createDataFrame([("<Join PU> <SystemQuit>",), ("none",), (None,)], "text string")
    found = rows.select(matching_rules("text", LIFECYCLE_RULES).alias("r"), matching_rules("text", []).alias("e"))
    assert "lambda" not in _plan(found)
    assert [(r.r, r.e) for r in found.collect()] == [(["pu.join-requested", "application.system-quit"], []), ([], []), ([], [])]
    none = F.lit(None).cast("string")
    seen = rows.select(none.alias("source_id"), F.lit(0).alias("generation"), *[none.alias(c) for c in emission._CARRY[2:]])
    parts = [
        emission._candidate("a.b", "T", F.lit(True), emission._map(f=F.col("source_id"))),
        emission._candidate("c.d", "U", F.col("source_id").isNotNull(), emission._map(f=F.col("source_id"))),
    ]
    spread = emission._spread(seen, parts)
    assert "lambda" not in _plan(spread)
    assert [r.rule_id for r in spread.collect()] == ["a.b"] * 3


def test_notations_of_notifications(spark):
    texts = [
        'NOTIFICATIONID[7] x MESSAGE["old one"]', 'message["only text"]', 'Message="as key"', 'MESSAGE="not this case"',
        '<SHUDEvent_OnNotification> Added notification "new: " [9] to queue.', "plain", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: (r.n.id, r.n.message) for r in rows.select("i", notification(F.col("text")).alias("n")).collect()}
    assert got == {
        0: ("7", "old one"), 1: (None, "only text"), 2: (None, "as key"), 3: (None, None), 4: ("9", "new: "), 5: (None, None), 6: (None, None),
    }


def test_record_text_on_one_line(spark):
    texts = ["a \n  b\n", "<s> a <2031-03-04T06:00:00Z>  b ", "plain", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.t for r in rows.select("i", normalize_record(F.col("text")).alias("t")).orderBy("i").collect()]
    assert got == ["a b", "<s> a b", "plain", "", None]
