"""Vocabularies, patterns, windows and limits that results depend on."""

from __future__ import annotations

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

# --- vocabularies -----------------------------------------------------------------------------------------------------
RELEASE_CHANNELS = ["LIVE", "PTU", "EPTU", "HOTFIX", "TECH-PREVIEW"]
UNIVERSES = ["PU", "UNKNOWN"]
PROVENANCE = ["observed", "extracted", "inferred", "enriched"]
CONFIDENCE = ["confirmed", "high", "medium", "low", "unknown"]
SENSITIVITY_LEVELS = ["public", "local", "personal", "social", "secret"]
PROJECTION_STATES = ["known", "unknown", "transitioning", "stale", "disconnected", "unsupported", "error"]
CONTRACT_VERSION = "runtime-event/v1"
PARSER_VERSION = "runtime-log-parser/0.2.0"
FORBIDDEN_KEYS = ["rawLine", "rawEvidence", "rawLog", "lineText"]

# --- limits -----------------------------------------------------------------------------------------------------------
MAX_LINE_BYTES = 64 * 1024
MAX_RECORD_BYTES = 128 * 1024
MAX_RECORD_LINES = 8
CAPTURE_WINDOW_BYTES = 8 * 1024 * 1024
EVIDENCE_RECORDS, EVIDENCE_RECORD_BYTES, EVIDENCE_TOTAL_BYTES = 160, 64 * 1024, 256 * 1024
HEAD_SAMPLE_BYTES, TAIL_SAMPLE_BYTES, WHOLE_SAMPLE_BYTES = 384 * 1024, 128 * 1024, 1024 * 1024
CONTEXT_RADIUS = 6
QUIET_AFTER_MS = MINUTE_MS
RETENTION_DAYS = 30
UNKNOWN_POLICY = {
    "max_sample_bytes": 320,
    "samples_per_bucket": 4,
    "noise_sample_every": 25,
    "max_samples": 250,
    "max_total_sample_bytes": 96 * 1024,
}
DRIFT_MIN_RECORDS, DRIFT_MIN_UNKNOWN, DRIFT_RATIO = 25, 15, 0.75

# --- windows ----------------------------------------------------------------------------------------------------------
READY_WINDOW_MS = 5 * MINUTE_MS
VEHICLE_STORE_WINDOW_MS = 15 * MINUTE_MS
PURCHASE_WINDOW_MS = 10_000
INVENTORY_WINDOW_MS = 10_000
DEDUPE_WINDOW_MS = 10 * MINUTE_MS
CORRELATION_WINDOW_MS = 15 * MINUTE_MS
DAY_WINDOW_TYPES = ["ClientBuildObserved", "ReleaseEnvironmentObserved", "GameDataVersionObserved"]
HALF_HOUR_WINDOW_TYPES = [
    "LoginStarted", "AccountAuthenticated", "IdentityObserved", "PuJoinRequested",
    "PuReplicationConnectionEstablished", "UniverseHierarchyRegistered", "PuTerritorySetupCompleted", "PuEntered",
    "PuDisconnected", "ReturnedToFrontend", "ApplicationExited", "PartyLeft",
]

# --- event groups -----------------------------------------------------------------------------------------------------
LIFECYCLE_STATES = {
    "LoginStarted": "authenticating",
    "AccountAuthenticated": "authenticated",
    "IdentityObserved": "frontend",
    "PuJoinRequested": "loading",
    "PuReplicationConnectionEstablished": "loading",
    "PuEntered": "in_game",
    "PuDisconnected": "disconnected",
    "ReturnedToFrontend": "frontend",
    "ApplicationExited": "exited",
}
SESSION_BOUNDARIES = ["PuDisconnected", "ReturnedToFrontend", "ApplicationExited"]
PARTY_TYPES = ["PartyCreated", "PartyLaunchInitiated", "PartyMemberConnected", "PartyMemberJoined", "PartyLeft"]
MISSION_TYPES = ["MissionAccepted"]
LOCATION_TYPES = ["JurisdictionEntered", "MonitoredSpaceEntered", "MonitoredSpaceExited", "ArmisticeStateChanged"]
QUANTUM_TYPES = ["QuantumTargetSelected", "QuantumTargetChanged", "QuantumTravelArrived"]
VEHICLE_TYPES = ["VehicleRetrieved", "VehicleControlAcquired", "VehicleControlReleased", "VehicleStored"]
IDENTITY_FIELDS = [
    "handle", "characterName", "accountId", "characterGeid", "playerGeid", "nodeId", "loginSessionId", "clientSession",
]
UNKNOWN_CATEGORIES = {
    "unsupported_profile": "compatibility.unsupported_profile",
    "no_profile_match": "parser.unmatched_record",
    "matched_missing_required_fields": "parser.incomplete_match",
    "match_conflict": "parser.conflicting_match",
}
NOISE_CATEGORY = "noise.low_value"

# --- privacy ----------------------------------------------------------------------------------------------------------
_S, _E = r"(?<!\w)", r"(?!\w)"
_VALUE = r"\s*[:=\[]\s*(?:\"[^\"]+\"|[^\s,\]]+)"
#: kind, pattern, replacement, sensitivity; applied in this order
REDACTIONS = [
    ("secret", rf"(?i){_S}(authorization|auth|token|secret|password|apikey){_E}{_VALUE}", "$1=[REDACTED_SECRET]", "secret"),
    ("session", rf"(?i){_S}(loginSessionId|session|sessionId){_E}{_VALUE}", "$1=[REDACTED_SESSION]", "secret"),
    ("identifier", rf"(?i){_S}(accountId|playerGEID|characterGEID|geid|node_id){_E}{_VALUE}", "$1=[REDACTED_ID]", "personal"),
    ("handle", rf"(?i){_S}(handle|nickname|leader|member){_E}{_VALUE}", "$1=[REDACTED_HANDLE]", "social"),
    ("endpoint", rf"{_S}(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?::\d{{1,5}})?{_E}", "[REDACTED_ENDPOINT]", "local"),
    (
        "endpoint",
        rf"(?i){_S}(?:[a-z0-9-]+\.)+(?:invalid|local|lan|test|example|com|net|org)(?::\d{{1,5}})?{_E}",
        "[REDACTED_ENDPOINT]",
        "local",
    ),
    ("path", rf"{_S}[A-Za-z]:\\[^\s\]]+", "[REDACTED_PATH]", "local"),
    ("path", r"(^|[\s\[])/(?:home|Users|mnt|media|tmp|var|opt)/[^\s\]]+", "$1[REDACTED_PATH]", "local"),
]
PRIVACY_PATTERNS = [
    ("ipv4 address", rf"{_S}(?:\d{{1,3}}\.){{3}}\d{{1,3}}{_E}"),
    ("windows user path", rf"{_S}[A-Za-z]:\\(?:Users|Program Files|ProgramData|Windows)\\"),
    ("unix home path", r"/home/[A-Za-z0-9._-]+|/Users/[A-Za-z0-9._-]+"),
    ("jwt-like token", rf"{_S}eyJ[A-Za-z0-9_-]{{12,}}\.[A-Za-z0-9_-]{{12,}}\.[A-Za-z0-9_-]{{12,}}{_E}"),
    ("aws access key", rf"{_S}AKIA[0-9A-Z]{{16}}{_E}"),
    ("long hex token", rf"{_S}[0-9a-fA-F]{{24,}}{_E}"),
    ("email address", rf"(?i){_S}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{_E}"),
    ("secret assignment", rf"(?i){_S}(?:password|passwd|secret|token|api[_-]?key)\s*[:=]\s*[^,\s\]]+"),
    ("real-looking account number", rf"(?i){_S}(?:accountId|account_id|citizenId|playerId)\s*[:=]?\s*\d{{6,}}{_E}"),
]

# --- regions ----------------------------------------------------------------------------------------------------------
REGION_PATTERNS = [
    ("US", r"(?i)^us(?:e|w|c|east|west|central)?\d*[a-z]*\z"),
    ("EU", r"(?i)^eu(?:w|e|central|west|east)?\d*[a-z]*\z"),
    ("AUS", r"(?i)^(?:aus|oce)(?:e|w|east|west)?\d*[a-z]*\z"),
    ("ASIA", r"(?i)^(?:asia|apac|ap)(?:e|s|n|east|south|north)?\d*[a-z]*\z"),
]

# --- feed -------------------------------------------------------------------------------------------------------------
GAMEPLAY_SIGNALS = [
    "INV-04", "INV-05", "INV-06", "INV-07", "INV-09", "INV-13", "INV-14", "INV-15", "SHP-01", "SHP-02",
]
GAMEPLAY_TYPES = ["ShopPurchaseRequested", *PARTY_TYPES, *MISSION_TYPES, *VEHICLE_TYPES, *QUANTUM_TYPES, *LOCATION_TYPES]
FEED_INPUT, FEED_ROWS = 160, 80
STREAM_WINDOW, STREAM_WINDOW_MAX, SEARCH_LENGTH = 80, 200, 160
ITEM_TYPES = {
    "crlf_consumable_healing_01": "medical",
    "Drink_bottle_cruz_01_lux_a": "drink",
    "klwe_lmg_energy_01_mag": "ammunition",
    "behr_lmg_ballistic_01_mag": "ammunition",
    "klwe_pistol_energy_01_mag": "ammunition",
    "outlaw_legacy_armor_medium_helmet_01_01_01": "equipment",
    "rsi_odyssey_undersuit_helmet_01_01_01": "equipment",
    "rsi_odyssey_undersuit_01_01_01": "equipment",
    "rsi_explorer_undersuit_01_01_concierge": "equipment",
    "qrt_specialist_medium_core_01_01_04": "equipment",
    "qrt_specialist_medium_arms_01_01_04": "equipment",
    "qrt_specialist_medium_legs_01_01_04": "equipment",
    "qrt_specialist_medium_helmet_01_01_04": "equipment",
    "rrs_combat_light_backpack_02_02_01": "equipment",
    "fio_glasses_01_01_01": "equipment",
    "klwe_ubarrel_lasr_s1": "equipment",
    "klwe_ubarrel_lasr_s1_02": "equipment",
}
#: item class -> (singular, plural)
ITEM_NAMES = {
    "crlf_consumable_healing_01": ("MedPen", "MedPens"),
    "Drink_bottle_cruz_01_lux_a": ("Cruz bottle", "Cruz bottles"),
    "klwe_lmg_energy_01_mag": ("energy LMG magazine", "energy LMG magazines"),
    "behr_lmg_ballistic_01_mag": ("ballistic LMG magazine", "ballistic LMG magazines"),
    "klwe_pistol_energy_01_mag": ("energy pistol magazine", "energy pistol magazines"),
    "klwe_pistol_energy_01": ("energy pistol", "energy pistols"),
    "rsi_odyssey_undersuit_helmet_01_01_01": ("Odyssey helmet", "Odyssey helmets"),
    "rsi_odyssey_undersuit_01_01_01": ("Odyssey undersuit", "Odyssey undersuits"),
    "rsi_explorer_undersuit_01_01_concierge": ("Explorer undersuit", "Explorer undersuits"),
    "qrt_specialist_medium_core_01_01_04": ("Specialist medium chest armor", "Specialist medium chest armor pieces"),
    "qrt_specialist_medium_arms_01_01_04": ("Specialist medium arm armor", "Specialist medium arm armor pieces"),
    "qrt_specialist_medium_legs_01_01_04": ("Specialist medium leg armor", "Specialist medium leg armor pieces"),
    "qrt_specialist_medium_helmet_01_01_04": ("Specialist medium helmet", "Specialist medium helmets"),
    "rrs_combat_light_backpack_02_02_01": ("light combat backpack", "light combat backpacks"),
    "fio_glasses_01_01_01": ("glasses", "pairs of glasses"),
    "crlf_medgun_01_msn_rwd02": ("medical gun", "medical guns"),
    "gmni_sniper_ballistic_01_arctic01": ("ballistic sniper rifle", "ballistic sniper rifles"),
    "klwe_ubarrel_lasr_s1": ("size 1 underbarrel laser attachment", "size 1 underbarrel laser attachments"),
    "klwe_ubarrel_lasr_s1_02": (
        "size 1 underbarrel laser attachment (variant 02)",
        "size 1 underbarrel laser attachments (variant 02)",
    ),
    "outlaw_legacy_armor_medium_helmet_01_01_01": ("helmet", "helmets"),
}
MESSAGES = {
    "purchaseRequested": "{count}× {item} purchase requested",
    "purchaseSucceeded": "{count}× {item} purchased",
    "purchaseFailed": "{count}× {item} purchase failed",
    "purchaseResponse": "Shop response received",
    "inventorySucceeded": "Inventory action completed (item unknown)",
    "inventoryFailed": "Inventory action failed (item unknown)",
    "inventoryResponse": "Inventory response received (item unknown)",
    "inventoryItemSucceeded": "Inventory update completed: {item}",
    "inventoryItemFailed": "Inventory update failed: {item}",
    "inventoryItemResponse": "Inventory response received: {item}",
    "inventoryTransferSucceeded": "Transfer reported: {item}",
    "inventoryTransferFailed": "Transfer failed: {item}",
    "inventoryTransferResponse": "Transfer response received: {item}",
    "inventoryStoreSucceeded": "Store reported: {item}",
    "inventoryStoreFailed": "Store failed: {item}",
    "inventoryStoreResponse": "Store response received: {item}",
    "inventoryDropSucceeded": "Ground drop reported: {item}",
    "inventoryDropFailed": "Ground drop failed: {item}",
    "inventoryDropResponse": "Ground drop response received: {item}",
    "dropRequested": "Item drop requested",
    "moveRequested": "{item} move requested",
    "carryRequested": "Item carry requested",
    "inventoryClosing": "Closing inventory",
    "leftHand": "Holding {item} in left hand",
    "helmetHook": "{item} attached to helmet hook",
    "rightHand": "Holding {item} in right hand",
    "shopSucceeded": "Shop reported purchase success",
    "shopFailed": "Shop reported purchase failure",
}
EVENT_LABELS = {
    "PartyCreated": "Party Created",
    "PartyLaunchInitiated": "Party Launch",
    "PartyMemberConnected": "Party Member Connected",
    "PartyMemberJoined": "Party Member Joined",
    "PartyLeft": "Party Left",
    "MissionAccepted": "Contract Accepted",
    "ShopPurchaseRequested": "Purchase Requested",
    "JurisdictionEntered": "Jurisdiction Entered",
    "MonitoredSpaceEntered": "Monitored Space",
    "MonitoredSpaceExited": "Monitored Space",
    "ArmisticeStateChanged": "Armistice",
    "VehicleRetrieved": "Vehicle Retrieved",
    "VehicleControlAcquired": "Vehicle Control Acquired",
    "VehicleControlReleased": "Vehicle Control Released",
    "VehicleStored": "Vehicle Stored",
    "QuantumTargetSelected": "Quantum Target Selected",
    "QuantumTargetChanged": "Quantum Target Changed",
    "QuantumTravelArrived": "Quantum Travel Arrived",
}

# --- inventory --------------------------------------------------------------------------------------------------------
AUDIT_OPERATIONS = ["QueryInventory", "Move", "Drop", "Interaction", "Store", "Split", "StackAll"]
AUDIT_MARKERS = [
    "Add Inventory Management Move", "Inventory Mgmt Request Handle", "Inventory Mgmt Request Queued",
    "Inventory Mgmt Request Process", "Player Inventory Request Complete", "Inventory Request Completed",
    "Inventory Drop From Container", "UnstowPendingEntities", "Inventory Token Flow", "Query Inventory",
    "Request Personal Inventory Data", "Inventory Terminate Location Container", "Update Container Items Add New Item",
    "OnDragInventoryItemModifyTarget", "AttachmentReceived", "Update Inventory Location", "RequestLocationInventory",
    "Inventory Quick Equip Request", "EquipItem", "Update Inventory", "OnInventoryStoreItem", "StoreItem",
    "InventoryManagement", "Show Location Inventory", "Update Inventory Sections", "Revert Moves",
    "Expire Local Attachment", "Evaluate Inventory State On Failed Move", "Close Inventory Grid",
    "Remove Inventory Container UI", "Request Terminate Access To Inventory",
]
#: channel, build, profile id, operations reviewed for it
REVIEWED_BUILDS = [
    ("LIVE", "4.10.197.2878", "sc-4.10-live", ["Move", "Drop", "Interaction"]),
    ("PTU", "4.10.199.13454", "sc-4.10-ptu", ["Store", "Interaction"]),
]

# --- blueprint catalogue ----------------------------------------------------------------------------------------------
BLUEPRINT_PARSER_VERSION = "blueprint-notification-v1"
BLUEPRINT_LABEL = "Received Blueprint"
BACKUP_NAME = (
    r"(?i)^Game\s+Build\s*\(\s*(\d+)\s*\)\s+(\d{1,2}\s+[A-Za-z]{3}\s+\d{2})\s+\(\s*(\d{2}\s+\d{2}\s+\d{2})\s*\)"
    r"(?:\.[^.]+)?\.log\z"
)
#: profile id -> builds it is approved for
BLUEPRINT_PROFILES = {
    "sc-4.7-live-11518367-blueprint-v1": ["11518367"],
    "sc-4.7-blueprint-v1": ["11545720", "11576750", "11592622", "11617053", "11638371", "11674325", "11715810"],
    "sc-4.8-blueprint-v1": ["11825000", "11854421", "11875683", "11952564", "12030094", "12061511", "12122953"],
    "sc-4.9-blueprint-v1": ["12232306", "12248363", "12269732", "12286454", "12302499", "12326004", "12344265"],
    "sc-4.10-blueprint-v1": ["12519617", "12535871", "12545750", "12572603", "12625701"],
    "sc-4.5-blueprint-v1": ["10840216", "10879294", "10957089", "10967244", "10989003", "11010425"],
    "sc-4.6-blueprint-v1": ["11135423", "11218823", "11303722", "11319298", "11377160"],
    "sc-4.4-blueprint-v1": ["10694190", "10717260"],
}
#: lower bound of the changelist number -> release family
BUILD_FAMILIES = [
    (12_500_000, "4.10"), (12_200_000, "4.9"), (11_800_000, "4.8"), (11_400_000, "4.7"), (11_100_000, "4.6"),
    (10_800_000, "4.5"), (10_600_000, "4.4"), (0, "pre-4.4"),
]
