"""Event queries, pagination, stream views, classification, messages and the activity feed."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import (
    EVENT_LABELS,
    FEED_INPUT,
    FEED_ROWS,
    GAMEPLAY_SIGNALS,
    GAMEPLAY_TYPES,
    ITEM_NAMES,
    ITEM_TYPES,
    LOCATION_TYPES,
    MESSAGES,
    SEARCH_LENGTH,
    STREAM_WINDOW,
    STREAM_WINDOW_MAX,
)
from tracewright.functions.text import outcome_kind
from tracewright.plans.scans import top_n


# --- queries and pages ------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Page:
    """Rows of a page, the total without the cursor, and a way to read the next cursor."""

    rows: DataFrame
    matching: DataFrame
    limit: int

    def next_cursor(self) -> str | None:
        """Cursor after this page, null on the last one. Runs the page."""
        last = self.rows.orderBy(F.desc("order_key"), F.desc("event_id")).limit(1).collect()
        more = self.rows.count() > self.limit if not last else self._beyond(last[0])
        return encode_cursor(last[0]["order_key"], str(last[0]["event_id"])) if more and last else None

    def _beyond(self, row) -> bool:
        key, ident = row["order_key"], row["event_id"]
        after = (F.col("order_key") > key) | ((F.col("order_key") == key) & (F.col("event_id") > ident))
        return not self.matching.where(after).isEmpty()

    def total(self) -> int:
        return self.matching.count()


def encode_cursor(order_key: str, event_id: str) -> str:
    raw = json.dumps({"v": 1, "orderKey": order_key, "eventId": event_id}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        raw = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if raw["v"] != 1:
            raise ValueError(raw)
        return raw["orderKey"], raw["eventId"]
    except Exception as e:
        raise ValueError("event query cursor is invalid") from e


def order_events(df: DataFrame) -> DataFrame:
    return df.orderBy("order_key", "event_id")


def query_events(
    events: DataFrame, environment: str, session: str | None = None, types: Sequence[str] = (), since_ms: int | None = None,
    until_ms: int | None = None, cursor: tuple[str, object] | None = None, limit: int = 100,
) -> Page:
    """Events of one environment in order, after the cursor. Filters stay on plain columns so that they reach the scan."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    keep = F.col("environment_key") == environment
    if session is not None:
        keep = keep & (F.col("session_id") == session)
    if types:
        keep = keep & F.col("event_type").isin(*types)
    if since_ms is not None:
        keep = keep & (F.col("ts_ms") >= since_ms)
    if until_ms is not None:
        keep = keep & (F.col("ts_ms") <= until_ms)
    matching = events.where(keep)
    page = matching
    if cursor is not None:
        key, ident = cursor
        page = page.where((F.col("order_key") > key) | ((F.col("order_key") == key) & (F.col("event_id") > ident)))
    return Page(page.orderBy("order_key", "event_id").limit(limit), matching, limit)


def page(df: DataFrame, order: Sequence[Column], cursor: int, limit: int) -> DataFrame:
    """Rows ``cursor .. cursor + limit`` of the ordered table."""
    return df.orderBy(*order).offset(cursor).limit(limit)


def get_event(events: DataFrame, event_id, environment: str) -> DataFrame:
    return events.where((F.col("environment_key") == environment) & (F.col("event_id") == event_id))


# --- stream -----------------------------------------------------------------------------------------------------------
def last_by_id(rows: DataFrame, ident: str, order: Sequence[str]) -> DataFrame:
    """One row per id, the last in the given order."""
    rest = [c for c in rows.columns if c != ident]
    return rows.groupBy(ident).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(ident, "_r.*")


def first_by_id(rows: DataFrame, ident: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c != ident]
    return rows.groupBy(ident).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(ident, "_r.*")


def stream_order() -> list[Column]:
    """Newest first, missing times last, later lines first, then id."""
    return [F.col("ts_ms").desc_nulls_last(), F.coalesce("line_no", F.lit(-1)).desc(), F.col("event_id").asc()]


def stream_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class StreamQuery:
    """The stream predicates; unset ones do not filter."""

    environment: str | None = None
    session: str | None = None
    search: str = ""
    kinds: tuple[str, ...] = ()
    shard: str | None = None
    server: str | None = None
    party: str = "any"
    provenance: str | None = None
    confidence: str | None = None
    diagnostics: str = "show"
    since_ms: int | None = None


SHARD_FIELDS = ["shard_id", "shard_name", "region"]
SERVER_FIELDS = ["server", "server_id", "endpoint", "host", "address"]
SEARCH_FIELDS = ["kind", "summary", "context", "environment", "confidence"]


def stream_filter(rows: DataFrame, q: StreamQuery) -> DataFrame:
    """Conjunction of the set predicates over the columns the table has."""
    have = set(rows.columns)

    def any_of(fields: Sequence[str], wanted: str) -> Column:
        out = F.lit(False)
        for f in fields:
            if f in have:
                out = out | F.coalesce(F.lower(F.col(f).cast("string")) == wanted.lower(), F.lit(False))
        return out

    keep = F.lit(True)
    if q.environment is not None:
        keep = keep & (F.col("environment_key") == q.environment)
    if q.session is not None:
        keep = keep & (F.col("session_id") == q.session)
    if q.kinds:
        keep = keep & F.col("kind").isin(*q.kinds)
    if q.shard is not None:
        keep = keep & any_of(SHARD_FIELDS, q.shard)
    if q.server is not None:
        keep = keep & any_of(SERVER_FIELDS, q.server)
    if q.party != "any":
        involved = F.col("kind") == "party"
        if "party_id" in have:
            involved = involved | F.col("party_id").isNotNull()
        keep = keep & (involved if q.party == "involved" else ~involved)
    if q.provenance is not None:
        keep = keep & (F.lower("provenance") == q.provenance.lower())
    if q.confidence is not None:
        keep = keep & (F.lower("confidence") == q.confidence.lower())
    if q.diagnostics == "only":
        keep = keep & (F.col("kind") == "diagnostic")
    elif q.diagnostics == "hide":
        keep = keep & (F.col("kind") != "diagnostic")
    if q.since_ms is not None:
        keep = keep & (F.col("ts_ms") >= q.since_ms)
    term = q.search.strip()[:SEARCH_LENGTH].lower()
    if term:
        hit = F.lit(False)
        for f in SEARCH_FIELDS:
            if f in have:
                hit = hit | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(term)), F.lit(False))
        keep = keep & hit
    return rows.where(keep)


def stream_window(rows: DataFrame, anchor_id, size: int = STREAM_WINDOW) -> DataFrame:
    """``size`` rows of the stream view from the anchor on, pulled up at the end of the stream; from the top without one.

    The position of the anchor is a count of the rows sorting before it, so no global numbering of the stream is needed.
    """
    size = min(size if size > 0 else STREAM_WINDOW, STREAM_WINDOW_MAX)
    anchor = rows.where(F.col("event_id") == anchor_id).limit(1).collect()
    if not anchor:
        return rows.orderBy(*stream_order()).limit(size)
    a = anchor[0]
    line = -1 if a["line_no"] is None else a["line_no"]
    own_line = F.coalesce("line_no", F.lit(-1))
    tie = (own_line > line) | ((own_line == line) & (F.col("event_id") < F.lit(a["event_id"])))
    if a["ts_ms"] is None:
        before = F.col("ts_ms").isNotNull() | tie
    else:
        before = F.coalesce((F.col("ts_ms") > a["ts_ms"]) | ((F.col("ts_ms") == a["ts_ms"]) & tie), F.lit(False))
    counts = rows.agg(F.count_if(before).alias("b"), F.count(F.lit(1)).alias("n")).collect()[0]
    start = min(counts["b"], max(0, counts["n"] - size))
    if start == counts["b"]:
        return rows.where(~before).orderBy(*stream_order()).limit(size)
    # near the end: the last rows of the stream, read from the other side
    back = [F.col("ts_ms").asc_nulls_first(), own_line.asc(), F.col("event_id").desc()]
    return rows.orderBy(*back).limit(size).orderBy(*stream_order())


def unseen_count(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """How many rows of the current view were not in the snapshot."""
    return current.join(snapshot.select("event_id"), "event_id", "left_anti").agg(F.count(F.lit(1)).alias("unseen"))


# --- classification ---------------------------------------------------------------------------------------------------
def gameplay_eligible(event_type: Column, signal: Column, operation: Column, marker: Column) -> Column:
    captured = event_type == "RuntimeLogSignalObserved"
    primary = (marker == "Player Inventory Request Complete") & (F.coalesce(operation, F.lit("")) != "QueryInventory")
    allowed = (
        F.when(~signal.isin(*GAMEPLAY_SIGNALS), False)
        .when(signal == "INV-04", primary)
        .when(signal == "INV-09", marker == "Close Inventory Grid")
        .otherwise(True)
    )
    return F.coalesce(F.when(captured, allowed).otherwise(event_type.isin(*GAMEPLAY_TYPES)), F.lit(False))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """A value of a small fixed table."""
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


def classify(event_type: Column, signal: Column, item: Column, movement: Column) -> Column:
    """``struct(category, action, item_type, source)`` of a feed row."""
    t = event_type
    rules = [
        ((t == "ShopPurchaseRequested") | signal.isin("SHP-01", "SHP-02"), "shop", F.lit("purchase")),
        (signal.isin("INV-13", "INV-14", "INV-15"), "equipment", F.lit("attachment")),
        (signal == "INV-05", "inventory", F.lit("drop")),
        (signal == "INV-06", "inventory", F.lit("move")),
        (signal == "INV-07", "inventory", F.lit("carry")),
        (signal == "INV-09", "inventory", F.lit("close")),
        ((signal == "INV-04") & (movement == "ground_drop"), "inventory", F.lit("drop")),
        ((signal == "INV-04") & (movement == "transfer"), "inventory", F.lit("move")),
        (t.startswith("Vehicle"), "vehicle",
         F.when(t == "VehicleRetrieved", "retrieve").when(t == "VehicleStored", "store").otherwise("control")),
        (t.startswith("Quantum"), "travel", F.when(t == "QuantumTravelArrived", "arrival").otherwise("destination")),
        (t.startswith("Party"), "party", F.when(t == "PartyLaunchInitiated", "launch").otherwise("membership")),
        (t == "MissionAccepted", "mission", F.lit("accept")),
        (t.isin(*LOCATION_TYPES), "area", F.lit("area_change")),
    ]
    category, action = F.lit("inventory"), F.lit("inventory_result")
    for when, c, a in reversed(rules):
        hit = F.coalesce(when, F.lit(False))
        category, action = F.when(hit, c).otherwise(category), F.when(hit, a).otherwise(action)
    mapped = lookup(item, ITEM_TYPES)
    return F.struct(
        category.alias("category"),
        action.alias("action"),
        F.when(item.isNull(), "no_item").otherwise(F.coalesce(mapped, F.lit("unclassified"))).alias("item_type"),
        F.when(mapped.isNotNull(), "local_exact_mapping").otherwise("observation").alias("source"),
    )


def classification_filter(row: Column, categories=(), actions=(), item_types=()) -> Column:
    """Empty groups match everything."""
    keep = F.lit(True)
    for name, wanted in (("category", categories), ("action", actions), ("item_type", item_types)):
        if wanted:
            keep = keep & row[name].isin(*wanted)
    return keep


def event_category(event_type: Column) -> Column:
    return (
        F.when(event_type == "ShopPurchaseRequested", "action")
        .when(event_type.startswith("Party"), "party")
        .when(event_type.isin(*LOCATION_TYPES), "zone")
        .when(event_type.startswith("Quantum"), "navigation")
        .when(event_type.startswith("Vehicle"), "vehicle")
        .otherwise("runtime")
    )


def event_label(event_type: Column, signal_label: Column) -> Column:
    return F.when(event_type == "RuntimeLogSignalObserved", signal_label).otherwise(
        F.coalesce(lookup(event_type, EVENT_LABELS), event_type)
    )


def event_summary(event_type: Column, payload: Column) -> Column:
    """One sentence per event type."""

    def p(name: str) -> Column:
        return F.coalesce(F.try_element_at(payload, F.lit(name)), F.lit("null"))

    def say(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    vehicle, target = p("vehicleDisplayName"), p("targetObservedId")
    cases = {
        "RuntimeLogSignalObserved": p("summary"),
        "PartyCreated": say("Party created by ", p("leaderHandle")),
        "PartyLaunchInitiated": p("message"),
        "PartyMemberConnected": say(p("memberHandle"), " connected"),
        "PartyMemberJoined": say(p("memberHandle"), " joined the party"),
        "PartyLeft": F.lit("Left party"),
        "MissionAccepted": say(p("contractName"), " accepted"),
        "ShopPurchaseRequested": say(p("quantity"), " x ", p("itemName"), " requested at ", p("shopName"), "; client price ", p("clientPrice")),
        "JurisdictionEntered": say("Entered ", p("jurisdiction")),
        "MonitoredSpaceEntered": F.lit("Entered monitored space"),
        "MonitoredSpaceExited": F.lit("Exited monitored space"),
        "ArmisticeStateChanged": F.when(p("state") == "entered", "Entered armistice zone").otherwise("Left armistice zone"),
        "VehicleRetrieved": say("Retrieved ", vehicle),
        "VehicleControlAcquired": say("Controlling ", vehicle),
        "VehicleControlReleased": say("Released control of ", vehicle),
        "VehicleStored": say("Stored ", vehicle),
        "QuantumTargetSelected": say("Selected quantum target ", target),
        "QuantumTargetChanged": say("Changed quantum target to ", target),
        "QuantumTravelArrived": say("Arrived at ", target),
    }
    out = event_type
    for t, text in cases.items():
        out = F.when(event_type == t, text).otherwise(out)
    return out


# --- messages ---------------------------------------------------------------------------------------------------------
def item_name(item: Column, quantity: Column) -> Column:
    one = lookup(item, {k: v[0] for k, v in ITEM_NAMES.items()})
    many = lookup(item, {k: v[1] for k, v in ITEM_NAMES.items()})
    return F.coalesce(F.when(quantity == 1, one).otherwise(many), item, F.lit("item"))


def fill(template: Column, **values: Column) -> Column:
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("null")))
    return out


def message(key: str) -> Column:
    return F.lit(MESSAGES[key])


def route_label(kind: Column, endpoint: str) -> Column:
    names = {"location_inventory": "location inventory", "container": "container", "ground": "ground"}
    return F.coalesce(lookup(kind, names), F.lit(f"unknown {endpoint}"))


def inventory_message(result: Column, item: Column, quantity: Column, route: Column | None = None) -> Column:
    """Result text of an inventory completion, with route when known."""
    outcome = outcome_kind(result)

    def by_outcome(prefix: str) -> Column:
        return (
            F.when(outcome == "success", message(prefix + "Succeeded"))
            .when(outcome == "failure", message(prefix + "Failed"))
            .otherwise(message(prefix + "Response"))
        )

    counted = F.when(
        quantity > 0, F.concat(quantity.cast("bigint").cast("string"), F.lit("× "), item_name(item, quantity))
    ).otherwise(item_name(item, F.lit(1)))
    if route is None:
        with_item = fill(by_outcome("inventoryItem"), item=counted)
        return F.when(item.isNull(), by_outcome("inventory")).otherwise(with_item)
    kind = route["kind"]
    template = (
        F.when(kind == "transfer", by_outcome("inventoryTransfer"))
        .when(kind == "store", by_outcome("inventoryStore"))
        .when(kind == "ground_drop", by_outcome("inventoryDrop"))
        .otherwise(by_outcome("inventoryItem"))
    )
    effect = F.when((kind == "ground_drop") & (outcome == "success"), "outgoing item reported").otherwise("ownership unverified")
    tail = F.concat(
        F.lit(" · "), route_label(route["from"], "source"), F.lit(" → "), route_label(route["to"], "destination"), F.lit(" · "), effect
    )
    base = fill(template, item=counted)
    return F.when(item.isNull(), by_outcome("inventory")).otherwise(
        F.when(route.isNull(), base).otherwise(F.concat(base, tail))
    )


def signal_message(signal: Column, item: Column, quantity: Column, result: Column, label: Column) -> Column:
    outcome = outcome_kind(result)
    one = item_name(item, F.lit(1))
    shop = F.when(outcome == "success", message("shopSucceeded")).when(outcome == "failure", message("shopFailed")).otherwise(
        message("purchaseResponse")
    )
    cases = {
        "SHP-01": fill(message("purchaseRequested"), count=quantity, item=item_name(item, quantity)),
        "SHP-02": shop,
        "INV-04": inventory_message(result, item, quantity),
        "INV-05": message("dropRequested"),
        "INV-06": fill(message("moveRequested"), item=one),
        "INV-07": message("carryRequested"),
        "INV-09": message("inventoryClosing"),
        "INV-13": fill(message("leftHand"), item=one),
        "INV-14": fill(message("helmetHook"), item=one),
        "INV-15": fill(message("rightHand"), item=one),
    }
    out = label
    for s, text in cases.items():
        out = F.when(signal == s, text).otherwise(out)
    return out


# --- feed -------------------------------------------------------------------------------------------------------------
def activity_feed(
    events: DataFrame, since_ms: int, keys: Sequence[str] = ("environment_key",), keep: Column | None = None,
    read: int = FEED_INPUT, show: int = FEED_ROWS,
) -> DataFrame:
    """Newest ``show`` matching rows of the last ``read`` eligible events per key.

    Expects ``eligible``, ``ts_ms``, ``order_key`` and ``event_id``. Duplicates of an id collapse to the first in order;
    both cuts are group limits, so no more than ``read`` rows of a key leave a map task.
    """
    able = events.where(F.col("eligible") & (F.col("ts_ms") >= since_ms))
    once = first_by_id(able, "event_id", ["order_key"])
    recent = top_n(once, list(keys), [F.desc("order_key")], read, ["event_id"]).drop("rank")
    wanted = recent if keep is None else recent.where(keep)
    return top_n(wanted, list(keys), [F.desc("order_key")], show, ["event_id"])
