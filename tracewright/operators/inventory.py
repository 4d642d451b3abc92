"""Inventory requests: context matching over request, queue and completion records, routes, and the location audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import AUDIT_MARKERS, AUDIT_OPERATIONS, INVENTORY_WINDOW_MS
from tracewright.functions.instants import with_log_instant
from tracewright.functions.text import bracket_raw, group, outcome_kind
from tracewright.operators.dedupe import kept_instants
from tracewright.plans.scans import Lane, last, scan, total
from tracewright.plans.settle import fenced, settle

# --- fixed values: patterns of the log format
_MARK = r"^<[^>]+>\s+\[Notice\]\s+<(Add Inventory Management Move|Inventory Mgmt Request Queued|Player Inventory Request Complete)>\s+"
_BREAK = r"<Init>|<Join PU>|<SystemQuit>|<Channel Disconnected>|RequestFrontEndReason|<Channel Created>.*(?<!\w)frontend(?!\w)|<Game Version>|(?<!\w)FileVersion:"


def item_class(value: Column) -> Column:
    ok = (
        ~value.isin("NULL", "NONE", "Default", "INVALID")
        & value.rlike(r"^[A-Za-z][A-Za-z0-9_ -]{0,127}\z")
        & ~value.rlike(r"\d{8,}")
    )
    return F.when(ok, value)


def equivalent_operation(requested: Column, reported: Column, channel: Column | None = None) -> Column:
    """Same operation, or a move or drop reported as an interaction (one channel only when a channel is given)."""
    loose = requested.isin("Move", "Drop") & (reported == "Interaction")
    if channel is not None:
        loose = loose & (channel == "LIVE")
    return F.coalesce(requested == reported, requested.isNull() & reported.isNull()) | F.coalesce(loose, F.lit(False))


def inventory_records(lines: DataFrame, max_bytes: int = 64 * 1024) -> DataFrame:
    """Lines with ``kind`` (request, queue, done or null), their fields, and ``breaks`` where no request may carry over."""
    text = F.col("text")
    staged = with_log_instant(lines, "text", "ms").withColumn("_mark", group(text, _MARK, 1))
    kind = F.col("_mark")

    def f(name: str) -> Column:
        return bracket_raw(text, name)

    ms = F.col("ms")
    bad = (ms.isNull() | F.contains(text, F.lit("\ufffd"))) & (F.trim(text) != "")
    oversized = F.col("byte_length") > max_bytes
    request = F.when(f("Request").rlike(r"^\d{1,24}\z"), f("Request"))
    player = F.coalesce(f("Player"), group(text, r"(?<!\w)for '([^']+)'\s*\[", 1))
    queued = kind == "Inventory Mgmt Request Queued"
    out = staged.withColumns(
        {
            "_break": text.rlike(_BREAK) | F.coalesce(bad, F.lit(False)) | oversized,
            "kind": F.when(
                ms.isNotNull() & ~oversized & request.isNotNull(),
                F.when(kind == "Add Inventory Management Move", "request").when(queued, "queue").when(kind.isNotNull(), "done"),
            ),
            "request": request,
            "player": F.when(F.length(player) <= 128, player),
            "operation": f("Type"),
            "item": item_class(F.when(queued, f("Source")).otherwise(f("ItemClass"))),
            "source": F.when(queued, f("Source Inventory")).otherwise(f("SourceInventory")),
            "target": F.when(queued, f("Target Inventory")).otherwise(f("TargetInventory")),
            "caller": f("Caller"),
            "action": f("action"),
            "amount": f("amount"),
            "result": f("Result"),
        }
    )
    return fenced(out.drop("_mark"))


def inventory_context(
    records: DataFrame, lane: Lane, reviewed: DataFrame, window_ms: int = INVENTORY_WINDOW_MS
) -> DataFrame:
    """Completions with the single request (and queue) they belong to, or null fields when not unambiguous.

    ``reviewed`` rows name allowed operations per ``scope`` value. Lanes are cut into epochs at session boundaries,
    unreadable lines and clock reversals. Inside (epoch, player, request) an open starts at its first request, lasts
    ``window_ms`` from that first row and ends at a completion; everything else is an aggregate over the open.
    """
    pos = lane.order[0]
    one = scan(records, lane, {"_top": last(F.col("ms"), False)})
    back = F.coalesce(F.col("ms") < F.col("_top"), F.lit(False))
    two = scan(one.withColumn("_cut", F.col("_break") | back), lane, {"epoch": total(F.col("_cut").cast("bigint"))})
    rows = two.where(F.col("kind").isNotNull())
    named = rows.where(F.col("player").isNotNull())
    inner = Lane((*lane.keys, "epoch", "player", "request"), lane.order, lane.split)
    # a completion ends the open before it; requests later than the window after the first start a new open
    # the few inventory records of a log are used four times below: written once
    legs = settle(scan(named, inner, {"_leg": total((F.col("kind") == "done").cast("bigint"), False)}))
    leg = Lane((*inner.keys, "_leg"), lane.order, lane.split)
    # a request while one is open makes it ambiguous and does not extend it: opens are the bounded fold of the requests
    requests = legs.where(F.col("kind") == "request")
    opens = kept_instants(requests, list(leg.keys), "ms", pos, F.lit(window_ms).cast("bigint")).withColumn("_opens", F.lit(True))
    marked = legs.join(opens, [*leg.keys, "ms", pos], "left")
    opened = scan(marked, leg, {"_open": last(F.when(F.col("_opens"), F.col("ms")))})
    in_window = F.col("ms") - F.col("_open") <= window_ms
    live = opened.where(F.col("_open").isNotNull() & in_window)
    group_keys = [*leg.keys, "_open"]
    is_request, is_queue, is_done = (F.col("kind") == k for k in ("request", "queue", "done"))
    req = F.struct(pos, "operation", "item", "source", "target", "caller")
    queue = F.struct("source", "target", "action", "item", "amount")
    quantity = F.when(is_queue & F.col("amount").rlike(r"^\d+\z") & (F.col("amount").try_cast("bigint") > 0), F.col("amount").try_cast("bigint"))
    text_queue = F.to_json(queue)
    agg = live.groupBy(*group_keys).agg(
        F.min_by(req, F.when(is_request, F.col(pos))).alias("r"),
        F.count_if(is_request).alias("requests"),
        F.min(F.when(is_queue, text_queue)).alias("q_lo"),
        F.max(F.when(is_queue, text_queue)).alias("q_hi"),
        F.max_by(queue, F.when(is_queue, F.col(pos))).alias("q"),
        F.max(F.when(is_queue, F.col("operation"))).alias("q_op_hi"),
        F.min(F.when(is_queue, F.col("operation"))).alias("q_op_lo"),
        F.min(F.when(is_queue, F.col("item"))).alias("q_item_lo"),
        F.max(F.when(is_queue, F.col("item"))).alias("q_item_hi"),
        F.min(F.when(F.col("item").isNotNull(), quantity)).alias("n_lo"),
        F.max(F.when(F.col("item").isNotNull(), quantity)).alias("n_hi"),
        F.max_by(F.struct(pos, "ms", "operation", "result", *[c for c in ("scope",) if c in records.columns]),
                 F.when(is_done, F.col(pos))).alias("d"),
    )
    nameless = (
        rows.where(F.col("player").isNull())
        .groupBy(*lane.keys, "epoch", "request")
        .agg(F.min("ms").alias("_blind_lo"), F.max("ms").alias("_blind_hi"))
    )
    judged = agg.where(F.col("d").isNotNull()).join(nameless, [*lane.keys, "epoch", "request"], "left")
    same_item = F.coalesce(F.col("q_item_lo") == F.col("r.item"), F.lit(True)) & F.coalesce(
        F.col("q_item_hi") == F.col("r.item"), F.lit(True)
    )
    ops_ok = F.coalesce(F.col("q_op_lo").isNull() | (
        equivalent_operation(F.col("r.operation"), F.col("q_op_lo"))
        & equivalent_operation(F.col("r.operation"), F.col("q_op_hi"))
    ), F.lit(False))
    blind = F.coalesce((F.col("_blind_hi") >= F.col("_open")) & (F.col("_blind_lo") <= F.col("d.ms")), F.lit(False))
    clear = (
        (F.col("requests") == 1) & same_item & ops_ok & ~blind & F.col("r.item").isNotNull()
        & F.coalesce(F.col("n_lo") == F.col("n_hi"), F.lit(True))
    )
    allowed = reviewed.select("scope", F.col("operations").alias("_ops"))
    with_scope = judged.withColumn("scope", F.col("d.scope") if "scope" in records.columns else F.lit("LIVE"))
    checked = with_scope.join(allowed, "scope", "left")
    ok = (
        clear
        & F.coalesce(F.array_contains("_ops", F.col("r.operation")), F.lit(False))
        & equivalent_operation(F.col("r.operation"), F.col("d.operation"), F.col("scope"))
    )
    # an aggregate over queues cannot tell a queue without an item from one with the wrong item; only the former has none
    quantity_ok = F.when(F.col("n_lo").isNotNull(), F.col("n_lo"))
    return checked.where(ok).select(
        *lane.keys,
        F.col(f"d.{pos}").alias(pos),
        "request",
        "player",
        F.col("r.item").alias("item"),
        F.col("r.operation").alias("operation"),
        quantity_ok.alias("quantity"),
        F.col("d.result").alias("result"),
        F.col("d.ms").alias("ms"),
        F.struct("r.operation", "r.item", "r.source", "r.target", "r.caller").alias("requested"),
        F.when(F.col("q_lo") == F.col("q_hi"), F.col("q")).alias("queued"),
    )


def container_kind(value: Column) -> Column:
    kind = group(value, r"^[A-Za-z0-9_-]{1,128}:(Location|Container):[A-Za-z0-9_-]{1,128}\z", 1)
    return F.when(kind == "Location", "location_inventory").when(kind.isNotNull(), "container").otherwise("unknown")


def inventory_route(requested: Column, queued: Column, quantity: Column) -> Column:
    """``struct(kind, from, to)`` of a matched request, null when the route is unknown."""
    src, dst = container_kind(queued["source"]), container_kind(queued["target"])
    unknown = queued.isNull() | ((src == "unknown") & (dst == "unknown"))
    op, caller = requested["operation"], requested["caller"]
    store_ok = (
        (caller == "CSCLocalPlayerPersonalThoughtComponent::StoreItem")
        & (requested["target"] == "INVALID") & (queued["source"] == "INVALID") & (requested["source"] == queued["target"])
    )
    differs = ~requested["source"].eqNullSafe(queued["source"]) | ~requested["target"].eqNullSafe(queued["target"]) | (
        queued["source"].eqNullSafe(queued["target"])
    )
    ground = (
        (op == "Drop") & (caller == "CSCLocalPlayerPersonalThoughtComponent::DropItemFromContainerImpl")
        & (queued["target"] == "INVALID") & (src != "unknown") & (queued["action"] == "None")
        & (queued["item"] == requested["item"]) & quantity.isNotNull() & (queued["amount"].try_cast("bigint") == quantity)
    )
    transfer = (op == "Move") & (src != "unknown") & (dst != "unknown")
    kind = (
        F.when(unknown, F.lit(None).cast("string"))
        .when(op == "Store", F.when(F.coalesce(store_ok, F.lit(False)), "store"))
        .when(differs, F.lit(None).cast("string"))
        .when(F.coalesce(ground, F.lit(False)), "ground_drop")
        .when(F.coalesce(transfer, F.lit(False)), "transfer")
        .otherwise("interaction")
    )
    return F.when(
        kind.isNotNull(),
        F.struct(kind.alias("kind"), src.alias("from"), F.when(kind == "ground_drop", "ground").otherwise(dst).alias("to")),
    )


def audit_results(contexts: DataFrame) -> DataFrame:
    """Status per completion and its candidate location effect; ``route``, ``quantity`` and ``result`` are expected."""
    outcome = outcome_kind(F.col("result"))
    known = (F.col("route.from") != "unknown") & (F.col("route.to") != "unknown")
    touches = (F.col("route.from") == "location_inventory") | (F.col("route.to") == "location_inventory")
    status = (
        F.when(outcome == "failure", "reported_failure")
        .when(outcome != "success", "outcome_unknown")
        .when(~F.col("matched"), "item_or_request_context_unresolved")
        .when(F.col("route").isNull(), "route_unresolved")
        .when(F.col("quantity").isNull(), "quantity_unknown")
        .when(~known, "route_unresolved")
        .when(touches, "location_change_reported")
        .otherwise("no_location_change_identified")
    )
    hit = status == "location_change_reported"
    return contexts.withColumns(
        {
            "status": status,
            "source_delta": F.when(hit & (F.col("route.from") == "location_inventory"), -F.col("quantity")),
            "destination_delta": F.when(hit & (F.col("route.to") == "location_inventory"), F.col("quantity")),
        }
    )


def inventory_audit(lines: DataFrame, keys: Sequence[str], since_ms: int, max_bytes: int = 64 * 1024) -> DataFrame:
    """Counts of inventory records per key, in one pass over the lines."""
    text = F.col("text")
    marker = group(text, r"^<[^>]+>\s+\[(?:Notice|Warning|Error)\]\s+<([^>]+)>", 1)
    small = F.col("byte_length") - 1 <= max_bytes
    listed = F.coalesce(F.col("_marker").isin(*AUDIT_MARKERS), F.lit(False))
    tagged = text.rlike(r"\[Team_CoreGameplayFeatures\]\[Inventory\]\s*\z")
    staged = with_log_instant(lines.withColumn("_marker", marker), "text", "ms").select(
        *keys,
        F.col("_marker").alias("marker"),
        "ms",
        (~small).alias("oversized"),
        (small & F.col("_marker").isNotNull() & (listed | tagged)).alias("relevant"),
        (F.col("ms").isNull() | F.contains(text, F.lit("\ufffd"))).alias("invalid"),
        listed.alias("listed"),
        bracket_raw(text, "Type").alias("type"),
        bracket_raw(text, "amount").alias("amount"),
        text.rlike(
            r"(?<!\w)(?:SourceInventory|TargetInventory)\[[A-Za-z0-9_-]{1,128}:Location:[A-Za-z0-9_-]{1,128}\]"
        ).alias("location"),
        F.contains(text, F.lit("ItemClass[[")).alias("bulk"),
    )
    staged = fenced(staged)
    seen = F.col("relevant") & ~F.col("invalid") & (F.col("ms") >= since_ms)
    known = seen & F.col("listed")
    add = known & (F.col("marker") == "Add Inventory Management Move")
    not_query = F.coalesce(F.col("type") != "QueryInventory", F.lit(True))
    per_operation = [
        F.count_if(add & (F.col("type") == op)).alias(f"requests_{op.lower()}") for op in AUDIT_OPERATIONS
    ] + [F.count_if(add & ~F.coalesce(F.col("type").isin(*AUDIT_OPERATIONS), F.lit(False))).alias("requests_other")]
    return staged.groupBy(*keys).agg(
        F.count_if(known).alias("known_records"),
        F.count_if(seen & ~F.col("listed")).alias("unknown_markers"),
        F.count_if(F.col("relevant") & F.col("invalid")).alias("invalid_records"),
        F.count_if(F.col("oversized")).alias("oversized_records"),
        *per_operation,
        F.count_if(add & F.col("location")).alias("location_requests"),
        F.count_if(add & F.col("bulk")).alias("bulk_requests"),
        F.count_if(
            known & (F.col("marker") == "Inventory Mgmt Request Queued") & not_query & (F.col("amount") == "0")
        ).alias("zero_queues"),
        F.count_if(known & (F.col("marker") == "Player Inventory Request Complete") & not_query).alias("primary_results"),
        F.count_if(known & (F.col("marker") == "Inventory Request Completed")).alias("secondary_results"),
        F.min(F.when(seen, F.col("ms"))).alias("first_ms"),
        F.max(F.when(seen, F.col("ms"))).alias("last_ms"),
    )
