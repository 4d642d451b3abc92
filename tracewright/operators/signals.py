"""Captured signals: a closed marker vocabulary with per-signal acceptance rules and a detail summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import bracket_raw, group, number_text, plain_number, safe_name, trim_ws
from tracewright.operators.rules import ATTACHMENT_PORTS, SIGNAL_OPERATIONS, SIGNALS

# --- fixed values: patterns of the log format
_HEAD = r"^<[^>]+>\s+\[(Notice|Warning|Error)\]\s+<(.*?)>\s+([^\r\n]*)\z"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def _either(*values: Column) -> Column:
    return F.coalesce(*values)


def captured_signals(records: DataFrame) -> DataFrame:
    """Add ``signal`` (struct of payload fields, null when the record is no accepted signal) and ``marker``."""
    text = F.col("text")
    heads = records.withColumns(
        {"_sev": group(text, _HEAD, 1), "marker": group(text, _HEAD, 2), "_msg": group(text, _HEAD, 3)}
    )
    msg, marker = F.coalesce(F.col("_msg"), F.lit("")), F.col("marker")
    ids = {m: i for i, m, _ in SIGNALS}
    labels = {m: label for _, m, label in SIGNALS}
    attachment = marker == "AttachmentReceived"

    def b(key: str) -> Column:
        return bracket_raw(msg, key, ignore_case=True)

    item = safe_name(_either(b("ItemClass"), b("itemName")))
    attached = safe_name(trim_ws(F.try_element_at(F.split(b("Attachment"), ","), F.lit(2))))
    fields = heads.withColumns(
        {
            "_base": _lookup(marker, ids),
            "_label": _lookup(marker, labels),
            "_operation": safe_name(b("Type")),
            "_action": safe_name(b("action")),
            "_port": safe_name(b("Port")),
            "_item": F.when(attachment, attached).otherwise(item),
            "_quantity": plain_number(_either(b("quantity"), b("amount"))),
            "_price": plain_number(b("client_price")),
            "_result": safe_name(b("Result")),
            "_elapsed": plain_number(_either(b("Elapsed"), group(msg, r"took (\d+(?:\.\d+)?) seconds", 1))),
            "_request": group(msg, r"(?i)(?<!\w)Request\[(\d+)\]", 1),
            "_shop": safe_name(b("shopName")),
            "_kiosk": safe_name(b("kioskState")),
        }
    )
    base, sev = F.col("_base"), F.col("_sev")
    ports_id = _lookup(F.col("_port"), {k: v[0] for k, v in ATTACHMENT_PORTS.items()})
    ports_label = _lookup(F.col("_port"), {k: v[1] for k, v in ATTACHMENT_PORTS.items()})
    move = (marker == "Add Inventory Management Move") & (F.col("_operation") == "Move")
    carry = (marker == "Inventory Mgmt Request Queued") & (F.col("_action") == "Carry")
    closing = (marker == "Close Inventory Grid") & msg.rlike(r"closing inventory with \d+ pending moves")
    signal_id = (
        F.when((base == "ENV-04") & (sev == "Error"), "DIA-03")
        .when(move, "INV-06")
        .when(carry, "INV-07")
        .when(closing, "INV-10")
        .when(attachment, ports_id)
        .otherwise(base)
    )
    label = (
        F.when(move, "Inventory move requested")
        .when(carry, "Item carry requested")
        .when(closing, "Inventory closing with pending operations")
        .when(attachment, ports_label)
        .otherwise(F.col("_label"))
    )
    category = (
        F.when((sev == "Error") | base.startswith("DIA-") | (base == "NAV-01"), "diagnostic")
        .when(base.startswith("INV-") | base.startswith("SHP-"), "action")
        .when(base.startswith("VEH-"), "vehicle")
        .otherwise("runtime")
    )
    named = fields.withColumns({"_id": signal_id, "_label": label, "_category": category})
    sid, request, operation = F.col("_id"), F.col("_request"), F.col("_operation")
    quantity, price = F.col("_quantity"), F.col("_price")
    whole = (quantity == F.floor(quantity)) & (quantity >= 1)
    refused = [
        sid.isNull(),
        F.length(request) > 24,
        sid.isin("INV-01", "INV-02", "INV-03", "INV-06", "INV-07")
        & (request.isNull() | ~F.coalesce(operation.isin(*SIGNAL_OPERATIONS), F.lit(False))),
        (sid == "INV-05") & ~F.contains(msg, F.lit("attempt drag and drop to ground item")),
        (sid == "INV-08") & ~F.contains(msg, F.lit("finalized spawn")),
        (sid == "SYS-01") & ~F.startswith(msg, F.lit("Reusing channel for 'sc.external.services.")),
        (sid == "SHP-01")
        & ~F.coalesce(F.col("_item").isNotNull() & whole & price.isNotNull() & F.col("_shop").isNotNull(), F.lit(False)),
        (sid == "SHP-02")
        & ~F.coalesce(
            F.col("_result").isNotNull() & F.col("_shop").isNotNull() & (b("type") == "Buying") & F.col("_kiosk").isNotNull(),
            F.lit(False),
        ),
        (sid == "INV-04") & (request.isNull() | F.col("_result").isNull()),
    ]
    accepted = F.lit(True)
    for r in refused:
        accepted = accepted & ~F.coalesce(r, F.lit(False))
    found = group(msg, r"^Found \[(\d+)\] vehicle\(s\) at location", 1)
    stowed = r"CollectStowedVehicles found \[(\d+)\] vehicle\(s\) across \[(\d+)\] hangar\(s\)"
    entitled = r"Retrieved (\d+) entitlements out of (\d+) vehicules"

    def text_of(prefix: str, value: Column, suffix: str = "") -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(prefix), value, F.lit(suffix)))

    def only(ident: str, value: Column) -> Column:
        return F.when(sid == ident, value)

    details = F.array_compact(
        F.array(
            text_of("request ", request),
            text_of("operation ", operation),
            F.when(F.col("_item") != "Default", F.col("_item")),
            text_of("requested/source quantity ", number_text(quantity)),
            text_of("client price ", number_text(price), " (basis/currency unverified)"),
            text_of("shop ", F.col("_shop")),
            text_of("reported result ", F.col("_result")),
            text_of("", number_text(F.col("_elapsed")), " s"),
            text_of("port ", F.col("_port")),
            only("SHP-02", text_of("buying flow ", F.col("_kiosk"), "; payment/delivery unverified")),
            F.when(attachment, text_of("attachment ", F.coalesce(safe_name(b("Status")), F.lit("unknown")))),
            only("VEH-02", text_of("", found, " vehicle records at location")),
            only("VEH-02", F.concat(group(msg, stowed, 1), F.lit(" stowed records across "), group(msg, stowed, 2),
                                    F.lit(" hangars"))),
            only("VEH-03", F.concat(group(msg, entitled, 1), F.lit(" entitlement records / "), group(msg, entitled, 2),
                                    F.lit(" vehicle records; ownership unverified"))),
            only("ENV-01", text_of("state ", F.coalesce(safe_name(group(msg, r"state changed to (\w+)", 1)),
                                                        F.lit("unknown")))),
            only("SYS-01", text_of("service ", group(msg, r"'sc\.external\.services\.([a-z_]+)\.", 1))),
            only("ATC-01", text_of("", group(msg, r"clearing (\d+) entries", 1),
                                   " tracking entries cleared; no storage outcome implied")),
        )
    )
    summary = F.concat(
        F.col("_label"), F.when(F.size(details) > 0, F.concat(F.lit(": "), F.array_join(details, "; "))).otherwise(F.lit(""))
    )
    signal = F.struct(
        sid.alias("signalId"), F.col("_category").alias("category"), F.col("_label").alias("label"),
        summary.alias("summary"), request.alias("requestId"), operation.alias("operation"),
        F.col("_item").alias("itemClass"), quantity.alias("quantity"), price.alias("clientPrice"),
        F.col("_shop").alias("shopName"), F.col("_kiosk").alias("kioskState"), F.col("_result").alias("result"),
        F.col("_elapsed").alias("elapsedSeconds"), F.col("_port").alias("attachmentPort"),
    )
    keep = [c for c in records.columns]
    return named.select(*keep, "marker", F.when(accepted, signal).alias("signal"))


def signal_payload(signal: Column) -> Column:
    """A signal struct as a payload map; numbers without a trailing ``.0``."""
    numbers = {"quantity", "clientPrice", "elapsedSeconds"}
    names = [
        "signalId", "category", "label", "summary", "requestId", "operation", "itemClass", "quantity", "clientPrice",
        "shopName", "kioskState", "result", "elapsedSeconds", "attachmentPort",
    ]
    pairs = [x for n in names for x in (F.lit(n), number_text(signal[n]) if n in numbers else signal[n])]
    return F.create_map(*pairs)
