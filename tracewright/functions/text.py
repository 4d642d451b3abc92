"""Text extraction from log records as Catalyst expressions. No match is null, never an empty string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space as the log producer defines it: ASCII plus the Unicode spaces and the byte order mark. The range in front
#: of the list lets plain characters fail after two tests.
WS = r"[\s[\u00a0-\ufeff&&[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]"
_B, _E = r"(?<!\w)", r"(?!\w)"


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A capture group of the first match, or null. The text is matched once per use."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(index)), F.lit(1))


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def clean(value: Column) -> Column:
    """Strip quoting and separators left around an extracted value."""
    inner = F.regexp_replace(value, rf"^(?:[=:>\"']|{WS})+", "")
    return F.regexp_replace(inner, rf"{WS}*[<,\"')\]}}]*{WS}*\z", "")


def bracket(text: Column, key: str) -> Column:
    """``key[value]``, case-insensitive key."""
    return clean(group(text, rf"(?i){_B}{re.escape(key)}\[([^\]]+)\]"))


def bracket_raw(text: Column, key: str, ignore_case: bool = False) -> Column:
    """``key[value]`` exactly as written."""
    flag = "(?i)" if ignore_case else ""
    return F.nullif(group(text, rf"{flag}{_B}{re.escape(key)}\[([^\]]*)\]"), F.lit(""))


def last_bracket(text: Column, key: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(rf"(?i){_B}{re.escape(key)}\[([^\]]+)\]"), F.lit(1))
    return clean(F.try_element_at(hits, F.lit(-1)))


def keyed(text: Column, key: str) -> Column:
    """``key="value"``, ``key: value`` or ``key value``, in that order of preference."""
    k = rf"(?i){_B}{re.escape(key)}{_E}"
    return clean(
        F.coalesce(
            group(text, rf"{k}{WS}*[:=]{WS}*\"([^\"]+)\""),
            group(text, rf"{k}{WS}*[:=]{WS}*([^\s,\]]+)"),
            group(text, rf"{k}{WS}+([^\s,\]]+)"),
        )
    )


def quoted(text: Column, key: str) -> Column:
    """``key="value"`` only."""
    return clean(group(text, rf"(?i){_B}{re.escape(key)}{_E}{WS}*={WS}*\"([^\"]+)\""))


def contains_all(text: Column, literals: list[str]) -> Column:
    cond = F.lit(True)
    for literal in literals:
        cond = cond & F.contains(text, F.lit(literal))
    return cond


def endpoint_host(value: Column) -> Column:
    """Host part of ``host:port``; the whole value when there is no port."""
    return F.coalesce(group(value, r"^(.+):\d{1,5}\z"), value)


def endpoint_port(value: Column) -> Column:
    return to_integer(group(value, r"^.+:(\d{1,5})\z"))


def to_number(value: Column) -> Column:
    return F.when(value.rlike(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*\z"), F.trim(value).try_cast("double"))


def to_integer(value: Column) -> Column:
    """Integers within 2^53-1, ``12.0`` included; anything else is null."""
    number = to_number(value)
    return F.when((number == F.floor(number)) & (F.abs(number) <= 9007199254740991), number.try_cast("bigint"))


def to_boolean(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False)


def notification_message(text: Column) -> Column:
    """Message of the older notification notation."""
    raw = F.regexp_replace(bracket(text, "Message"), r"^\"|\"\z", "")
    return F.coalesce(raw, group(text, rf"{_B}Message=\"([^\"]+)\""))


_ADDED = rf"<SHUDEvent_OnNotification>{WS}+Added notification{WS}+\"([^\"]*)\"{WS}+\[(\d+)\]{WS}+to queue\."


def notification(text: Column) -> Column:
    """``struct(id, message)`` from either notification notation."""
    # plain substring tests first: most records lack the older notation, and its patterns try every position
    low = F.lower(text)
    old_id = F.when(F.contains(low, F.lit("notificationid[")), bracket(text, "NotificationId"))
    told = F.contains(low, F.lit("message[")) | F.contains(text, F.lit('Message="'))
    old_message = F.when(told, notification_message(text))
    older = old_id.isNotNull() | old_message.isNotNull()
    return F.struct(
        F.when(older, old_id).otherwise(group(text, _ADDED, 2)).alias("id"),
        F.when(older, old_message).otherwise(group(text, _ADDED, 1)).alias("message"),
    )


def zero_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^0{8}(?:-0{4}){3}-0{12}\z"), F.lit(False))


def location_message(message: Column) -> Column:
    """A location notification without its closing colon."""
    return trim_ws(F.regexp_replace(message, rf":{WS}*\z", ""))


def display_text(value: Column, limit: int = 80) -> Column:
    """Text for display: control characters removed, long values cut with an ellipsis."""
    plain = F.nullif(trim_ws(F.regexp_replace(value, r"[\x00-\x1f\x7f]", "")), F.lit(""))
    return F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, limit - 1), F.lit("..."))).otherwise(plain)


def truncate_utf8(value: Column, limit: int) -> Column:
    """At most ``limit`` bytes, cut on a character boundary, with an ellipsis when shortened."""
    head = F.regexp_replace(
        F.make_valid_utf8(F.substring(F.encode(value, "UTF-8"), 1, limit - 3).cast("string")), r"\ufffd+\z", ""
    )
    return F.when(F.octet_length(value) > limit, F.concat(head, F.lit("..."))).otherwise(value)


def safe_name(value: Column) -> Column:
    """Class or shop vocabulary only: no paths, addresses or long digit runs."""
    ok = value.rlike(r"^[A-Za-z][A-Za-z0-9_ -]{0,127}\z") & ~value.rlike(r"\d{8,}")
    return F.when(ok, value)


def plain_number(value: Column) -> Column:
    return F.when(value.rlike(r"^\d+(?:\.\d+)?\z") & (value.try_cast("double") <= 9007199254740991), value.try_cast("double"))


def number_text(value: Column) -> Column:
    """A double without a trailing ``.0``."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def vehicle_display_name(class_name: Column) -> Column:
    s = F.regexp_replace(class_name, r"(?i)_SYNTH\z", "")
    s = F.regexp_replace(s, r"_\d+\z", "")
    return trim_ws(F.regexp_replace(F.regexp_replace(s, "_", " "), rf"{WS}+", " "))


def outcome_kind(result: Column) -> Column:
    """success, failure or unknown from a reported result word."""
    word = F.lower(F.coalesce(result, F.lit("")))
    return (
        F.when(word.isin("success", "succeed"), "success")
        .when(word.isin("failed", "fail", "failure", "error"), "failure")
        .otherwise("unknown")
    )


def normalize_record(text: Column) -> Column:
    """Record text on one line: inner line breaks and repeated stamps become a blank."""
    s = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, rf"{WS}*\n{WS}*", " ")).otherwise(text)
    s = F.regexp_replace(s, rf"{WS}<\d{{4}}-\d{{2}}-\d{{2}}T[^>]+>{WS}*", " ")
    return F.regexp_replace(s, rf"{WS}+\z", "")


def evidence_markers(text: Column, limit: int = 5) -> Column:
    """Angle tags, then keyed brackets, as ``<tag>`` and ``key[]``; the first ``limit`` of them."""
    tags = F.regexp_extract_all(text, F.lit(r"(<[^>]+>)"), F.lit(1))
    keys = F.regexp_extract_all(text, F.lit(rf"{_B}([A-Za-z][A-Za-z0-9_]*)\[[^\]]+\]"), F.lit(1))
    return F.slice(F.concat(tags, F.transform(keys, lambda k: F.concat(k, F.lit("[]")))), 1, limit)
