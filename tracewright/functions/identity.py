"""Stable identifiers and keys. Ids are stable under re-reading; they are not byte-equal to any other producer's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.constants import RELEASE_CHANNELS
from tracewright.functions.text import trim_ws


def _text(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(trim_ws(value.cast("string")), F.lit("")), F.lit(default))


def release_channel(value: Column) -> Column:
    """A known release channel in upper case, otherwise null."""
    up = F.upper(trim_ws(value))
    return F.when(up.isin(*RELEASE_CHANNELS), up)


def channel_from_path(path: Column) -> Column:
    """The deepest path segment that names a release channel."""
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.upper(F.trim(p)))
    return F.try_element_at(F.filter(parts, lambda p: p.isin(*RELEASE_CHANNELS)), F.lit(-1))


def source_installation_id(location: Column) -> Column:
    path = F.lower(F.replace(trim_ws(location), F.lit("\\"), F.lit("/")))
    return F.when(F.coalesce(path, F.lit("")) == "", "UNKNOWN_INSTALLATION").otherwise(
        F.concat(F.lit("src_"), F.substring(F.sha2(path, 256), 1, 16))
    )


def _key_part(value: Column) -> Column:
    encoded = F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("%"), F.lit("~"))
    return F.regexp_replace(encoded, r"[^\w.~:-]", "_")


def environment_key(channel: Column, universe: Column, build: Column, branch: Column, installation: Column) -> Column:
    """The partition key of every operator: five encoded parts joined by ``::``."""
    return F.concat_ws(
        "::",
        _key_part(F.coalesce(release_channel(channel), F.lit("UNKNOWN"))),
        _key_part(F.when(F.upper(universe) == "PU", "PU").otherwise("UNKNOWN")),
        _key_part(_text(build, "UNKNOWN_BUILD")),
        _key_part(_text(branch, "UNKNOWN")),
        _key_part(_text(installation, "UNKNOWN_INSTALLATION")),
    )


def environment_confidence(channel: Column, build: Column, branch: Column, name: Column) -> Column:
    has_channel = F.coalesce(channel, F.lit("UNKNOWN")) != "UNKNOWN"
    has_build = F.coalesce(build, F.lit("UNKNOWN_BUILD")) != "UNKNOWN_BUILD"
    has_branch = F.coalesce(branch, F.lit("UNKNOWN")) != "UNKNOWN"
    has_name = F.coalesce(name, F.lit("UNKNOWN")) != "UNKNOWN"
    return (
        F.when(has_channel & has_build & has_branch, "confirmed")
        .when(has_channel & (has_build | has_name), "high")
        .when(has_channel | has_build | has_branch | has_name, "medium")
        .otherwise("unknown")
    )


def digest(parts: Sequence[Column], length: int) -> Column:
    """Hex prefix of SHA-256 over the parts, each with its byte length so that parts cannot run into each other."""
    text = [F.coalesce(p.cast("string"), F.lit("UNKNOWN")) for p in parts]
    framed = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in text]
    return F.substring(F.sha2(F.concat_ws("|", *framed), 256), 1, length)


def scoped_id(environment: Column, namespace: str, parts: Sequence[Column]) -> Column:
    """``namespace_`` plus 24 hex digits; the same parts in another environment give another id."""
    return F.concat(F.lit(f"{namespace}_"), digest([environment, F.lit(namespace), *parts], 24))


def event_id(parts: Sequence[Column]) -> Column:
    """Event id over identity fields only: neither ingestion time nor ordering may be among ``parts``."""
    return F.concat(F.lit("rte_v1_"), digest(parts, 32))


def padded(value: Column) -> Column:
    number = F.when(value >= 0, value).otherwise(F.lit(0))
    return F.lpad(F.coalesce(number, F.lit(0)).cast("bigint").cast("string"), 16, "0")


def order_key(ms: Column, sequence: Column, generation: Column, offset: Column, ident: Column) -> Column:
    """Total order of events as one comparable string."""
    return F.concat_ws(
        "::", padded(ms), padded(sequence), padded(generation), padded(offset), F.coalesce(ident.cast("string"), F.lit(""))
    )
