"""Environment facts along a log, channel conflicts, profile selection, build compatibility and coverage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import BUILD_FAMILIES, REGION_PATTERNS
from tracewright.functions.identity import (
    channel_from_path,
    environment_confidence,
    environment_key,
    release_channel,
    source_installation_id,
)
from tracewright.functions.text import bracket, clean, group, keyed, last_bracket
from tracewright.plans.scans import Lane, last, lowest, previous, scan, total

_WORD = r"([A-Za-z0-9_.:-]+)"
_B, _E = r"(?<!\w)", r"(?!\w)"


def _version(text: Column, key: str) -> Column:
    return clean(group(text, rf"(?i){_B}{key}{_E}\s*[:=]\s*{_WORD}"))


def line_evidence(text: Column) -> dict[str, Column]:
    """Environment facts stated by one line; each is null when the line does not state it."""
    init, version, database = (text.rlike(f"(?i)<{t}>") for t in ("Init", "Game Version", "SetDatabaseVersion"))
    file_version, product_version = _version(text, "FileVersion"), _version(text, "ProductVersion")
    init_tag = F.when(init, bracket(text, "Tag"))
    game_tag = F.when(version, last_bracket(text, "environment"))
    return {
        "ev_source": F.when(init, bracket(text, "SourcePath")),
        "ev_tag": F.coalesce(init_tag, game_tag),
        "ev_init_tag": init_tag,
        "ev_game_tag": game_tag,
        "ev_name": F.when(init, bracket(text, "Environment")),
        "ev_build": F.coalesce(F.when(version, bracket(text, "version")), file_version, product_version),
        "ev_branch": _version(text, "Branch"),
        "ev_changelist": _version(text, "Changelist"),
        "ev_database": F.when(database, bracket(text, "dataCore")),
    }


def channel_conflict(first: Column, second: Column) -> Column:
    """Two recognized channels on one line that differ."""
    a, b = release_channel(first), release_channel(second)
    return F.coalesce(a != b, F.lit(False))


def environment_timeline(
    rows: DataFrame,
    lane: Lane,
    defaults: Mapping[str, str] | None = None,
) -> DataFrame:
    """Forward-fill environment facts over rows that carry the ``ev_*`` columns.

    Rows whose own channel evidence conflicts contribute nothing (``conflict`` is true for them). A different source
    location, or a recognized channel that differs from the recognized channel in force, is a boundary: build, branch,
    changelist and database start over there, while tag, name and source keep filling.
    """
    d = {"source": "UNKNOWN_SOURCE", "tag": "UNKNOWN", "name": "UNKNOWN", "build": "UNKNOWN_BUILD", "branch": "UNKNOWN"}
    d.update(defaults or {})
    facts = ["source", "tag", "name", "build", "branch", "changelist", "database"]
    usable = rows.withColumn("conflict", channel_conflict(F.col("ev_init_tag"), F.col("ev_game_tag"))).withColumns(
        {f"ev_{f}": F.when(~F.col("conflict"), F.col(f"ev_{f}")) for f in facts}
    )
    order = list(lane.order)
    before = scan(
        usable,
        lane,
        {
            "_src": last(F.col("ev_source"), False),
            "_tag": last(F.col("ev_tag"), False),
        },
    )
    source_before = F.coalesce("_src", F.lit(d["source"]))
    channel_now = release_channel(F.col("ev_tag"))
    channel_before = release_channel(F.coalesce("_tag", F.lit(d["tag"])))
    boundary = F.coalesce(F.col("ev_source") != source_before, F.lit(False)) | F.coalesce(
        channel_now != channel_before, F.lit(False)
    )
    epochs = scan(
        before.withColumn("_boundary", boundary),
        lane,
        {
            "epoch": total(F.col("_boundary").cast("bigint")),
            "_boundary_at": last(F.when(F.col("_boundary"), F.struct(*order))),
            "env_source": last(F.col("ev_source")),
            "env_tag": last(F.col("ev_tag")),
            "env_name": last(F.col("ev_name")),
            **{f"_{f}": last(F.when(F.col(f"ev_{f}").isNotNull(), F.struct(F.struct(*order).alias("at"), F.col(f"ev_{f}").alias("v"))))
               for f in ("build", "branch", "changelist", "database")},
        },
    )

    def within(f: str) -> Column:
        fact = F.col(f"_{f}")
        fresh = F.col("_boundary_at").isNull() | (fact["at"] >= F.col("_boundary_at"))
        return F.when(fresh, fact["v"])

    filled = epochs.withColumns(
        {
            "env_source": F.coalesce("env_source", F.lit(d["source"])),
            "env_tag": F.coalesce("env_tag", F.lit(d["tag"])),
            "env_name": F.coalesce("env_name", F.lit(d["name"])),
            "env_build": F.coalesce(within("build"), F.lit(d["build"])),
            "env_branch": F.coalesce(within("branch"), F.lit(d["branch"])),
            "env_changelist": within("changelist"),
            "env_database": within("database"),
        }
    )
    channel = F.coalesce(release_channel(F.col("env_tag")), F.lit("UNKNOWN"))
    out = filled.withColumn("env_channel", channel).withColumn(
        "environment_key",
        environment_key(
            channel, F.lit("PU"), F.col("env_build"), F.col("env_branch"), source_installation_id(F.col("env_source"))
        ),
    )
    stated = F.coalesce(*[F.col(f"ev_{f}") for f in facts]).isNotNull()
    confidence = F.when(F.col("ev_tag").isNotNull(), "high").otherwise(
        environment_confidence(channel, F.col("env_build"), F.col("env_branch"), F.col("env_name"))
    )
    drop = ["_src", "_tag", "_boundary", "_boundary_at", "_build", "_branch", "_changelist", "_database"]
    return out.withColumn("stated", stated).withColumn("env_confidence", F.when(stated, confidence)).drop(*drop)


def environment_switches(timeline: DataFrame, lane: Lane) -> DataFrame:
    """Rows where the environment key differs from the row before."""
    seen = scan(timeline, lane, {"previous_key": previous(F.col("environment_key"))})
    return seen.where(F.col("previous_key") != F.col("environment_key"))


def environment_partitions(timeline: DataFrame, order: list[str]) -> DataFrame:
    """One row per environment key: the latest context wins."""
    context = ["env_channel", "env_name", "env_tag", "env_build", "env_branch", "env_changelist", "env_database"]
    return (
        timeline.groupBy("environment_key")
        .agg(F.max_by(F.struct(*context), F.struct(*order)).alias("c"), F.count(F.lit(1)).alias("rows"))
        .select("environment_key", "rows", "c.*")
    )


def build_evidence(records: DataFrame, lane: Lane, initial_build: Column | None = None) -> DataFrame:
    """Record-level facts: last value per field; the game version keeps its first file version until an explicit one."""
    text = F.col("text")
    init, version, database = (F.contains(text, F.lit(f"<{t}>")) for t in ("Init", "Game Version", "SetDatabaseVersion"))
    file_version, product_version = keyed(text, "FileVersion"), keyed(text, "ProductVersion")
    spots = {
        "b_file": F.when(F.contains(text, F.lit("FileVersion")), file_version),
        "b_product": F.when(F.contains(text, F.lit("ProductVersion")), product_version),
        "b_branch": F.when(text.rlike("(?i)branch"), keyed(text, "Branch")),
        "b_changelist": F.when(text.rlike("(?i)changelist"), keyed(text, "Changelist")),
        "b_name": F.when(init, bracket(text, "Environment")),
        "b_tag": F.coalesce(F.when(init, bracket(text, "Tag")), F.when(version, last_bracket(text, "environment"))),
        "b_config": F.when(init, bracket(text, "Config")),
        "b_source": F.when(init, bracket(text, "SourcePath")),
        "b_game": F.when(version, bracket(text, "version")),
        "b_data": F.when(database, bracket(text, "dataCore")),
        "b_archetype": F.when(database, bracket(text, "archetype")),
        "b_component": F.when(database, bracket(text, "component")),
    }
    known = records.withColumns(spots)
    implied = F.coalesce("b_file", "b_product")
    values = {n: last(F.col(n)) for n in spots}
    values["_implied"] = lowest(F.when(implied.isNotNull(), F.struct(*lane.order, implied.alias("v"))))
    values["b_channel"] = last(release_channel(F.col("b_tag")))
    out = scan(known, lane, values)
    start = initial_build if initial_build is not None else F.lit(None).cast("string")
    return out.withColumn("b_game", F.coalesce(F.col("b_game"), start, F.col("_implied.v"))).drop("_implied")


# --- channel gate -----------------------------------------------------------------------------------------------------
def observed_channels(text: Column) -> Column:
    """Every release-channel word a line states, upper case."""
    names = "(TECH-PREVIEW|LIVE|EPTU|PTU|HOTFIX)"
    none = F.array().cast("array<string>")

    def all_of(pattern: str, when: Column) -> Column:
        return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(none)

    init, version = text.rlike("(?i)<Init>"), text.rlike("(?i)<Game Version>")
    found = F.concat(
        all_of(rf"(?i){_B}Tag\[([^\]]+)\]", init),
        all_of(rf"(?i){_B}environment\[([^\]]+)\]", version),
        all_of(rf"(?i){_B}version\[[^\]]*?-{names}{_E}", version),
        all_of(rf"(?i){_B}(?:FileVersion|ProductVersion){_E}\s*[:=]\s*[A-Za-z0-9.]+-{names}{_E}", F.lit(True)),
    )
    return F.array_distinct(F.transform(found, lambda c: F.upper(F.trim(c))))


def channel_gate(observed: DataFrame, keys: list[str], expected: Column | None = None) -> DataFrame:
    """Verdict per source over rows with a ``channel`` column (null when none): blocked on conflict.

    Only the smallest and largest channel are kept per source; they differ exactly when there is more than one.
    """
    agg = observed.groupBy(*keys).agg(F.min("channel").alias("_lo"), F.max("channel").alias("_hi"))
    want = expected if expected is not None else F.lit(None).cast("string")
    clash = F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)) | F.coalesce(
        (F.col("_lo") != want) | (F.col("_hi") != want), F.lit(False)
    )
    return agg.select(
        *keys,
        F.col("_lo").alias("channel_low"),
        F.col("_hi").alias("channel_high"),
        F.when(clash, "environment_mismatch").otherwise("ok").alias("status"),
    )


# --- profiles ---------------------------------------------------------------------------------------------------------
def build_family(build: Column) -> Column:
    """``struct(major, minor)`` of a dotted build version."""
    pattern = r"^(\d+)\.(\d+)(?:[.\-]|\z)"
    return F.struct(
        group(build, pattern, 1).try_cast("int").alias("major"), group(build, pattern, 2).try_cast("int").alias("minor")
    )


def select_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Best matching profile per row: same family, channel, universe and branch; highest priority, then id, version.

    The reviewed profile table has a few rows per build family. They are gathered into one sorted array per family, so
    the join is one small lookup and picking the best profile is an array filter: the rows are not shuffled.
    """
    entry = F.struct(
        (-F.col("priority")).alias("rank"), "profile_id", "version", "channels", "universes", "branches",
        "tested_builds", F.col("exclusions").alias("excluded_builds"),
    )
    families = profiles.groupBy(F.col("major").alias("_major"), F.col("minor").alias("_minor")).agg(
        F.array_sort(F.collect_list(entry)).alias("_profiles")
    )
    family = build_family(F.col("build"))
    fits = F.filter(
        "_profiles",
        lambda p: F.array_contains(p["channels"], F.col("channel"))
        & F.array_contains(p["universes"], F.col("universe"))
        & F.array_contains(p["branches"], F.col("branch")),
    )
    picked = (
        rows.withColumns({"_major": family["major"], "_minor": family["minor"]})
        .join(F.broadcast(families), ["_major", "_minor"], "left")
        .withColumn("_best", F.try_element_at(fits, F.lit(1)))
    )
    return picked.select(
        *rows.columns, "_best.profile_id", "_best.version", "_best.tested_builds", "_best.excluded_builds"
    )


def build_compatibility(selected: DataFrame) -> DataFrame:
    """compatible / unverified_build / unsupported_profile with the basis of the decision."""
    none = F.col("profile_id").isNull()
    excluded = F.coalesce(F.array_contains("excluded_builds", F.col("build")), F.lit(False))
    tested = F.coalesce(F.array_contains("tested_builds", F.col("build")), F.lit(False))
    return selected.withColumns(
        {
            "status": F.when(none | excluded, "unsupported_profile").when(tested, "compatible").otherwise("unverified_build"),
            "reason": F.when(none, "no_compatible_profile")
            .when(excluded, "build_explicitly_excluded")
            .when(tested, "profile_compatible")
            .otherwise("build_not_tested"),
            "basis": F.when(none, "no_family_match")
            .when(excluded, "exact_exclusion")
            .when(tested, "exact_tested_build")
            .otherwise("major_minor_family_match"),
        }
    ).drop("tested_builds", "excluded_builds")


def validate_profiles(profiles: DataFrame, rules: DataFrame, event_fields: DataFrame) -> DataFrame:
    """Rule-set defects as (profile_id, rule_id, code)."""
    none = F.lit(None).cast("string")

    def found(df: DataFrame, code: str, rule: Column) -> DataFrame:
        return df.select("profile_id", rule.alias("rule_id"), F.lit(code).alias("code"))

    dup_profiles = profiles.groupBy("profile_id").count().where("count > 1")
    dup_rules = rules.groupBy("profile_id", "rule_id").count().where("count > 1")
    known = event_fields.groupBy("event_type").agg(F.collect_set("field").alias("_fields"))
    mapped = rules.join(known, "event_type", "left")
    has_type, required = F.col("event_type").isNotNull(), F.coalesce(F.size("required"), F.lit(0)) > 0
    rule = F.col("rule_id")
    parts = [
        found(dup_profiles, "duplicate_profile_id", none),
        found(profiles.where(F.coalesce(F.size("tested_builds"), F.lit(0)) < 1), "invalid_tested_builds", none),
        found(profiles.where(F.col("major").isNull() | F.col("minor").isNull()), "invalid_profile_family", none),
        found(dup_rules, "duplicate_extractor_id", rule),
        found(rules.where(F.coalesce(F.size("literals"), F.lit(0)) < 1), "invalid_dispatch_literals", rule),
        found(mapped.where(has_type & F.col("_fields").isNull()), "unknown_event_type", rule),
        found(mapped.where(has_type & ~required), "invalid_required_fields", rule),
        found(
            mapped.where(F.col("_fields").isNotNull() & required & (F.size(F.array_except("required", "_fields")) > 0)),
            "unknown_required_field",
            rule,
        ),
        found(rules.where(~has_type & required), "state_extractor_event_metadata", rule),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def family_of(build: Column) -> Column:
    number = build.try_cast("bigint")
    out = F.lit("pre-4.4")
    for bound, name in reversed(BUILD_FAMILIES[:-1]):
        out = F.when(number >= bound, name).otherwise(out)
    return out


def build_coverage(observed: DataFrame, supported: DataFrame, family: Column | None = None) -> DataFrame:
    """Observed builds with file counts against supported ones: ``(build, family, files, status)``."""
    counts = observed.groupBy("build").agg(F.count(F.lit(1)).alias("files"))
    joined = counts.join(supported.select("build").distinct().withColumn("_ok", F.lit(True)), "build", "left")
    return joined.select(
        "build",
        (family if family is not None else family_of(F.col("build"))).alias("family"),
        "files",
        F.when(F.col("_ok"), "supported").otherwise("not_evaluated").alias("status"),
    )


def coverage_by_family(coverage: DataFrame) -> DataFrame:
    ok = F.col("status") == "supported"
    return coverage.groupBy("family").agg(
        F.count(F.lit(1)).alias("builds"),
        F.sum("files").alias("files"),
        F.count_if(ok).alias("supported_builds"),
        F.sum(F.when(ok, F.col("files")).otherwise(0)).alias("supported_files"),
    )


def shard_region(label: Column) -> Column:
    """``struct(region, segment, confidence)`` from the first name segment that follows a naming convention."""

    def region(segment: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(REGION_PATTERNS):
            out = F.when(segment.rlike(pattern), name).otherwise(out)
        return out

    segments = F.filter(F.split(label, "[^A-Za-z0-9]+"), lambda s: (s != "") & region(s).isNotNull())
    hit = F.try_element_at(segments, F.lit(1))
    return F.struct(
        F.coalesce(region(hit), F.lit("UNKNOWN")).alias("region"),
        hit.alias("segment"),
        F.when(hit.isNull(), "unknown").otherwise("medium").alias("confidence"),
    )


def expected_channel(path: Column) -> Column:
    return channel_from_path(path)


