"""Server sessions, leave attribution, shard sightings, user activity and party comms from log lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import CONTEXT_RADIUS
from tracewright.functions.text import bracket, clean, group
from tracewright.plans.scans import TARGET_ROWS, Lane, last, previous, scan, split_keys
from tracewright.plans.settle import settle

_B, _E = r"(?<!\w)", r"(?!\w)"
_WORD = r"([A-Za-z0-9_.:-]+)"
LEAVE = rf"(?i){_B}(?:disconnect|disconnected|connection lost|leaving server|leave pu|session ended|logout|quit){_E}"


# --- line extraction --------------------------------------------------------------------------------------------------
def session_marks(text: Column) -> dict[str, Column]:
    """Join and leave facts of a line."""
    join, leave = text.rlike("(?i)<Join PU>"), text.rlike(LEAVE)
    rules = F.coalesce(
        clean(group(text, rf'(?i){_B}gamerules{_E}\s*[=:]\s*"([^"]+)"')),
        clean(group(text, rf"(?i){_B}gamerules{_E}\s*[=:]\s*{_WORD}")),
    )
    front = F.lower(F.coalesce(rules, F.lit(""))) == "sc_frontend"
    return {
        "is_join": join,
        "is_leave": ~join & leave & ~front,
        "shard": F.when(join, bracket(text, "shard")),
        "address": F.when(join, bracket(text, "address")),
        "port": F.when(join, bracket(text, "port")),
        "endpoint": F.when(leave, clean(group(text, rf"(?i){_B}remoteAddr{_E}\s*[=:]\s*([A-Za-z0-9_.:-]+:\d+)"))),
    }


def shard_facts(text: Column) -> dict[str, Column]:
    """Shard id, name, region and build stated by a line."""

    def first(*patterns: str) -> Column:
        return clean(F.coalesce(*[group(text, p) for p in patterns]))

    stop = r"""(?=\s+[A-Za-z_]+(?:\s*[:=]|["'\s:=])|\z)"""
    return {
        "shard_id": first(
            rf"(?i){_B}ShardID{_E}\s*[:=]\s*{_WORD}", rf"(?i){_B}shard_id{_E}[\"'\s:=]+{_WORD}",
            rf"(?i){_B}shardId{_E}[\"'\s:=]+{_WORD}", rf"(?i){_B}shard{_E}\s*[:=]\s*{_WORD}",
            rf"(?i){_B}shard\[([A-Za-z0-9_.:-]+)\]",
        ),
        "shard_name": first(
            rf"(?i){_B}ShardName{_E}\s*[:=]\s*([^,;\])<]+?){stop}", rf"(?i){_B}shard_name{_E}[\"'\s:=]+([^,;\])<]+)",
            rf"(?i){_B}ServerName{_E}\s*[:=]\s*([^,;\])<]+?){stop}", rf"(?i){_B}server_name{_E}[\"'\s:=]+([^,;\])<]+)",
        ),
        "region": first(rf"(?i){_B}Region{_E}\s*[:=]\s*{_WORD}", rf"(?i){_B}region{_E}[\"'\s:=]+{_WORD}"),
        "shard_build": first(rf"(?i){_B}Build{_E}\s*[:=]\s*{_WORD}", rf"(?i){_B}build_version{_E}[\"'\s:=]+{_WORD}"),
    }


def party_comms(lines: DataFrame) -> DataFrame:
    """Lines that report a party member entering or leaving comms range."""
    text = F.col("text")
    pattern = (
        r"(?i)(?:^|>\s*)([A-Za-z0-9_.-]{2,64})\s+(disconnected|connected)\.?\s*.*(?<!\w)Action\s*:\s*(Add|Remove)"
        r"(?!\w).*\[Team_CoreGameplayFeatures\]\[Missions\]\[Comms\]"
    )
    gone = (F.lower(group(text, pattern, 2)) == "disconnected") | (F.lower(group(text, pattern, 3)) == "remove")
    return lines.select(
        *[c for c in lines.columns if c != "text"],
        group(text, pattern, 1).alias("member"),
        F.when(gone, "party_comms_disconnect").otherwise("party_comms_connect").alias("transition"),
    ).where(F.col("member").isNotNull())


# --- sessions ---------------------------------------------------------------------------------------------------------
def server_sessions(rows: DataFrame, keys: Sequence[str], pos: str, ms: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per join with where it was closed by the next join or by a change of environment.

    Expects ``is_join`` and ``environment_key``. Open sessions have null ends.
    """
    cut, lane = split_keys(rows, keys, [pos], target_rows)
    seen = scan(cut, lane, {"_env": previous(F.col("environment_key"))})
    moved = F.coalesce(F.col("_env") != F.col("environment_key"), F.lit(False))
    marks = seen.where(F.col("is_join") | moved).drop("_chunk").withColumn("_back", -F.col(pos))
    back, lane_back = split_keys(marks, keys, ["_back"], target_rows)
    after = scan(back, lane_back, {"_next": previous(F.struct(F.col(pos).alias("pos"), F.col(ms).alias("ms"), "environment_key"))})
    changed = F.col("_next.environment_key") != F.col("environment_key")
    return after.where("is_join").select(
        *keys,
        "environment_key",
        F.col(pos).alias("start_pos"),
        F.col(ms).alias("started_ms"),
        F.when(changed, F.col("_next.pos")).otherwise(F.col("_next.pos") - 1).alias("end_pos"),
        F.col("_next.ms").alias("ended_ms"),
        F.when(F.col("_next").isNull(), F.lit(None).cast("string"))
        .when(changed, "environment_changed")
        .otherwise("superseded_by_join")
        .alias("stale_reason"),
    )


def _attribute(keys: list[str], recent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, current, older = None, None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                k = tuple(getattr(r, c) for c in keys)
                if k != key:
                    key, current, older = k, None, []
                if current and current[0] != r.environment_key:
                    current = None
                if r.is_join:
                    if current:
                        older = [current, *older][:recent]
                    current = (r.environment_key, r.pos, f"{r.address}:{r.port}")
                elif r.is_leave:
                    able = [s for s in [current, *older] if s and s[0] == r.environment_key]
                    same = [s for s in able if r.endpoint and s[2] == r.endpoint]
                    hit = same[0] if len(same) == 1 else able[0] if not same and len(able) == 1 else None
                    out.append((*k, r.pos, hit[1] if hit else None))
                    if hit is not None and hit is current:
                        current = None
                    elif hit is not None:
                        older = [s for s in older if s is not hit]
            yield pd.DataFrame(out, columns=[*keys, "leave_pos", "session_pos"]).astype({"session_pos": "Int64"})

    return run


def attribute_leaves(rows: DataFrame, keys: Sequence[str], pos: str, recent: int = 8, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Each leave with the session it ends, or null when unattributed.

    An endpoint that matches exactly one of the current and the last ``recent`` sessions of the same environment wins,
    several matches leave it unattributed, none falls back to the only candidate. An attributed session is used up, which
    later leaves depend on, so the walk is ordered. Only joins, leaves and the first row of each environment run take
    part, and the state is ``recent + 1`` sessions.
    """
    keys = list(keys)
    cut, lane = split_keys(rows, keys, [pos], target_rows)
    seen = scan(cut, lane, {"_env": previous(F.col("environment_key"))})
    moved = F.coalesce(F.col("_env") != F.col("environment_key"), F.lit(False))
    marks = seen.where(F.col("is_join") | F.col("is_leave") | moved).select(
        *keys, F.col(pos).alias("pos"), "environment_key", "is_join", "is_leave", "address", "port", "endpoint"
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return (
        marks.repartition(*keys)
        .sortWithinPartitions(*keys, "pos")
        .mapInPandas(_attribute(keys, recent), f"{head}, leave_pos bigint, session_pos bigint")
    )


def closed_sessions(
    rows: DataFrame, keys: Sequence[str], pos: str, ms: str, recent: int = 8, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Server sessions that a leave ends, with their number of actions.

    Expects the columns of ``attribute_leaves`` and ``is_action``. A leave attributed to a session ends it at the leave and clears its stale
    reason, also where the next join had closed it before. A session counts the leave and the actions after its join for as long as
    it is the current one: up to the next join, the next change of environment or its own leave, whichever comes first. Joins
    and leaves are no actions themselves.
    """
    keys = list(keys)
    opened = settle(server_sessions(rows, keys, pos, ms, target_rows))
    left = attribute_leaves(rows, keys, pos, recent, target_rows).where(F.col("session_pos").isNotNull())
    times = rows.where("is_leave").select(*keys, F.col(pos).alias("leave_pos"), F.col(ms).alias("leave_ms"))
    left = left.join(times, [*keys, "leave_pos"]).withColumnRenamed("session_pos", "start_pos")
    both = opened.join(left, [*keys, "start_pos"], "left")
    # the first position at which the session is no longer the current one
    until = F.least(
        F.when(F.col("stale_reason") == "superseded_by_join", F.col("end_pos") + 1).otherwise(F.col("end_pos")), F.col("leave_pos")
    )
    marks = rows.where(F.col("is_action") & ~F.col("is_join") & ~F.col("is_leave")).select(
        *keys, F.col(pos).alias("pos"), F.lit(None).cast("bigint").alias("start_pos"), F.lit(None).cast("bigint").alias("until")
    )
    starts = both.select(*keys, F.col("start_pos").alias("pos"), "start_pos", until.cast("bigint").alias("until"))
    cut, lane = split_keys(marks.unionByName(starts), keys, ["pos"], target_rows)
    current = scan(cut, lane, {"_at": last(F.when(F.col("start_pos").isNotNull(), F.struct("start_pos", "until")))})
    within = F.col("start_pos").isNull() & (F.col("_at.until").isNull() | (F.col("pos") < F.col("_at.until")))
    counts = current.where(F.col("_at").isNotNull() & within).groupBy(*keys, F.col("_at.start_pos").alias("start_pos")).agg(
        F.count(F.lit(1)).alias("_actions")
    )
    gone = F.col("leave_pos").isNotNull()
    return both.join(counts, [*keys, "start_pos"], "left").select(
        *keys, "environment_key", "start_pos", "started_ms",
        F.coalesce("leave_pos", "end_pos").alias("end_pos"),
        F.when(gone, F.col("leave_ms")).otherwise(F.col("ended_ms")).alias("ended_ms"),
        F.when(~gone, F.col("stale_reason")).alias("stale_reason"),
        (F.coalesce("_actions", F.lit(0)) + gone.cast("bigint")).cast("bigint").alias("action_count"),
    )


def session_stats(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and durations per key; with ``action_count`` (see ``closed_sessions``) also the actions of all sessions."""
    actions = [F.sum("action_count").alias("actions")] if "action_count" in sessions.columns else []
    return sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count("ended_ms").alias("closed"),
        F.sum(F.col("ended_ms") - F.col("started_ms")).alias("duration_ms"),
        F.count_if(F.col("stale_reason") == "environment_changed").alias("environment_changes"),
        *actions,
    )


# --- shard sightings --------------------------------------------------------------------------------------------------
def shard_sightings(lines: DataFrame, keys: Sequence[str], radius: int = CONTEXT_RADIUS) -> DataFrame:
    """Sightings with missing facts taken from the lines within ``radius``; later context lines win.

    ``lines`` carries ``line_no``, ``ms`` and the shard facts. Only lines with facts can contribute, so each sighting
    looks up its ``2 * radius + 1`` neighbouring line numbers in those by equality: no window over the source.
    """
    facts = ["shard_id", "shard_name", "region", "shard_build"]
    known = lines.where(F.col("shard_id").isNotNull() | F.col("shard_name").isNotNull())
    near = known.select(
        *keys, F.col("line_no").alias("_at"), F.explode(F.sequence(F.col("line_no") - radius, F.col("line_no") + radius)).alias("line_no")
    )
    context = known.select(*keys, "line_no", *[F.col(f).alias(f"_{f}") for f in facts])
    gathered = near.join(context, [*keys, "line_no"]).groupBy(*keys, "_at").agg(
        *[F.max_by(f"_{f}", F.when(F.col(f"_{f}").isNotNull(), F.col("line_no"))).alias(f"_{f}") for f in facts]
    )
    return known.join(gathered.withColumnRenamed("_at", "line_no"), [*keys, "line_no"]).select(
        *[c for c in known.columns if c not in facts], *[F.coalesce(f, f"_{f}").alias(f) for f in facts]
    )


def merge_sightings(sightings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (environment, shard id, shard name): first and last time seen, first known region and build."""

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias(name)

    keyed = sightings.withColumns(
        {"shard_id": F.coalesce("shard_id", F.lit("unknown")), "shard_name": F.coalesce("shard_name", F.lit("unknown"))}
    )
    return keyed.groupBy(*keys, "shard_id", "shard_name").agg(
        F.count(F.lit(1)).alias("sightings"),
        F.min("line_no").alias("line_no"),
        F.min_by("ms", "line_no").alias("first_ms"),
        F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("line_no"))).alias("last_ms"),
        first("region"),
        first("shard_build"),
    )


# --- user activity ----------------------------------------------------------------------------------------------------
def user_facts(text: Column) -> Column:
    """The user id a line states."""
    names = "userId|user_id|accountId|account_id|playerId|player_id|citizenId|citizen_id"
    return clean(
        F.coalesce(
            group(text, rf"(?i){_B}(?<!shard)(?:{names}){_E}\s*[:=]\s*{_WORD}"),
            group(text, rf"(?i){_B}(?<!shard)(?:{names}){_E}\s+{_WORD}"),
            group(text, rf'(?i)"(?:{names})"\s*:\s*"?{_WORD}'),
        )
    )


def id_mentions(base: DataFrame, seeds: Sequence[str] = ()) -> DataFrame:
    """Inverted index of ids: ``environment_key, pos, _id, known_id``, one row per line and id that its text contains.

    An id holds only characters of ``_WORD``, so wherever a text contains it, it lies inside one token (a maximal run of them). Tokens are
    cut once per environment into their parts of the lengths that ids have, and parts meet ids by equality. The driver learns the
    distinct lengths of ids, nothing else. Seeds are arguments and may hold any character; they are tested on the text.
    """
    ids = base.where(F.col("_id").isNotNull()).select("environment_key", F.col("_id").alias("known_id")).distinct()
    lengths = sorted(r[0] for r in ids.select(F.length("known_id")).distinct().collect())
    token = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_.:-]+"), F.lit(0)))).alias("token")
    tokens = base.select("environment_key", "pos", "_id", token)
    starts = F.expr("sequence(1, length(token) - size + 1)")
    parts = (
        tokens.select("environment_key", "token").distinct()
        .select("environment_key", "token", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("size"))
        .where(F.length("token") >= F.col("size"))
        .select("environment_key", "token", F.explode(
            F.array_distinct(F.transform(starts, lambda i: F.substr(F.col("token"), i, F.col("size"))))
        ).alias("known_id"))
    )
    holds = parts.join(ids, ["environment_key", "known_id"], "left_semi")
    found = tokens.join(holds, ["environment_key", "token"]).select("environment_key", "pos", "_id", "known_id")
    given = [F.when(F.contains("text", F.lit(s)), F.lit(s)) for s in dict.fromkeys(seeds) if s]
    if given:
        named = F.explode(F.array_compact(F.array(*given))).alias("known_id")
        found = found.unionByName(base.select("environment_key", "pos", "_id", named))
    return found.distinct()


def user_activity(lines: DataFrame, username: str, seeds: Sequence[str] = ()) -> DataFrame:
    """Lines that mention ``username`` or an id learned earlier in the same environment.

    ``lines`` carries environment_key, pos and text. Lines naming the user teach the id they state; lines mentioning a
    known id from its first position on teach theirs. The index of mentions is built once. Each round joins it by (environment, id) with the
    ids that the round before has learned or found earlier than known, and ends when there are none, however long the chain.
    """
    named = F.coalesce(F.contains(F.lower("text"), F.lit(username.lower())), F.lit(False))
    stated = user_facts(F.col("text"))
    base = settle(lines.withColumns({"_id": F.when(stated != "", stated), "_named": named}))
    mentions = settle(id_mentions(base, seeds))
    key = ["environment_key", "known_id"]
    new = base.where(F.col("_named") & F.col("_id").isNotNull()).select("environment_key", F.col("_id").alias("known_id"), F.col("pos").alias("since"))
    if seeds:
        seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("known_id")
        new = new.unionByName(
            base.select("environment_key").distinct().select("environment_key", seed, F.lit(-1).cast("bigint").alias("since"))
        )
    known = new = settle(new.groupBy(*key).agg(F.min("since").alias("since")))
    teaching = mentions.where(F.col("_id").isNotNull() & (F.col("_id") != F.col("known_id")))
    while True:
        taught = (
            teaching.join(new, key)
            .where(F.col("pos") >= F.col("since"))
            .groupBy("environment_key", F.col("_id").alias("known_id"))
            .agg(F.min("pos").alias("since"))
        )
        before = known.withColumnRenamed("since", "_since")
        new = settle(
            taught.join(before, key, "left").where(F.col("_since").isNull() | (F.col("since") < F.col("_since"))).drop("_since")
        )
        if new.isEmpty():
            break
        known = settle(known.unionByName(new).groupBy(*key).agg(F.min("since").alias("since")))
    mentioned = (
        mentions.join(known, key)
        .where(F.col("pos") >= F.col("since"))
        .select("environment_key", "pos")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return base.join(mentioned, ["environment_key", "pos"], "left").where(F.col("_named") | F.col("_hit")).select(
        *lines.columns, F.col("_id").alias("user_id")
    )


__all__ = ["Lane", "attribute_leaves", "closed_sessions", "id_mentions", "merge_sightings", "party_comms", "server_sessions", "session_marks",
           "session_stats", "shard_facts", "shard_sightings", "user_activity", "user_facts"]
