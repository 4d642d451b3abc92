"""Stateful correlation as DataFrame plans: begin/end pairs, ordered sequences, intervals, transitions, purchases."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import PURCHASE_WINDOW_MS
from tracewright.functions.instants import ordered_within
from tracewright.plans.scans import TARGET_ROWS, highest, last, previous, scan, split_keys, top_n, total
from tracewright.plans.settle import settle

#: rows of a task where related events are grouped, and values that may be broadcast
TASK_ROWS, FEW_VALUES = 500_000, 50_000


def asof_last(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], trigger: Column, facts: dict[str, Column],
    target_rows: int = TARGET_ROWS, inclusive: bool = True,
) -> DataFrame:
    """Trigger rows with the last known value of each fact (null facts do not overwrite)."""
    cut, lane = split_keys(rows, keys, order, target_rows)
    return scan(cut.withColumn("_trigger", trigger), lane, {n: last(c, inclusive) for n, c in facts.items()}).where(
        "_trigger"
    ).drop("_trigger")


def asof_semi(rows: DataFrame, keys, order, keep: Column, own: Column, known: Column, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Rows passing ``keep`` whose ``own`` value equals the last ``known`` value at that time."""
    cut, lane = split_keys(rows, keys, order, target_rows)
    seen = scan(cut.withColumn("_keep", keep).withColumn("_own", own), lane, {"_known": last(known)})
    return seen.where(F.col("_keep") & (F.col("_own") == F.col("_known"))).drop("_keep", "_own", "_known")


def pair_begin_end(
    rows: DataFrame, keys, order, is_begin: Column, is_end: Column, ms: str, accept: Column | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """End rows directly preceded (among begins and ends) by a begin: begin time, duration never negative."""
    marks = rows.withColumns({"_b": is_begin, "_ok": accept if accept is not None else F.lit(True)}).where(is_begin | is_end)
    cut, lane = split_keys(marks, keys, order, target_rows)
    paired = scan(cut, lane, {"_p": previous(F.struct("_b", "_ok", F.col(ms).alias("ms"), F.col(order[-1]).alias("ref")))})
    hit = ~F.col("_b") & F.coalesce(F.col("_p._b") & F.col("_p._ok"), F.lit(False))
    return paired.where(hit).select(
        *rows.columns,
        F.col("_p.ref").alias("begin_ref"),
        F.greatest(F.lit(0), F.col(ms) - F.col("_p.ms")).cast("bigint").alias("duration_ms"),
    )


def sequence_match(
    rows: DataFrame, keys, order, ms: str, start: Column, steps: Sequence[Column], reset: Column, within_ms: int,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """One match per session for ``start -> step1 -> step2 -> step3``, each leg at most ``within_ms``.

    A session opens at ``start`` and ends at a reset or the next start. A later first step replaces the earlier one and
    voids the second; a second step outside its window is ignored. The first qualifying third step wins.
    """
    first, second, third = steps
    pos = F.struct(*order)
    cut, lane = split_keys(
        rows.withColumns({"_go": start, "_s1": first, "_s2": second, "_s3": third, "_stop": reset}), keys, order, target_rows
    )
    one = scan(cut, lane, {
        "_start": last(F.when(F.col("_go"), F.struct(pos.alias("at"), F.col(ms).alias("ms"))), False),
        "_end": last(F.when(F.col("_stop"), pos), False),
        "_one": last(F.when(F.col("_s1"), F.struct(pos.alias("at"), F.col(ms).alias("ms"))), False),
    })
    open_ = F.col("_start").isNotNull() & (F.col("_end").isNull() | (F.col("_end") < F.col("_start.at")))
    has_one = F.col("_open") & F.coalesce(F.col("_one.at") > F.col("_start.at"), F.lit(False))
    two_ok = F.col("_s2") & has_one & ordered_within(F.col("_one.ms"), F.col(ms), within_ms)
    two = scan(one.withColumn("_open", open_), lane, {
        "_two": last(F.when(two_ok, F.struct(pos.alias("at"), F.col(ms).alias("ms"))), False),
    })
    done = (
        F.col("_s3") & has_one & F.coalesce(F.col("_two.at") > F.col("_one.at"), F.lit(False))
        & ordered_within(F.col("_start.ms"), F.col("_one.ms"), within_ms)
        & ordered_within(F.col("_one.ms"), F.col("_two.ms"), within_ms)
        & ordered_within(F.col("_two.ms"), F.col(ms), within_ms)
    )
    hits = two.where(done).withColumn("_sid", F.col("_start.at"))
    refs = [F.col(f"_start.at.{order[-1]}").alias("start_ref"), (F.col(ms) - F.col("_start.ms")).alias("elapsed_ms")]
    firsts = hits.select(*keys, "_sid", *[c for c in rows.columns if c not in keys], *refs)
    value = F.struct(*[c for c in firsts.columns if c not in (*keys, "_sid")])
    return firsts.groupBy(*keys, "_sid").agg(F.min_by(value, pos).alias("_v")).select(*keys, "_v.*")


def anchored(
    rows: DataFrame, keys, order, clear: Column, anchor: Column, member: str, wanted: Column, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """``wanted`` rows whose ``member`` was anchored earlier in the same session; ``clear`` rows start a new session."""
    cut, lane = split_keys(rows.withColumns({"_clear": clear, "_anchor": anchor, "_want": wanted}), keys, order, target_rows)
    epochs = scan(cut, lane, {"session_epoch": total(F.col("_clear").cast("bigint"))})
    inner = [*keys, "session_epoch", member]
    cut2, lane2 = split_keys(epochs.drop("_chunk"), inner, order, target_rows)
    seen = scan(cut2, lane2, {"_held": highest(F.col("_anchor").cast("int"), False)})
    return seen.where(F.col("_want") & (F.coalesce("_held", F.lit(0)) == 1)).select(*rows.columns, "session_epoch")


def interval_match(
    rows: DataFrame, keys, order, ms: str, opens: Column, closes: Column, within_ms: int, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Close rows with the latest open not yet consumed by another accepted close, at most ``within_ms`` before.

    The first close after an open decides: if it lies within the window it consumes the open, otherwise every later
    close lies outside the window as well. So a close is accepted exactly when it directly follows its open among opens
    and closes.
    """
    marks = rows.withColumn("_o", opens).where(opens | closes)
    cut, lane = split_keys(marks, keys, order, target_rows)
    seen = scan(cut, lane, {"_p": previous(F.struct("_o", F.col(ms).alias("ms"), F.col(order[-1]).alias("ref")))})
    ok = ~F.col("_o") & F.coalesce(F.col("_p._o"), F.lit(False)) & ordered_within(F.col("_p.ms"), F.col(ms), within_ms)
    return seen.where(ok).select(
        *rows.columns, F.col("_p.ref").alias("open_ref"), (F.col(ms) - F.col("_p.ms")).alias("elapsed_ms")
    )


def target_transitions(
    rows: DataFrame, keys, order, select_: Column, arrive: Column, target: Column, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Selections and arrivals per key: first selection, change against the previous target, repeat dropped, arrival
    consumes the target.

    Consecutive arrivals after the first find no target. The previous target of a selection is the last selected one
    since the last arrival.
    """
    marks = rows.withColumns({"_sel": select_, "_arr": arrive, "_t": target.cast("string")}).where(select_ | arrive)
    cut, lane = split_keys(marks, keys, order, target_rows)
    seen = scan(cut, lane, {
        "_prev": previous(F.struct(F.col("_sel").alias("sel"), F.col("_t").alias("t"))),
    })
    has = F.coalesce(F.col("_prev.sel"), F.lit(False))
    before = F.when(has, F.col("_prev.t"))
    kind = (
        F.when(F.col("_arr") & has, "arrived")
        .when(F.col("_sel") & ~has, "selected")
        .when(F.col("_sel") & has & (before != F.col("_t")), "changed")
    )
    return seen.withColumns({
        "transition": kind,
        "previous_target": F.when(F.col("_sel"), before),
        "current_target": F.when(F.col("_arr"), before).otherwise(F.col("_t")),
    }).where(F.col("transition").isNotNull()).select(*rows.columns, "transition", "previous_target", "current_target")


_PURCHASE = "ident bigint, ms bigint, request_ident bigint, status string"


def _match_purchases(keys: list[str], window_ms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_, ambiguous = None, [], False
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                k = tuple(getattr(r, c) for c in (*keys, "burst"))
                if k != key:
                    key, open_, ambiguous = k, [], False
                open_ = [q for q in open_ if r.ms - q[1] <= window_ms]
                if not open_:
                    ambiguous = False
                if r.is_request:
                    ambiguous = ambiguous or bool(open_)
                    open_.append((r.ident, r.ms, r.request))
                    continue
                if r.request is not None:
                    found = [q for q in open_ if q[2] == r.request]
                else:
                    found = open_ if not ambiguous and len(open_) == 1 else []
                if len(found) != 1 or r.outcome == "unknown":
                    out.append((*k[:-1], r.ident, r.ms, None, "unmatched"))
                    continue
                open_ = [q for q in open_ if q is not found[0]]
                out.append((*k[:-1], r.ident, r.ms, found[0][0], r.outcome))
            yield pd.DataFrame(out, columns=[*keys, "ident", "ms", "request_ident", "status"]).astype(
                {"request_ident": "Int64"}
            )

    return run


def match_purchases(
    rows: DataFrame, keys: Sequence[str], ms: str, ident: str, is_request: Column, is_response: Column,
    request_id: Column, outcome: Column, window_ms: int = PURCHASE_WINDOW_MS, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Responses with the request they answer, one to one, within ``window_ms`` of the same context.

    A request arriving while another is open makes the context ambiguous until no request is open. A response with a
    request id needs exactly one open request with it; otherwise exactly one open request and no ambiguity. Matches
    change later candidates, so the rows are walked in order; the state is the list of open requests. A pause longer
    than the window empties the state, so a context is cut at such pauses into independent bursts first and a busy
    context spreads over many tasks.
    """
    keys = list(keys)
    marks = rows.select(
        *keys, F.col(ms).alias("ms"), F.col(ident).alias("ident"), is_request.alias("is_request"),
        request_id.cast("string").alias("request"), outcome.alias("outcome"),
    ).where(is_request | is_response)
    cut, lane = split_keys(marks, keys, ["ms", "ident"], target_rows)
    gaps = scan(cut, lane, {"_before": previous(F.col("ms"))})
    pause = F.col("_before").isNull() | (F.col("ms") - F.col("_before") > window_ms)
    bursts = scan(gaps.withColumn("_pause", pause), lane, {"_burst": last(F.when(F.col("_pause"), F.struct("ms", "ident")))})
    ready = bursts.select(*keys, F.col("_burst.ident").alias("burst"), "ms", "ident", "is_request", "request", "outcome")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return (
        ready.repartition(*keys, "burst")
        .sortWithinPartitions(*keys, "burst", "ms", "ident")
        .mapInPandas(_match_purchases(keys, window_ms), f"{head}, {_PURCHASE}")
    )


def related_events(
    correlations: DataFrame, targets: DataFrame, limit: int = 20, contributors: DataFrame | None = None, events: DataFrame | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Events that share a correlation value with a target in its environment, or that contributed to it: newest first.

    ``correlations``: (environment_key, value, event_id, ms), ``targets``: (environment_key, event_id), ``contributors``: (event_id,
    contributor_id) and, with it, ``events``: (environment_key, event_id, ms). Contributors of another environment are not related. At
    most ``limit`` events (50 at most) per target, so of one value only the newest ``limit + 1`` events can matter, one of
    which may be the target itself: a value that a whole environment shares is cut down to these before it meets its targets.
    Tasks hold about ``task_rows`` rows, so their memory does not grow with the tables.
    """
    limit, key, whole = min(limit, 50), ["environment_key", "value"], ["environment_key", "target_id"]
    size = correlations.count()
    wanted = settle(
        correlations.join(targets, ["environment_key", "event_id"], "left_semi").select(*key, F.col("event_id").alias("target_id")).distinct()
    )
    values = wanted.select(*key).distinct()
    # few wanted values leave out the others first; with many, the others fall away where values meet their targets
    few = values.limit(FEW_VALUES + 1).count() <= FEW_VALUES
    able = correlations.join(F.broadcast(values), key, "left_semi") if few else correlations
    once = _dealt(able.select(*key, "event_id", "ms"), size, *key, "event_id", "ms", task_rows=task_rows).distinct()
    newest = top_n(once, key, [F.desc("ms")], limit + 1, ["event_id"])
    # one row per value: at most limit + 1 events
    lists = settle(newest.groupBy(*key).agg(F.collect_list(F.struct("event_id", "ms")).alias("_events")))
    hits, rows = lists.join(wanted, key).select(*whole, "_events"), wanted.count() * (limit + 1)
    if contributors is not None:
        if events is None:
            raise ValueError("contributors need the events they name")
        named = contributors.select(F.col("event_id").alias("target_id"), F.col("contributor_id").alias("event_id"))
        own = targets.select("environment_key", F.col("event_id").alias("target_id"))
        given = named.join(own, "target_id").join(events.select("environment_key", "event_id", "ms"), ["environment_key", "event_id"])
        hits = hits.unionByName(given.select(*whole, F.array(F.struct("event_id", "ms")).alias("_events")))
        rows += contributors.count()
    # all hits of a target meet in one task, whose rows are bounded, so they are grouped and ranked without another shuffle
    each = _dealt(hits, rows, *whole, task_rows=task_rows).select(*whole, F.inline("_events"))
    best = each.where(F.col("event_id") != F.col("target_id")).groupBy(*whole, "event_id").agg(F.max("ms").alias("ms"))
    return top_n(best, whole, [F.desc("ms")], limit, ["event_id"])


def _dealt(df: DataFrame, rows: int, *columns: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by ``columns`` so that a task gets about ``task_rows`` of them, however many there are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)), *columns)


def lineage(events: DataFrame) -> DataFrame:
    """(event_id, contributor_id, contributor_type) for every contributing event; type null when it is not stored."""
    refs = events.select("event_id", F.explode("contributors").alias("contributor_id"))
    return refs.join(
        events.select(F.col("event_id").alias("contributor_id"), F.col("event_type").alias("contributor_type")),
        "contributor_id",
        "left",
    ).select("event_id", "contributor_id", "contributor_type")


def suppress_normalized(activity: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Activity rows whose position already produced a typed event are left out."""
    return activity.join(events.select(*keys), list(keys), "left_anti")


def resolve_items(wanted: DataFrame, catalogue: DataFrame, now_ms: int | Column) -> DataFrame:
    """Requested item ids against a catalogue ``(item_id, name, supported, expires_ms)``: one row per requested id."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    live = catalogue.where(F.col("expires_ms") > now).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("name").alias("_name"), F.max("supported").alias("_ok")
    )
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 0, "unknown").when(n > 1, "ambiguous").when(~F.col("_ok"), "unsupported").otherwise("exact")
    return (
        wanted.select("item_id").distinct().join(live, "item_id", "left")
        .select("item_id", F.when(status == "exact", F.col("_name")).alias("name"), status.alias("status"))
    )
