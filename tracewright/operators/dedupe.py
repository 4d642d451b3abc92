"""Bounded de-duplication: a row is dropped while it lies within the window of the last row kept for its key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.constants import (
    DAY_MS,
    DAY_WINDOW_TYPES,
    DEDUPE_WINDOW_MS,
    HALF_HOUR_WINDOW_TYPES,
    MINUTE_MS,
)
from tracewright.plans.settle import settle

#: distinct instants of one key folded inside one task; keys with more take the chunked path
MAX_FOLD = 20_000


def family_window(event_type: Column) -> Column:
    """Window in milliseconds by event type."""
    return (
        F.when(event_type.isin(*DAY_WINDOW_TYPES), DAY_MS)
        .when(event_type.isin(*HALF_HOUR_WINDOW_TYPES), 30 * MINUTE_MS)
        .otherwise(DEDUPE_WINDOW_MS)
        .cast("bigint")
    )


def kept_instants(df: DataFrame, keys: Sequence[str], ms: str, ident: str, window: Column, max_fold: int = MAX_FOLD) -> DataFrame:
    """``(keys, ms, ident)`` of the rows to keep.

    Measured from the last *kept* row, so a chain of close rows is one group only until a row lies more than the window
    after the kept one. Rows are taken in time order; two rows of a key at one instant collapse to the smaller id before
    anything is shuffled by key. Keys with more than ``max_fold`` instants are cut into time chunks: each chunk reports
    where it would leave off for every possible entry, the chunks of a key are chained over those reports, and each
    chunk then keeps its rows from its known entry. A null part of a key is a value like others; rows without a time have
    no place in the order and take no part.
    """
    keys = list(keys)
    once = df.where(F.col(ms).isNotNull()).groupBy(*keys, ms).agg(F.min(ident).alias(ident), F.max(window).alias("_w"))
    hot = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_fold).select(*keys)
    if hot.isEmpty():
        return _fold(once, keys, ms, ident)
    hot, once = settle(hot), settle(once)
    cold = _joined(once, hot, keys, "left_anti")
    return _fold(cold, keys, ms, ident).unionByName(_chunked(_joined(once, hot, keys, "left_semi"), keys, ms, ident))


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, where null equals null."""
    named = right.select(*[F.col(c).alias(f"_on_{c}" if c in on else c) for c in right.columns])
    out = left.join(named, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], how)
    return out.drop(*[f"_on_{c}" for c in on])


def _fold(once: DataFrame, keys: list[str], ms: str, ident: str) -> DataFrame:
    entry = F.struct(F.col(ms).alias("t"), F.col(ident).alias("i"))
    rows = once.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_rows"), F.max("_w").alias("_w"))
    empty = F.slice("_rows", 1, 0)
    kept = F.aggregate(
        "_rows",
        empty,
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (x["t"] - F.try_element_at(acc, F.lit(-1))["t"] > F.col("_w")), F.concat(acc, F.array(x))
        ).otherwise(acc),
    )
    return rows.select(*keys, F.explode(kept).alias("_k")).select(*keys, F.col("_k.t").alias(ms), F.col("_k.i").alias(ident))


def _chunked(once: DataFrame, keys: list[str], ms: str, ident: str) -> DataFrame:
    cut = once.withColumn("_chunk", F.expr(f"{ms} div (8 * _w + 1)"))
    types = {f.name: f.dataType.simpleString() for f in once.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ms)
        t, w, chunk = pdf[ms].to_numpy(np.int64), int(pdf["_w"].iloc[0]), int(pdf["_chunk"].iloc[0])
        n = len(t)
        nxt = np.searchsorted(t, t + w, side="right")
        leave = np.arange(n)
        for i in range(n - 1, -1, -1):
            if nxt[i] < n:
                leave[i] = leave[nxt[i]]
        m = min(n, int(np.searchsorted(t, chunk * (8 * w + 1) + w, side="right")) + 1)
        exits = t[leave[:m]]
        ends = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
        out = pd.DataFrame({"_upto": t[ends], "_exit": exits[ends]})
        for c in [*keys, "_chunk", "_w"]:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "_chunk", "_w", "_upto", "_exit"]]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, entry = [], None
        for chunk, part in pdf.sort_values(["_chunk", "_upto"]).groupby("_chunk", sort=True):
            rows.append((*[part[k].iloc[0] for k in keys], chunk, entry))
            upto, exits, w = part["_upto"].to_numpy(), part["_exit"].to_numpy(), int(part["_w"].iloc[0])
            at = 0 if entry is None else int(np.searchsorted(upto, entry + w, side="right"))
            if at < len(upto):
                entry = int(exits[at])
        return pd.DataFrame(rows, columns=[*keys, "_chunk", "_entry"]).astype({"_entry": "Int64"})

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ms)
        t, w, entry = pdf[ms].to_numpy(np.int64), int(pdf["_w"].iloc[0]), pdf["_entry"].iloc[0]
        at, chosen = (0 if pd.isna(entry) else int(np.searchsorted(t, int(entry) + w, side="right"))), []
        while at < len(t):
            chosen.append(at)
            at = int(np.searchsorted(t, t[at] + w, side="right"))
        return pdf.iloc[chosen][[*keys, ms, ident]]

    reports = cut.groupBy(*keys, "_chunk").applyInPandas(
        report, f"{head}, _chunk bigint, _w bigint, _upto bigint, _exit bigint"
    )
    entries = reports.groupBy(*keys).applyInPandas(chain, f"{head}, _chunk bigint, _entry bigint")
    return (
        _joined(cut, entries, [*keys, "_chunk"], "inner")
        .groupBy(*keys, "_chunk")
        .applyInPandas(keep, f"{head}, `{ms}` {types[ms]}, `{ident}` {types[ident]}")
    )


def decide(df: DataFrame, keys: Sequence[str], ms: str, ident: str, window: Column | int, max_fold: int = MAX_FOLD) -> DataFrame:
    """Every row with ``decision`` emitted or suppressed_duplicate. Rows without a time are emitted: nothing shows them to be repeats."""
    w = window if isinstance(window, Column) else F.lit(window).cast("bigint")
    kept = kept_instants(df, keys, ms, ident, w, max_fold).withColumn("_kept", F.lit(True))
    marked = _joined(df, kept, [*keys, ms, ident], "left")
    stays = F.col("_kept").isNotNull() | F.col(ms).isNull()
    return marked.withColumn("decision", F.when(stays, "emitted").otherwise("suppressed_duplicate")).drop("_kept")


def dedupe_bounded(df: DataFrame, keys: Sequence[str], ms: str, ident: str, window: Column | int, max_fold: int = MAX_FOLD) -> DataFrame:
    """Only the kept rows."""
    return decide(df, keys, ms, ident, window, max_fold).where(F.col("decision") == "emitted").select(*df.columns)


def decision_counts(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return decisions.groupBy(*keys, "decision").agg(F.count(F.lit(1)).alias("rows"))
