"""Keyed streaming operators: chunk framing, bounded de-duplication, current-state projection with late policy.

State per key is a handful of values. Rows of a key within one micro-batch are sorted before they are applied, so any
batching of an ordered stream gives the same result; rate limits on the source bound what a key receives per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _gather(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")


class ChunkFramer(StatefulProcessor):
    """Byte chunks of one source to complete lines; the unfinished tail waits for the next chunk.

    A new generation drops the tail and restarts numbering at the chunk's own offset.
    """

    SCHEMA = "source_id string, generation bigint, line_no bigint, byte_offset bigint, byte_length bigint, text string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "generation bigint, line_no bigint, byte_offset bigint, tail binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.at.get() if self.at.exists() else None
        generation, line_no, offset, tail = (state[0], state[1], state[2], bytes(state[3])) if state else (None, 1, 0, b"")
        out = []
        for r in _gather(rows, ["generation", "sequence"]).itertuples(index=False):
            if r.generation != generation:
                generation, line_no, offset, tail = int(r.generation), 1, int(r.offset_start), b""
            *done, tail = (tail + bytes(r.bytes)).split(b"\n")
            for piece in done:
                if piece not in (b"", b"\r"):
                    text = piece[:-1] if piece.endswith(b"\r") else piece
                    out.append((key[0], generation, line_no, offset, len(piece) + 1, text.decode("utf-8", "replace")))
                line_no, offset = line_no + 1, offset + len(piece) + 1
        self.at.update((generation, line_no, offset, tail))
        yield pd.DataFrame(out, columns=["source_id", "generation", "line_no", "byte_offset", "byte_length", "text"])

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame) -> DataFrame:
    """Stream of chunks to a stream of lines."""
    return chunks.select("source_id", "generation", "sequence", "offset_start", "bytes").groupBy("source_id").transformWithStateInPandas(
        ChunkFramer(), ChunkFramer.SCHEMA, "Append", "None"
    )


class BoundedDedupe(StatefulProcessor):
    """Keep a row when it lies more than the window after the last kept row of its key; state expires with the window."""

    def __init__(self, columns: Sequence[str], ms: str, ident: str, window_ms: int, ttl: bool) -> None:
        self.columns, self.ms, self.ident, self.window_ms, self.ttl = list(columns), ms, ident, window_ms, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "ms bigint", ttlDurationMs=self.window_ms if self.ttl else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.kept.get()[0] if self.kept.exists() else None
        pdf, keep = _gather(rows, [self.ms, self.ident]), []
        for ms in pdf[self.ms]:
            fresh = last is None or abs(ms - last) > self.window_ms
            keep.append(fresh)
            last = int(ms) if fresh else last
        if last is not None:
            self.kept.update((last,))
        yield pdf.loc[keep, self.columns]

    def close(self) -> None:
        pass


def dedupe_stream(events: DataFrame, keys: Sequence[str], ms: str, ident: str, window_ms: int, expire: bool = False) -> DataFrame:
    """Streaming bounded de-duplication. ``expire`` lets idle keys drop their state by processing time."""
    return events.groupBy(*keys).transformWithStateInPandas(
        BoundedDedupe(events.columns, ms, ident, window_ms, expire), events.schema, "Append", "ProcessingTime" if expire else "None"
    )


class ProjectionProcessor(StatefulProcessor):
    """A reducer over the events of one key, with late events ignored or accepted and duplicates by id dropped."""

    def __init__(self, key: str, initial: dict, reduce: Callable[[dict, dict], dict], schema: str, ms: str, ident: str, late: str):
        self.key, self.initial, self.reduce, self.schema, self.ms, self.ident, self.late = key, initial, reduce, schema, ms, ident, late
        self.names = [c.strip().split()[0] for c in schema.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", f"revision bigint, top_ms bigint, {self.schema}")
        self.seen = handle.getMapState("seen", "id string", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            revision, top, *values = self.state.get()
            current = dict(zip(self.names, values))
        else:
            revision, top, current = 0, None, dict(self.initial)
        for row in _gather(rows, [self.ms, self.ident]).to_dict("records"):
            ident = (str(row[self.ident]),)
            if self.seen.containsKey(ident):
                continue
            self.seen.updateValue(ident, (int(row[self.ms]),))
            if self.late == "ignore" and top is not None and row[self.ms] < top:
                continue
            current, revision, top = self.reduce(current, row), revision + 1, max(top or 0, int(row[self.ms]))
        values = [current.get(n) for n in self.names]
        self.state.update((revision, top, *values))
        yield pd.DataFrame([(key[0], revision, top, *values)], columns=[self.key, "revision", "top_ms", *self.names])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((int(row["revision"]), int(row["top_ms"]), *[row[n] for n in self.names]))

    def close(self) -> None:
        pass


def project_stream(
    events: DataFrame, key: str, initial: dict, reduce: Callable[[dict, dict], dict], schema: str, ms: str, ident: str,
    late: str = "ignore", initial_state: DataFrame | None = None,
) -> DataFrame:
    """Changed snapshots per micro-batch. ``initial_state`` hands a batch projection over to the stream."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema}[key]
    start = initial_state.groupBy(key) if initial_state is not None else None
    return events.groupBy(key).transformWithStateInPandas(
        ProjectionProcessor(key, initial, reduce, schema, ms, ident, late),
        f"`{key}` {kind}, revision bigint, top_ms bigint, {schema}",
        "Update",
        "None",
        initialState=start,
    )


def interval_join_stream(
    opens: DataFrame, closes: DataFrame, keys: Sequence[str], time: str, within: str, lateness: str = "10 minutes"
) -> DataFrame:
    """Closes with every open of the same key at most ``within`` before; both sides bounded by watermarks."""
    o = opens.withWatermark(time, lateness).alias("o")
    c = closes.withWatermark(time, lateness).alias("c")
    cond = F.expr(f"c.`{time}` >= o.`{time}` AND c.`{time}` <= o.`{time}` + INTERVAL {within}")
    for k in keys:
        cond = cond & (F.col(f"o.{k}") == F.col(f"c.{k}"))
    return c.join(o, cond)


def health_windows(records: DataFrame, time: str, width: str, keys: Sequence[str], lateness: str = "10 minutes") -> DataFrame:
    """Records and unmatched records per time window and key."""
    return (
        records.withWatermark(time, lateness)
        .groupBy(F.window(time, width), *keys)
        .agg(F.count(F.lit(1)).alias("records"), F.count_if("unmatched").alias("unknown"))
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a Parquet table and return it; update mode keeps one folder per micro-batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", path).outputMode("append").start()
    else:
        q = writer.outputMode(mode).foreachBatch(
            lambda df, i: df.withColumn("batch_id", F.lit(i)).write.mode("overwrite").parquet(f"{path}/b={i:09d}")
        ).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.parquet(path) if mode == "append" else spark.read.parquet(f"{path}/b=*")


def latest_updates(updates: DataFrame, key: str) -> DataFrame:
    """Last snapshot per key from an update-mode table."""
    rest = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_u")).select(key, "_u.*").drop("batch_id", "b")


def ntz(ms: Column) -> Column:
    return F.timestamp_millis(ms)
