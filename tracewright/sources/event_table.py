"""The event table with an id index: appends that do not join with the whole history, commits with checkpoints, retention by partition.

Three Parquet tables share the partitions ``environment_key / ingested_date / batch``: the events, their ids with the hash of their identity, and
Bloom filters of these ids by hash bucket (32 bits an id, 12 probes: less than one in a million ids that are not there passes). An append
tests its ids against the filters and reads ids only of the dates that a filter names, so a batch of new events reads no history
but its filters, 4 bytes for each stored id. The exact ids decide; a filter only says where to look.

A batch is written under its own partitions and counts once its commit file exists; readers leave out batches that have been opened and not
committed. A batch that is run again after its commit changes nothing, before it replaces what it had written. Checkpoint rows carry
the batch and count with it.

Retention and deletion drop whole partitions without reading them and rewrite only the boundary, by dynamic partition overwrite. All
of them can be run again after a crash and end in the same table. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.govern import SENSITIVE
from tracewright.plans.settle import settle
from tracewright.sources.store import EventConflict
from tracewright.streaming.subscribers import Markers

PARTS = ["environment_key", "ingested_date", "batch"]
#: bits of a filter for each id, probes, and ids that share one filter
BITS, PROBES, MOST_IDS = 32, 12, 1 << 16
_U = np.uint64


def _probe(h1: np.ndarray, h2: np.ndarray, i: int, size: int) -> np.ndarray:
    """Place of the i-th probe. It is mixed once more: places in steps of one width would meet far too often in small filters."""
    x = h1 + _U(i) * (h2 | _U(1))
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x >> _U(65 - size.bit_length())


def bloom_bits(h1: np.ndarray, h2: np.ndarray) -> bytes:
    """Filter of ids given by two hashes, 64 bits at least and a power of two."""
    size = 1 << max(6, int(h1.size * BITS - 1).bit_length())
    bits = np.zeros(size // 8, np.uint8)
    for i in range(PROBES):
        at = _probe(h1, h2, i, size)
        np.bitwise_or.at(bits, (at >> _U(3)).astype(np.int64), (1 << (at & _U(7)).astype(np.uint8)).astype(np.uint8))
    return bits.tobytes()


def bloom_has(raw: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    bits, found = np.frombuffer(raw, np.uint8), np.ones(h1.size, bool)
    for i in range(PROBES):
        at = _probe(h1, h2, i, bits.size * 8)
        found &= (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
    return found


def _hashes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("h1").to_numpy(zero_copy_only=False).view(_U), b.column("h2").to_numpy(zero_copy_only=False).view(_U)


def _filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by environment, date and bucket to filters of at most ``MOST_IDS`` ids of one of them."""
    names, held, key = ["environment_key", "ingested_date", "bucket"], [], None

    def made() -> pa.RecordBatch:
        h1, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
        values = [pa.array([v], t) for v, t in zip((*key, h1.size, bloom_bits(h1, h2)), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(values, [*names, "n", "bits"])

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = _hashes(b)
        keys = list(zip(*(b.column(n).to_pylist() for n in names), strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and (keys[s] != key or sum(x.size for x, _ in held) >= MOST_IDS):
                yield made()
                held = []
            key = keys[s]
            held.append((h1[s:e], h2[s:e]))
    if held:
        yield made()


def _tested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, filters before ids, to the ids and the dates whose filter has them. One bucket's filters are held."""
    bucket, filters = None, []
    for b in batches:
        buckets, dates, bits = (b.column(c).to_pylist() for c in ("bucket", "ingested_date", "bits"))
        h1, h2 = _hashes(b)
        ids, cuts = b.column("event_id"), [0, *[i for i in range(1, b.num_rows) if buckets[i] != buckets[i - 1]], b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if buckets[s] != bucket:
                bucket, filters = buckets[s], []
            while s < e and bits[s] is not None:
                filters.append((dates[s], bits[s]))
                s += 1
            for date, raw in filters if s < e else ():
                hit = np.flatnonzero(bloom_has(raw, h1[s:e], h2[s:e]))
                if hit.size:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit + s)), pa.array([date] * hit.size, pa.string())], ["event_id", "ingested_date"])


class EventTable:
    """Events under ``path``; ``buckets`` belongs to the table and never changes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.commits, self.opened = Markers(spark, f"{path}/commits"), Markers(spark, f"{path}/open")

    # --- reading ----------------------------------------------------------------------------------------------------
    def _table(self, name: str) -> DataFrame | None:
        """Committed rows of one of the tables, or null before the first append."""
        try:
            rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None
        rows = rows.withColumns({c: F.col(c).cast("string") for c in PARTS})
        started = self.opened.names() - self.commits.names()
        return rows.where(~F.col("batch").isin(*started)) if started else rows

    def read(self) -> DataFrame | None:
        return self._table("events")

    def checkpoints(self, version: int) -> DataFrame | None:
        """The newest committed checkpoint per environment and name; other versions do not count and mean a rebuild."""
        rows = self._table("checkpoints")
        if rows is None:
            return None
        rest = [c for c in rows.columns if c not in ("environment_key", "name", "ingested_date")]
        latest = rows.groupBy("environment_key", "name").agg(F.max_by(F.struct(*rest), "updated_ms").alias("_c"))
        return latest.select("environment_key", "name", "_c.*").where(F.col("version") == version)

    # --- appending --------------------------------------------------------------------------------------------------
    def _keyed(self, batch: DataFrame) -> DataFrame:
        h = F.xxhash64("event_id")
        return batch.withColumns({"h1": h, "h2": F.xxhash64(F.lit(1), "event_id"), "bucket": F.pmod(h, F.lit(self.buckets)).cast("long")})

    def candidates(self, ids: DataFrame) -> DataFrame:
        """``(event_id, ingested_date)`` where a filter may have the id, for distinct ``event_id``."""
        none = self.spark.createDataFrame([], "event_id string, ingested_date string")
        blooms = self._table("blooms")
        if blooms is None:
            return none
        asked = self._keyed(ids.select("event_id")).withColumns({"bits": F.lit(None).cast("binary"), "ingested_date": F.lit(None).cast("string")})
        null = {"event_id": F.lit(None).cast("string"), "h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long")}
        both = blooms.select("bucket", "ingested_date", "bits").withColumns(null).unionByName(asked)
        dealt = both.repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull())
        return dealt.mapInArrow(_tested, "event_id string, ingested_date string")

    def known(self, ids: DataFrame) -> DataFrame:
        """``(event_id, stored_hash)`` of those ids that are stored; reads only the dates that the filters name."""
        found = settle(self.candidates(ids))
        dates = [r[0] for r in found.select("ingested_date").distinct().collect()]  # one row per day of history at most
        if not dates:
            return self.spark.createDataFrame([], "event_id string, stored_hash string")
        rows = self._table("ids").where(F.col("ingested_date").isin(*dates)).select("event_id", "ingested_date", F.col("identity_hash").alias("stored_hash"))
        return rows.join(found.distinct(), ["event_id", "ingested_date"]).select("event_id", "stored_hash")

    def conflicts(self, batch: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Ids whose content differs from the stored one, or that come twice in the batch with different content."""
        inside = batch.groupBy("event_id").agg(F.min("identity_hash").alias("_lo"), F.max("identity_hash").alias("_hi"))
        known = self.known(inside.select("event_id")) if known is None else known
        odd = (F.col("_lo") != F.col("_hi")) | (F.col("_lo") != F.col("stored_hash"))
        return inside.join(known, "event_id", "left").where(odd).select("event_id")

    def append(self, batch: DataFrame, batch_id: int | str | None = None, checkpoint: DataFrame | None = None) -> dict:
        """Store the events whose id is new, all or nothing; ``batch`` has event_id, identity_hash, environment_key and ingested_ms.

        Raises before anything is written if an id comes with other content. ``checkpoint`` (environment_key, name, version, cursor, value,
        updated_ms) counts from the same commit on. The report of a committed batch is returned again when it is run again.
        """
        name = f"b{batch_id}" if batch_id is not None else f"u{uuid.uuid4().hex}"
        if (report := self._report(name)) is not None:
            return report
        self.opened.put(name)
        for part in self._parts("*", f"batch={name}"):
            self._drop(part)
        day = F.coalesce(F.date_format(F.timestamp_millis("ingested_ms"), "yyyy-MM-dd"), F.lit("unknown"))
        offered = settle(batch.withColumns({"event_id": F.col("event_id").cast("string"), "ingested_date": day, "batch": F.lit(name)}))
        known = settle(self.known(offered.select("event_id").distinct()))
        if bad := self.conflicts(offered, known).limit(5).collect():
            raise EventConflict(f"event ids already exist with different content, among them {[r[0] for r in bad]}")
        rest = [c for c in offered.columns if c != "event_id"]
        once = offered.groupBy("event_id").agg(F.min(F.struct("ingested_ms", "environment_key")).alias("_first"), *[F.min_by(c, F.struct("ingested_ms", "environment_key")).alias(c) for c in rest])
        new = settle(once.drop("_first").join(known, "event_id", "left_anti"))
        keyed = self._keyed(new.select("event_id", "identity_hash", *PARTS))
        # one file per partition, more where a partition is large
        self._write(new.hint("rebalance", *PARTS[:2]), "events")
        ids = keyed.hint("rebalance", *PARTS[:2]).sortWithinPartitions(*PARTS[:2], "bucket", "event_id")
        self._write(ids.select("event_id", "identity_hash", "bucket", *PARTS), "ids")
        blooms = ids.select("environment_key", "ingested_date", "bucket", "h1", "h2").mapInArrow(
            _filters, "environment_key string, ingested_date string, bucket long, n long, bits binary"
        )
        self._write(blooms.withColumn("batch", F.lit(name)), "blooms")
        if checkpoint is not None:
            self._write(checkpoint.withColumns({"ingested_date": F.lit("all"), "batch": F.lit(name)}), "checkpoints")
        attempted, inserted = offered.count(), new.count()
        self._commit(name, report := {"attempted": attempted, "inserted": inserted, "duplicates": attempted - inserted})
        return report

    def append_stream(self, events: DataFrame, checkpoint_dir: str):
        """Streaming sink: each micro-batch is one append under its id."""
        writer = events.writeStream.foreachBatch(lambda df, i: self.append(df, i) and None)
        return writer.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()

    # --- deleting ---------------------------------------------------------------------------------------------------
    def retain(
        self, cutoff_ms: int, environment: str | None = None, before: Callable[[dict], None] | None = None, after: Callable[[dict], None] | None = None
    ) -> dict:
        """Delete events ingested before ``cutoff_ms`` (null times stay), of one environment or of all.

        Days before the cutoff go by their folders; only the day it falls on is read and rewritten. ``before`` is called with the plan and may
        stop it by raising; ``after`` with the outcome, once the rows are gone.
        """
        plan = {"cutoff_ms": cutoff_ms, "environment": environment}
        if before:
            before(dict(plan))
        events, deleted, dropped = self.read(), 0, 0
        if events is not None:
            day = self.spark.range(1).select(F.date_format(F.timestamp_millis(F.lit(cutoff_ms)), "yyyy-MM-dd").alias("d")).first()["d"]
            mine = F.lit(True) if environment is None else F.col("environment_key") == environment
            old = mine & (F.col("ingested_date") < day) & (F.col("ingested_date") != "unknown")
            deleted = events.where(old).count()  # from the footers of the files
            dropped = self._drop_where(lambda p: p["ingested_date"] < day and p["ingested_date"] != "unknown" and environment in (None, p["environment_key"]))
            deleted += self._rewrite(mine & (F.col("ingested_date") == day), F.col("ingested_ms") >= cutoff_ms)
        outcome = plan | {"deleted": deleted, "partitions": dropped}
        if after:
            after(dict(outcome))
        return outcome

    def delete(self, environment: str | None = None, sensitive_only: bool = False) -> int:
        """Delete an environment, or (``sensitive_only``) the sensitive events, or everything; checkpoints of touched environments go too."""
        events = self.read()
        if events is None:
            return 0
        mine = F.lit(True) if environment is None else F.col("environment_key") == environment
        if not sensitive_only:
            n = events.where(mine).count()
            self._drop_where(lambda p: environment in (None, p["environment_key"]), ("events", "ids", "blooms", "checkpoints"))
            return n
        hit = events.where(mine & F.col("sensitivity").isin(*SENSITIVE)).select("environment_key", "ingested_date").distinct()
        places = {(r["environment_key"], r["ingested_date"]) for r in hit.collect()}  # partitions, not rows
        if not places:
            return 0
        self._drop_where(lambda p: p["environment_key"] in {e for e, _ in places}, ("checkpoints",))
        inside = F.concat_ws("\0", "environment_key", "ingested_date").isin(*["\0".join(p) for p in places])
        inside = inside & F.col("environment_key").isin(*{e for e, _ in places}) & F.col("ingested_date").isin(*{d for _, d in places})
        return self._rewrite(inside, ~F.coalesce(F.col("sensitivity"), F.lit("")).isin(*SENSITIVE))

    def _rewrite(self, inside: Column, stays: Column) -> int:
        """Keep only the rows that stay in some partitions; the events first, so that a second run finds the ids to drop."""
        events = self.read().where(inside)
        gone = events.where(~stays).count()
        kept = settle(events.where(stays))
        if gone:
            self._replace("events", events, kept)
        ids = self._table("ids").where(inside)
        left = settle(ids.join(kept.select("event_id"), "event_id", "left_semi").select(*ids.columns))
        if left.count() < ids.count():
            self._replace("ids", ids, left)
        return gone

    def _replace(self, name: str, old: DataFrame, new: DataFrame) -> None:
        empty = old.select(*PARTS).distinct().join(new.select(*PARTS).distinct(), PARTS, "left_anti").collect()  # partitions
        self._write(new, name, "dynamic")
        gone = {tuple(r) for r in empty}
        self._drop_where(lambda p: tuple(p[c] for c in PARTS) in gone, (name,))

    # --- folders ----------------------------------------------------------------------------------------------------
    def _write(self, rows: DataFrame, name: str, overwrite: str | None = None) -> None:
        writer = rows.write.partitionBy(*PARTS)
        writer = writer.mode("overwrite").option("partitionOverwriteMode", overwrite) if overwrite else writer.mode("append")
        writer.parquet(f"{self.path}/{name}")

    def _parts(self, name: str, batch: str = "batch=*") -> list:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/environment_key=*/ingested_date=*/{batch}")
        return [s.getPath() for s in self.commits.fs.globStatus(path) or []]

    def _drop(self, path) -> None:
        self.commits.fs.delete(path, True)

    def _drop_where(self, wanted: Callable[[dict], bool], names: Iterable[str] = ("events", "ids", "blooms")) -> int:
        """Drop partitions by their values; the number of those of the first table."""
        dropped = []
        for name in names:
            found = [p for p in self._parts(name) if wanted(_values(p))]
            dropped.append(len(found))
            for p in found:
                self._drop(p)
        return dropped[0]

    def _commit(self, name: str, report: dict) -> None:
        self.commits.fs.mkdirs(self.commits._path(""))
        out = self.commits.fs.create(self.commits._path(name), False)
        out.write(bytearray(json.dumps(report).encode()))
        out.close()
        self.opened.drop(name)

    def _report(self, name: str) -> dict | None:
        if not self.commits.has(name):
            return None
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.path}/commits/{name}").first()["value"])


def _values(path) -> dict[str, str]:
    """Values of a partition from its folders."""
    parts = [x.partition("=") for x in path.toString().rsplit("/", len(PARTS))[1:]]
    return {k: unquote(v) for k, _, v in parts}
