"""Fan-out of a stream to subscribers, each batch to each subscriber once.

A micro-batch is written once, under its id, before anyone sees it: a stateful stream is not computed again for every subscriber, and a batch
that is run again is delivered with the rows it had at first. A ledger holds one marker per subscriber and batch, made after its
sink has returned. A batch that is run again skips whoever has a marker, so a sink that failed gets its batch and the others do not.
Between sink and marker a crash can repeat a delivery; ``table_sink`` replaces its own folder then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

Sink = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Subscriber:
    """Who wants which rows; ``after`` is the last batch that it does not want, for those who join later."""

    name: str
    sink: Sink
    wants: Column | str | None = None
    after: int = -1

    def __post_init__(self) -> None:
        if not self.name or "/" in self.name:
            raise ValueError("a subscriber needs a name that can be a folder")


class Markers:
    """Empty files in a shared folder, through Spark's own file system layer."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        self.fs = self.jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def put(self, name: str) -> None:
        """Make a marker; an existing one stays."""
        if not self.has(name):
            self.fs.mkdirs(self._path(name).getParent())
            self.fs.create(self._path(name), False).close()

    def names(self) -> set[str]:
        top = self._path("")
        return {s.getPath().getName() for s in self.fs.listStatus(top)} if self.fs.exists(top) else set()

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def table_sink(path: str) -> Sink:
    """Rows of a batch in a folder of their own, replaced as a whole when it is delivered again."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


class FanOut:
    """Subscribers of one stream, with their ledger and the batches in flight under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, subscribers: list[Subscriber]) -> None:
        if len({s.name for s in subscribers}) < len(subscribers):
            raise ValueError("subscribers need different names")
        self.spark, self.folder, self.subscribers = spark, folder, list(subscribers)
        self.ledger, self.written = Markers(spark, f"{folder}/ledger"), Markers(spark, f"{folder}/written")

    def waiting(self, batch_id: int) -> list[Subscriber]:
        """Who has not got a batch yet."""
        return [s for s in self.subscribers if batch_id > s.after and not self.ledger.has(f"{s.name}/{batch_id}")]

    def deliver(self, batch: DataFrame, batch_id: int) -> list[str]:
        """Hand a batch to everyone who waits for it; names of those who got it. One failing sink does not keep it from the others."""
        waiting = self.waiting(batch_id)
        if not waiting:
            return []
        path, schema = f"{self.folder}/batches/{batch_id}", batch.schema
        if not self.written.has(str(batch_id)):
            batch.write.mode("overwrite").parquet(path)
            self.written.put(str(batch_id))
        rows, served, failed = self.spark.read.schema(schema).parquet(path), [], None
        for s in waiting:
            try:
                s.sink(rows if s.wants is None else rows.where(s.wants), batch_id)
            except Exception as e:  # noqa: BLE001  raised again below, when all others have theirs
                failed = failed or e
                continue
            self.ledger.put(f"{s.name}/{batch_id}")
            served.append(s.name)
        if failed:
            raise failed
        Markers(self.spark, f"{self.folder}/batches").drop(str(batch_id))
        return served

    def start(self, stream: DataFrame, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
        """Run a stream into this fan-out (``trigger`` as for ``DataStreamWriter.trigger``)."""
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda df, i: self.deliver(df, i) and None).start()
