"""Log files across splits, the event store, export and import, and streams in small batches."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import catalogue
from tracewright.sources import logs, store
from tracewright.streaming import processors


def test_lines_across_splits(spark, tmp_path):
    rng = random.Random(1)
    text = "".join("é" * rng.randrange(5) + f"line {i}" + rng.choice(["\n", "\r\n", "\n\n"]) for i in range(500))
    (tmp_path / "a.log").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = logs.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, at = [], 0
    for i, piece in enumerate(text.split("\n")[:-1]):
        want.append((i + 1, at, piece.rstrip("\r")))
        at += len(piece.encode()) + 1
    assert [(r.line_no, r.byte_offset, r.text) for r in got] == want


def batch(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, environment_key string, event_date string, payload string")
    return store.identity_hash(df, ["event_id", "payload"])


def test_append_is_idempotent_and_rejects_conflicts(spark, tmp_path):
    path = str(tmp_path / "events")
    first = [("a", "e", "2026-01-01", "1"), ("b", "e", "2026-01-01", "2")]
    assert store.append_events(spark, batch(spark, first), path) == {"attempted": 2, "inserted": 2, "duplicates": 0}
    again = [*first, ("c", "e", "2026-01-02", "3")]
    assert store.append_events(spark, batch(spark, again), path) == {"attempted": 3, "inserted": 1, "duplicates": 2}
    with pytest.raises(store.EventConflict):
        store.append_events(spark, batch(spark, [("a", "e", "2026-01-01", "other"), ("d", "e", "2026-01-01", "4")]), path)
    assert sorted(r.event_id for r in store.read_events(spark, path).collect()) == ["a", "b", "c"]


def test_rerun_of_a_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = batch(spark, [("a", "e", "2026-01-01", "1")])
    for _ in range(2):
        assert store.append_events(spark, rows, path, batch_id=4)["inserted"] == 1
    assert store.read_events(spark, path).count() == 1


def test_checkpoints_by_version(spark, tmp_path):
    path = str(tmp_path / "cp")
    rows = [("e", "projections", 1, "c1", "{}", 1), ("e", "projections", 1, "c2", "{}", 2), ("f", "projections", 2, "x", "{}", 3)]
    store.write_checkpoint(spark.createDataFrame(rows, "environment_key string, name string, version int, cursor string, value string, updated_ms bigint"), path)
    assert [(r.environment_key, r.cursor) for r in store.latest_checkpoints(spark, path, 1).collect()] == [("e", "c2")]


@pytest.mark.parametrize("fmt", ["json", "csv", "xml"])
def test_catalogue_round_trip(spark, tmp_path, fmt):
    rows = [("Alpha <1>", "armor", True), ('Be"ta', "", None), ("Gamma, x", "tool", False)]
    df = spark.createDataFrame(rows, "name string, type string, shared boolean")
    store.export_catalogue(df, fmt, str(tmp_path / fmt))
    back = store.read_catalogue(spark, str(tmp_path / fmt), fmt).orderBy("name").collect()
    assert [(r.name, r.type or "", r.shared) for r in back] == rows


def test_name_keys_fold_compatibility_forms(spark):
    df = spark.createDataFrame([("Ａbc",), ("abc",), ("ABC",)], "name string")
    assert {r.k for r in df.select(catalogue.name_key(F.col("name")).alias("k")).collect()} == {"abc"}


def test_chunk_stream_any_cut(spark, tmp_path):
    processors.prepare(spark)
    rng = random.Random(4)
    text = "".join(f"zeile ü {i}\n" for i in range(60)).encode()
    cuts = [0, *sorted(rng.sample(range(1, len(text)), 9)), len(text)]
    schema = logs.CHUNKS
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows = [("s", 1, n, a, b, len(text), None, None, text[a:b])]
        if n == 4:
            rows.append(("s", 2, 0, 0, 5, 5, None, None, b"next\n"))
        spark.createDataFrame(rows[:1], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:02d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = processors.run_to_table(processors.frame_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = out.orderBy("line_no").collect()
    assert [r.text for r in got] == text.decode().split("\n")[:-1]
    assert [r.byte_offset for r in got][:2] == [0, len("zeile ü 0\n".encode())]


def test_capture_window(spark):
    rows = [("s", i * 10, 10, None if i % 4 == 0 else i * 100) for i in range(20)]
    df = spark.createDataFrame(rows, "source_id string, byte_offset bigint, byte_length bigint, ms bigint")
    got = [r.byte_offset for r in logs.capture_window(df, ["source_id"], 700).orderBy("byte_offset").collect()]
    assert got == [i * 10 for i in range(7, 20)]
