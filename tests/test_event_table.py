"""The event table: appends against a stored history, commits, checkpoints, retention and deletion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.sources import event_table, store
from tracewright.sources.event_table import EventTable

DAY = 86_400_000
T0 = 1_700_000_000_000 // DAY * DAY


def batch(spark, rows):
    """Rows (id, environment, ingested in days from the start, payload, sensitivity)."""
    data = [(i, e, None if d is None else int(T0 + d * DAY), p, s) for i, e, d, p, s in rows]
    df = spark.createDataFrame(data, "event_id string, environment_key string, ingested_ms bigint, payload string, sensitivity string")
    return store.identity_hash(df, ["event_id", "payload"])


def row(i, env="LIVE::a b/c", day=0.5, payload="x", sensitivity="local"):
    return (f"id{i}", env, day, payload, sensitivity)


def ids(table):
    return sorted(r["event_id"] for r in table.read().collect())


def test_append_against_stored_history(spark, tmp_path):
    t = EventTable(spark, str(tmp_path / "t"), buckets=4)
    assert t.read() is None and t.append(batch(spark, [row(i, day=i % 3) for i in range(50)]), 1) == {"attempted": 50, "inserted": 50, "duplicates": 0}
    # a later day offers some of the stored ids once more, one of them twice
    again = [row(i, day=9) for i in (*range(45, 60), 59)]
    assert t.append(batch(spark, again), 2) == {"attempted": 16, "inserted": 10, "duplicates": 6}
    assert ids(t) == sorted(f"id{i}" for i in range(60))
    assert t.append(batch(spark, [row(99)]), 2) == {"attempted": 16, "inserted": 10, "duplicates": 6} and len(ids(t)) == 60
    with pytest.raises(store.EventConflict, match="id3"):
        t.append(batch(spark, [row(3, day=30, payload="other"), row(70)]), 3)
    with pytest.raises(store.EventConflict):
        t.append(batch(spark, [row(80, payload="one"), row(80, payload="two")]), 4)
    assert len(ids(t)) == 60 and sorted(r[0] for r in t.conflicts(batch(spark, [row(3, payload="other"), row(4)])).collect()) == ["id3"]
    assert t.append(batch(spark, []), 5) == {"attempted": 0, "inserted": 0, "duplicates": 0}


def test_only_named_dates_are_read(spark, tmp_path):
    t = EventTable(spark, str(tmp_path / "t"), buckets=4)
    t.append(batch(spark, [row(i, day=i % 10) for i in range(500)]), 1)
    found = t.candidates(batch(spark, [row(i) for i in range(3)] + [row(i) for i in range(5000, 6000)]).select("event_id")).collect()
    assert len(found) == 3 and len({r["ingested_date"] for r in found}) == 3


def test_filters():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    raw = event_table.bloom_bits(h[0, :4000], h[1, :4000])
    assert event_table.bloom_has(raw, h[0, :4000], h[1, :4000]).all() and event_table.bloom_has(raw, h[0, 4000:], h[1, 4000:]).sum() == 0
    # small filters too: 500 of 12 ids, 1,000 others each
    wrong = sum(event_table.bloom_has(event_table.bloom_bits(*h[:, i * 5 : i * 5 + 12]), *h[:, 4000:]).sum() for i in range(500))
    assert wrong <= 2


def test_batch_without_commit_is_invisible_and_replaced(spark, tmp_path, monkeypatch):
    t = EventTable(spark, str(tmp_path / "t"), buckets=4)
    point = spark.createDataFrame([("LIVE", "projections", 1, "c", "{}", 5)], "environment_key string, name string, version int, cursor string, value string, updated_ms bigint")
    t.append(batch(spark, [row(1)]), 1)
    with monkeypatch.context() as m:
        m.setattr(EventTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.append(batch(spark, [row(2), row(3)]), 2, point)
    assert ids(t) == ["id1"] and t.checkpoints(1).count() == 0
    # another batch may store the same ids meanwhile; the first one, run again, finds them
    assert t.append(batch(spark, [row(3)]), 3)["inserted"] == 1
    assert t.append(batch(spark, [row(2), row(3)]), 2, point) == {"attempted": 2, "inserted": 1, "duplicates": 1}
    assert ids(t) == ["id1", "id2", "id3"]
    assert [(r["name"], r["batch"]) for r in t.checkpoints(1).collect()] == [("projections", "b2")] and t.checkpoints(2).count() == 0


def test_retention(spark, tmp_path):
    t = EventTable(spark, str(tmp_path / "t"), buckets=4)
    rows = [row(i, env=f"E:{i % 2}", day=i / 4) for i in range(40)] + [("null", "E:0", None, "x", "local")]
    t.append(batch(spark, rows), 1)
    seen = []

    def stop(plan):
        raise RuntimeError("not now")

    with pytest.raises(RuntimeError):
        t.retain(T0 + 5 * DAY, before=stop)
    assert len(ids(t)) == 41
    cut = T0 + 5 * DAY + DAY // 2
    before = t.read().where("ingested_date < '2023-11-19'").count()
    out = t.retain(cut, "E:1", before=seen.append, after=seen.append)
    want = sorted(i for i, e, d, *_ in rows if d is None or e != "E:1" or T0 + d * DAY >= cut)
    assert ids(t) == want and out["deleted"] == 41 - len(want) and [set(x) for x in seen] == [{"cutoff_ms", "environment"}, {"cutoff_ms", "environment", "deleted", "partitions"}]
    assert before > 0 and out["partitions"] == 5 and t.retain(cut, "E:1")["deleted"] == 0
    # deleted ids are free again, kept ones are not
    assert t.append(batch(spark, [row(1, env="E:1", day=8), row(39, env="E:1", day=8)]), 2) == {"attempted": 2, "inserted": 1, "duplicates": 1}
    assert t.retain(cut)["deleted"] > 0 and t.read().where(F.col("ingested_ms") < cut).count() == 0


def test_deletion(spark, tmp_path):
    t = EventTable(spark, str(tmp_path / "t"), buckets=4)
    point = spark.createDataFrame([(f"E{i}", "p", 1, "c", "{}", 5) for i in range(3)], "environment_key string, name string, version int, cursor string, value string, updated_ms bigint")
    t.append(batch(spark, [row(i, env=f"E{i % 3}", sensitivity="secret" if i % 9 == 0 else "local") for i in range(27)]), 1, point)
    assert t.delete(sensitive_only=True) == 3 and len(ids(t)) == 24
    assert sorted(r["environment_key"] for r in t.checkpoints(1).collect()) == ["E1", "E2"]
    assert t.append(batch(spark, [row(0, env="E0"), row(3, env="E0")]), 2)["inserted"] == 1
    assert t.delete("E1") == 9 and t.checkpoints(1).count() == 1 and {r["environment_key"] for r in t.read().collect()} == {"E0", "E2"}
    assert t.delete() == 16 and (t.read() is None or t.read().count() == 0)


def test_stream(spark, tmp_path):
    t = EventTable(spark, str(tmp_path / "t"), buckets=4)
    for i in range(3):
        batch(spark, [row(n) for n in range(i * 5, i * 5 + 8)]).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    schema = batch(spark, []).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    t.append_stream(source, str(tmp_path / "cp")).awaitTermination()
    assert t.read().count() == 18 and t.read().select("batch").distinct().count() == 3
