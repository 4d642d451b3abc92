"""Stream state that ends with event time, against plain Python, in several cuts; golden differences and health events."""

import random

from pyspark.sql import functions as F

from tracewright.operators import golden, health
from tracewright.streaming import processors, registry, timed

SCHEMA = "u string, id long, kind string, ms long"


def stream(spark, path, batches):
    processors.prepare(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def some_rows(seed, n=80):
    rng, t, rows = random.Random(seed), 10_000, []
    for i in range(n):
        t += rng.choice([0, 100, 400, 1500])
        rows.append((f"u{i % 2}", i, rng.choice("oc"), t))
    return rows, t


def matched(rows, within, until):
    out, held = [], {}
    for u, i, kind, ms in sorted(rows, key=lambda r: (r[3], str(r[1]))):
        if ms > until:
            continue
        if kind == "o":
            held[u] = (ms, i)
        elif u in held and ms - held[u][0] <= within:
            out.append((u, str(i), str(held.pop(u)[1]), ms))
    return sorted(out)


def test_release_match_in_any_order(spark, tmp_path):
    rows, top = some_rows(3)
    want = matched(rows, 900, top - 3000)
    assert len(want) > 5
    for n, size in enumerate((80, 13)):
        # rows swap places within the lateness, also across batches
        late = sorted(rows, key=lambda r: r[3] + random.Random(r[1]).randrange(2000))
        late += [r for r in rows if r[3] == top and r not in late]
        batches = [late[i : i + size] for i in range(0, len(late), size)]
        found = timed.release_match(stream(spark, str(tmp_path / f"in{n}"), batches), ["u"], "ms", "id", F.col("kind") == "o", F.col("kind") == "c", 900, 3000)
        out = registry.drain(found, str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}"))
        assert sorted((r.u, r.close_ref, r.open_ref, r.ms) for r in out.collect()) == want


class Calls:
    """A handle and its state in memory, with the number of calls to them."""

    def __init__(self):
        self.n, self.list, self.value, self.timers = 0, [], None, set()

    def __getattr__(self, name):
        def call(*given):
            self.n += 1
            if name == "appendList":
                self.list += given[0]
            elif name == "get":
                return list(self.list)
            elif name == "clear":
                self.list = []
            elif name == "exists":
                return False
            elif name == "registerTimer":
                self.timers.add(given[0])
            return self

        return call

    getCurrentWatermarkInMs = lambda self: 5_000


def test_release_match_calls_do_not_grow_with_rows():
    for n in (10, 2000):
        calls = Calls()
        match = timed.ReleaseMatch(["u", "close_ref", "open_ref", "ms", "elapsed_ms"], 900)
        match.init(calls)
        rows = [{"row_ms": i * 4, "row_ref": str(i), "row_open": i % 2 == 0} for i in range(n)]
        assert list(match.handleInputRows(("a",), iter(rows), calls)) == [] and calls.timers == {0}
        out = list(match.handleExpiredTimer(("a",), calls, None))
        assert len(out) == min(n, 1251) // 2 and tuple(out[0]) == ("a", "1", "0", 4, 4)
        assert len(calls.list) == max(n - 1251, 0) and calls.n < 20


def test_dedupe_state_ends(spark, tmp_path):
    rows, top = some_rows(5)
    rows += [(f"once{i}", 1000 + i, "o", 10_000 + i) for i in range(20)]
    rows.sort(key=lambda r: (r[3], r[1]))
    want, kept = [], {}
    for u, i, _, ms in rows:
        if u not in kept or ms - kept[u] > 700:
            kept[u] = ms
            want.append(i)
    for n, size in enumerate((200, 17)):
        batches = [rows[i : i + size] for i in range(0, len(rows), size)]
        found = timed.dedupe_timed(stream(spark, str(tmp_path / f"in{n}"), batches), ["u"], "ms", "id", 700, 2000)
        out = registry.drain(found, str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}"))
        assert sorted(r.id for r in out.collect()) == sorted(want)
        state = spark.read.format("statestore").option("path", str(tmp_path / f"cp{n}")).option("stateVarName", "kept").load()
        # of 22 keys only those seen within window and lateness still have state
        assert state.count() <= 2 and state.where(F.col("value.ms") + 700 + 2000 < top - 1).count() == 0


def test_golden_diff(spark):
    schema = "a int, m map<string,string>, s struct<x: array<int>>"
    left = spark.createDataFrame([(1, {"p": "1", "q": "2"}, ([1],)), (1, {"q": "2", "p": "1"}, ([1],)), (None, None, None), (2, {}, ([],))], schema)
    right = spark.createDataFrame([(1, {"p": "1", "q": "2"}, ([1],)), (None, None, None), (3, None, (None,)), (3, None, (None,))], schema)
    got = {(r.a, r.side, r.copies) for r in golden.golden_diff(left, right).collect()}
    assert got == {(1, "unexpected", 1), (2, "unexpected", 1), (3, "missing", 2)}
    assert golden.golden_diff(left, left).count() == 0 and golden.golden_diff(left.limit(0), right.limit(0)).count() == 0
    assert golden.golden_diff(left, right, ["a"]).count() == 3


def test_health_events(spark):
    rows = [("LIVE", 100, 80, "suspected_drift", "high_unknown_ratio", 0.8), ("PTU", 10, 0, "compatible", "profile_compatible", 0.0), ("BAD", 5, 0, "strange", "x", 0.0)]
    df = spark.createDataFrame(rows, "environment_key string, records bigint, unknown bigint, status string, reason string, ratio double")
    df = df.select("*", F.lit("p").alias("profile_id"), F.lit("1").alias("profile_version"), (F.col("records") - F.col("unknown")).alias("emitted"), F.lit(3).cast("bigint").alias("samples"), F.lit(None).cast("bigint").alias("dropped"), F.lit(5000).cast("bigint").alias("checked_ms"))
    valid, rejected = health.health_events(df)
    got = {(r.environment_key, r.event_type): r for r in valid.collect()}
    assert set(got) == {("LIVE", health.STATUS), ("LIVE", health.DRIFT), ("PTU", health.STATUS)}
    assert got["LIVE", health.DRIFT].payload["unknownRatio"] == "0.800000" and got["LIVE", health.STATUS].payload["droppedUnknownSamples"] == "0"
    assert got["PTU", health.STATUS].confidence == "high" and got["LIVE", health.DRIFT].confidence == "medium"
    assert [r.environment_key for r in rejected.collect()] == ["BAD"] and len({r.event_id for r in got.values()}) == 3
    again, _ = health.health_events(df)
    assert {r.event_id for r in again.collect()} == {r.event_id for r in got.values()}
