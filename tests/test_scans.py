"""Chunked running values equal plain ones; bounded de-duplication equals a fold in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import correlate, dedupe
from tracewright.plans.scans import Lane, asof, highest, last, lowest, previous, scan, split_keys, top_n, total


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", t, rng.choice([None, 1, 2, 3]), t % 3) for t in range(400)]
    return spark.createDataFrame(data, "key string, t bigint, v int, g int")


def values():
    return {
        "last_v": last(F.col("v")),
        "before_v": last(F.col("v"), False),
        "n": total(F.lit(1).cast("bigint")),
        "n_before": total(F.lit(1).cast("bigint"), False),
        "hi": highest(F.col("v")),
        "lo": lowest(F.col("v"), False),
        "prev": previous(F.col("v")),
    }


def test_split_equals_plain(spark, rows):
    plain = scan(rows, Lane(("key",), ("t",)), values())
    cut, lane = split_keys(rows, ["key"], ["t"], target_rows=40, fan=4)
    assert lane.split and cut.where("key = 'hot'").select("_chunk").distinct().count() > 3
    split = scan(cut, lane, values()).drop("_chunk")
    order = ["key", "t"]
    assert split.select(plain.columns).orderBy(*order).collect() == plain.orderBy(*order).collect()


def test_unsplit_when_no_key_is_hot(rows):
    cut, lane = split_keys(rows, ["key"], ["t"], target_rows=10_000)
    assert not lane.split and "_chunk" not in cut.columns


def test_asof_split_equals_plain(rows):
    left, right = rows.where("g = 0").select("key", "t"), rows.where("g = 1").select("key", "t", "v", F.col("t").alias("rt"))
    a = asof(left, right, ["key"], ["t"], ["v", "rt"]).orderBy("key", "t").collect()
    b = asof(left, right, ["key"], ["t"], ["v", "rt"], target_rows=30).orderBy("key", "t").collect()
    assert a == b and any(r.rt is not None for r in a)


def test_correlation_split_equals_plain(rows):
    t = F.col("g")
    for run in (
        lambda n: correlate.sequence_match(rows, ["key"], ["t"], "t", t == 0, [t == 1, t == 2, t == 1], F.lit(False), 50, n),
        lambda n: correlate.target_transitions(rows, ["key"], ["t"], t < 2, t == 2, F.col("v"), n),
        lambda n: correlate.interval_match(rows, ["key"], ["t"], "t", t == 0, t == 1, 3, n),
        lambda n: correlate.anchored(rows, ["key"], ["t"], t == 0, t == 1, "v", t == 2, n),
    ):
        plain, split = run(10**6), run(25)
        assert sorted(map(str, split.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def fold(rows, window):
    kept, last_ms = [], {}
    for key, ms, ident in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last_ms or ms - last_ms[key] > window:
            kept.append((key, ms, ident))
            last_ms[key] = ms
    return sorted(kept)


@pytest.mark.parametrize("seed,step", [(1, 3), (2, 40), (3, 1)])
def test_bounded_dedupe_is_a_fold(spark, seed, step):
    rng, t, data = random.Random(seed), 0, []
    for i in range(1500):
        t += rng.randrange(step + 1)
        data.append(("hot" if rng.random() < 0.7 else f"c{i % 9}", t, i))
    df = spark.createDataFrame(data, "key string, ms bigint, id bigint")
    want = fold(data, 25)
    for max_fold in (10**6, 50):  # native fold, and the chunked path for hot keys
        got = dedupe.dedupe_bounded(df, ["key"], "ms", "id", 25, max_fold)
        assert sorted(tuple(r) for r in got.select("key", "ms", "id").collect()) == want


def test_decisions_keep_every_row(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 11, 3)], "key string, ms bigint, id bigint")
    got = dedupe.decide(df, ["key"], "ms", "id", 10).orderBy("id").select("decision").collect()
    assert [r[0] for r in got] == ["emitted", "suppressed_duplicate", "emitted"]


def test_null_times_and_keys_lose_nothing(spark):
    data = [("a", "x", None, 1), ("a", "x", 0, 2), ("a", "x", 5, 3), ("a", "x", 50, 4), ("a", "x", None, 5)]
    data += [(None, "x", 7 * i, 10 + i) for i in range(60)] + [("b", None, 0, 90), ("b", None, 3, None)]
    df = spark.createDataFrame(data, "key string, part string, ms bigint, id bigint")
    timed = [(f"{k}/{p}", ms, i) for k, p, ms, i in data if ms is not None and i is not None]
    want = sorted([i for _, _, i in fold(timed, 25)] + [1, 5])
    for max_fold in (10**6, 10):
        got = dedupe.dedupe_bounded(df, ["key", "part"], "ms", "id", 25, max_fold)
        assert got.columns == df.columns and sorted(r.id for r in got.collect()) == want
        assert dedupe.decide(df, ["key", "part"], "ms", "id", 25, max_fold).count() == len(data)


def test_top_n(rows):
    got = top_n(rows, ["key"], [F.desc("t")], 2).groupBy("key").agg(F.count("*").alias("n"), F.max("t").alias("t")).collect()
    best = {r.key: r.t for r in rows.groupBy("key").agg(F.max("t").alias("t")).collect()}
    assert all(r.n == 2 and r.t == best[r.key] for r in got)
