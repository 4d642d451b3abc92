"""Each batch reaches each subscriber once, whatever is run again or fails."""

import pytest

from tracewright.streaming.subscribers import FanOut, Subscriber, table_sink


def rows(spark, *values):
    return spark.createDataFrame([(v, v % 2 == 0) for v in values], "n long, even boolean")


def test_replayed_batch_and_failing_sink(spark, tmp_path):
    got, broken = [], [True]

    def remember(name):
        return lambda df, i: got.append((name, i, sorted(r.n for r in df.collect())))

    def fails(df, i):
        if broken[0]:
            raise OSError("sink away")
        remember("c")(df, i)

    out = FanOut(spark, str(tmp_path / "fan"), [Subscriber("a", remember("a")), Subscriber("c", fails), Subscriber("b", remember("b"), "even", after=0)])
    with pytest.raises(OSError):
        out.deliver(rows(spark, 1, 2), 0)
    assert got == [("a", 0, [1, 2])] and [s.name for s in out.waiting(0)] == ["c"]
    broken[0] = False
    # run again with other rows: the rows of the first run are delivered, to the one who waits
    assert out.deliver(rows(spark, 9), 0) == ["c"] and got[-1] == ("c", 0, [1, 2])
    assert out.deliver(rows(spark, 9), 0) == []
    assert out.deliver(rows(spark, 3, 4), 1) == ["a", "c", "b"] and got[-1] == ("b", 1, [4])
    again = FanOut(spark, str(tmp_path / "fan"), out.subscribers)
    assert again.deliver(rows(spark, 3, 4), 1) == [] and len(got) == 5


def test_table_sink_and_stream(spark, tmp_path):
    for i in range(3):
        rows(spark, *range(i * 4, i * 4 + 4)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema("n long, even boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    out = FanOut(spark, str(tmp_path / "fan"), [Subscriber("all", table_sink(str(tmp_path / "all"))), Subscriber("odd", table_sink(str(tmp_path / "odd")), "not even")])
    out.start(source.parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).count() == 12 and spark.read.parquet(str(tmp_path / "odd")).count() == 6
    assert spark.read.parquet(str(tmp_path / "all")).select("batch").distinct().count() == 3


def test_names():
    with pytest.raises(ValueError):
        Subscriber("", print)
    with pytest.raises(ValueError):
        FanOut(None, "", [Subscriber("a", print), Subscriber("a", print)])
