"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.settle import shared_folder

#: folders of intermediate tables that this process has written and not released, with the name of the table if it has one
_WRITTEN: dict[str, str | None] = {}

#: separators of words everywhere in this subpackage: space and the five ASCII controls from tab to carriage return
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 4096


def settle(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    _WRITTEN[path] = None
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, key: str) -> DataFrame:
    """As ``settle``, as a table in buckets of ``key``, so that joins and groupings by it do not shuffle these rows."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    _WRITTEN[path] = name
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def written() -> set[str]:
    """Folders of the intermediate tables that exist now."""
    return set(_WRITTEN)


def release(spark: SparkSession, paths: set[str], still: DataFrame) -> None:
    """Delete intermediate tables whose results are stored elsewhere by now, but none that ``still`` reads."""
    read = still.inputFiles()
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths & set(_WRITTEN):
        if not any(path.rsplit("/", 1)[1] in f for f in read):
            if name := _WRITTEN[path]:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)
            del _WRITTEN[path]


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings for text-heavy Python stages: small Arrow batches keep a task's memory bounded."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_ordinals(df: DataFrame, name: str) -> DataFrame:
    """Number equal rows 0, 1, ... in a new column ``name``, so that every row differs from every other.

    Equal rows are counted (with partial sums before the shuffle) and spread out again in chunks that are dealt over all
    tasks, so a row repeated without end burdens no single task. Columns must be groupable (no maps).
    """
    n, c = fresh(df, "_copies"), fresh(df, "_chunk")
    counted = df.groupBy(*[col(x) for x in df.columns]).agg(F.count(F.lit(1)).alias(n))
    chunks = counted.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{n}` - 1) div {CHUNK}"))))
    spread = chunks.repartition(*[col(x) for x in chunks.columns])
    first = F.col(c) * CHUNK
    numbers = F.sequence(first, F.least(F.col(n), first + CHUNK) - 1)
    return spread.withColumn(name, F.explode(numbers)).drop(n, c)
