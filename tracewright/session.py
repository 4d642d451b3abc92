"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings: UTC, adaptive execution with skew handling. Cluster sizing stays with the caller."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # text rules cost far more per byte than a shuffle read: small partitions stay spread over the cores
    conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    return spark


def local_session(cores: str = "8", name: str = "tracewright", **extra: str) -> SparkSession:
    """A session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for k, v in extra.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
