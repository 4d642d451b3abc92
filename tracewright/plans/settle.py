"""Intermediate tables in the shared folder, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tracewright-")
    return _LOCAL[app]


def settle(df: DataFrame) -> DataFrame:
    """Write the rows once and read them back, so that later plans start from the table instead of repeating the work."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fenced(df: DataFrame) -> DataFrame:
    """Evaluate the columns once per row: filters and later projections are not merged into the expressions below.

    A generator over a one-element array passes rows through unchanged, and the optimizer does not move predicates
    across it. Used where a costly extracted column is referenced many times.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
