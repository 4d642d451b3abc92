"""Log files and chunk streams as DataFrames; evidence profiles, ranking and catalogues of log sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.constants import (
    BACKUP_NAME,
    RELEASE_CHANNELS,
)
from tracewright.functions.identity import channel_from_path, release_channel
from tracewright.functions.text import group
from tracewright.plans.scans import Lane, scan, total

CHUNKS = (
    "source_id string, generation bigint, sequence bigint, offset_start bigint, offset_end bigint, file_size bigint,"
    " observed_at timestamp, ingested_at timestamp, bytes binary"
)


def read_logs(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """Whole log files as text cells with path, size and modification time. For files that fit one row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.load(path).select(
        F.col("path").alias("source_id"),
        F.lit(0).cast("bigint").alias("generation"),
        F.col("content").cast("string").alias("text"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified_at"),
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines of log files of any size, with line number and byte offset.

    Spark cuts files into splits at line ends. Inside a split the row order gives each line its place; the byte and line
    counts of the splits before it are running totals over one row per split. No file is held in one task.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("source_id"),
        F.lit(0).cast("bigint").alias("generation"),
        F.col("_metadata.file_block_start").alias("_chunk"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("_row"),
        (F.octet_length("value").cast("bigint") + 1).alias("byte_length"),
        F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", "").alias("text"),
    )
    lane = Lane(("source_id", "generation"), ("_row",), True)
    return scan(
        rows,
        lane,
        {"line_no": total(F.lit(1).cast("bigint")), "byte_offset": total(F.col("byte_length"), False)},
    ).select("source_id", "generation", "line_no", "byte_offset", "byte_length", "file_size", "text")


def read_chunks(spark: SparkSession, path: str, max_files: int | None = None, latest_first: bool = False) -> DataFrame:
    """Stream of byte chunks from a landing folder of Parquet files in the chunk schema."""
    reader = spark.readStream.schema(CHUNKS).option("latestFirst", str(latest_first).lower())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def start_options(mode: str) -> dict[str, str]:
    """Source options for a start mode; a checkpoint restarts by its checkpoint location alone."""
    modes = {
        "from_beginning": {"startingOffsets": "earliest"},
        "from_current_end": {"startingOffsets": "latest"},
        "from_checkpoint": {},
    }
    return modes[mode]


def capture_window(
    lines: DataFrame, keys: Sequence[str], since_ms: int | Column, ms: str = "ms", offset: str = "byte_offset",
    max_bytes: int | None = None, length: str = "byte_length",
) -> DataFrame:
    """Lines from the first record at or after ``since`` on, to the end of the source.

    With ``max_bytes`` only those within the last bytes of the source; ``truncated`` tells that this cut off lines that may belong to the
    window. The start per source is an aggregate over two numbers.
    """
    since = since_ms if isinstance(since_ms, Column) else F.lit(since_ms)
    ends = lines.groupBy(*keys).agg(F.max(F.col(offset) + F.col(length)).alias("_end"))
    bounded = lines.join(ends, list(keys))
    if max_bytes is not None:
        bounded = bounded.where(F.col(offset) >= F.col("_end") - max_bytes)
    older = F.max(F.when(F.col(ms) < since, F.lit(True)))
    start = bounded.groupBy(*keys).agg(
        F.min(F.when(F.col(ms) >= since, F.col(offset))).alias("_start"), F.coalesce(older, F.lit(False)).alias("_older")
    )
    kept = bounded.join(start, list(keys)).where(F.col(offset) >= F.col("_start"))
    cut_off = F.lit(False) if max_bytes is None else ~F.col("_older") & (F.col("_end") > max_bytes)
    return kept.withColumn("truncated", cut_off).drop("_end", "_start", "_older")


# --- sources ----------------------------------------------------------------------------------------------------------
MARKERS = {
    "Init": "(?i)<Init>",
    "GameVersion": "(?i)<Game Version>",
    "SetDatabaseVersion": "(?i)<SetDatabaseVersion>",
    "JoinPU": "(?i)<Join PU>",
    "FileVersion": r"(?i)(?<!\w)FileVersion(?!\w)",
    "ProductVersion": r"(?i)(?<!\w)ProductVersion(?!\w)",
    "Branch": r"(?i)(?<!\w)Branch(?!\w)",
}


def profile_sources(lines: DataFrame, markers: dict[str, str] | None = None) -> DataFrame:
    """Marker flags, stated channel, build and environment name per source, from all of its lines."""
    names = markers or MARKERS
    text = F.col("text")
    channels = "|".join(sorted(RELEASE_CHANNELS, key=len, reverse=True))
    tag = F.when(text.rlike("(?i)<Init>"), group(text, r"(?i)(?<!\w)Tag\[([^\]]+)\]"))
    game = F.when(text.rlike("(?i)<Game Version>"), group(text, r"(?i)(?<!\w)environment\[([^\]]+)\]"))
    suffix = group(text, rf"(?i)(?:FileVersion|ProductVersion)\s*[:=]\s*[A-Za-z0-9.]+-({channels})(?!\w)")
    version = F.when(text.rlike("(?i)<Game Version>"), group(text, r"(?i)(?<!\w)version\[([^\]]+)\]"))
    file_version = group(text, r"(?i)(?:FileVersion|ProductVersion)\s*[:=]\s*([A-Za-z0-9_.:-]+)")
    name = F.when(text.rlike("(?i)<Init>"), group(text, r"(?i)(?<!\w)Environment\[([^\]]+)\]"))

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), F.col("byte_offset")))

    agg = lines.groupBy("source_id").agg(
        *[F.max(text.rlike(p)).alias(f"_m{i}") for i, p in enumerate(names.values())],
        F.coalesce(first(tag), first(game), first(suffix)).alias("_channel"),
        F.coalesce(first(version), first(file_version)).alias("build"),
        first(name).alias("environment_name"),
        F.min(F.upper(F.coalesce(tag, game, suffix))).alias("_lo"),
        F.max(F.upper(F.coalesce(tag, game, suffix))).alias("_hi"),
    )
    flags = F.array_compact(F.array(*[F.when(F.col(f"_m{i}"), F.lit(n)) for i, n in enumerate(names)]))
    return agg.select(
        "source_id",
        flags.alias("markers"),
        F.upper(F.trim(F.coalesce("_channel", channel_from_path(F.col("source_id"))))).alias("raw_channel"),
        "build",
        "environment_name",
        F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("channel_conflict"),
    )


def validate_sources(profiles: DataFrame, expected: Column | None = None) -> DataFrame:
    """Status per source; a channel other than the expected one is a mismatch."""
    want = expected if expected is not None else F.lit(None).cast("string")
    known = release_channel(F.col("raw_channel"))
    mismatch = F.col("channel_conflict") | F.coalesce(F.col("raw_channel") != want, F.lit(False))
    status = (
        F.when(mismatch, "environment_mismatch")
        .when(F.size("markers") == 0, "invalid_log")
        .when(known.isNull() & F.col("raw_channel").isNotNull() & (F.col("raw_channel") != "UNKNOWN"), "unsupported_channel")
        .otherwise("valid")
    )
    return profiles.withColumn("status", status)


def rank_sources(sources: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Selection rank: valid first, then discovery method, discovery order, channel, path. One row per log source."""
    method = F.when(F.col("method") == "restored_setting", 0).when(F.col("method") == "user_selected", 1).otherwise(2)
    channel = F.lit(99)
    for i, c in enumerate(RELEASE_CHANNELS):
        channel = F.when(F.col("raw_channel") == c, i).otherwise(channel)
    order = [(F.col("status") == "valid").desc(), method, F.col("discovery_order").asc_nulls_last(), channel, F.col("source_id")]
    by = list(partition) or [F.lit(1)]
    return sources.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def log_catalogue(files: DataFrame) -> DataFrame:
    """Current and backup files with build, date and time from the name; other names are skipped with a reason.

    ``files`` has file_name, kind, size and modified_ms.
    """
    name = F.col("file_name")
    backup = F.col("kind") == "backup"
    build = F.when(backup, group(name, BACKUP_NAME, 1))
    return files.select(
        *files.columns,
        build.alias("build"),
        F.when(backup, F.regexp_replace(group(name, BACKUP_NAME, 2), r"\s+", " ")).alias("log_date"),
        F.when(backup, F.regexp_replace(group(name, BACKUP_NAME, 3), r"\s+", " ")).alias("log_time"),
        F.when(backup & build.isNull(), "malformed_backup_name").alias("skipped"),
    )


def catalogue_order() -> list[Column]:
    """Current file first, then backups by name."""
    return [F.when(F.col("kind") == "current", 0).otherwise(1), F.col("file_name")]


def source_set_fingerprint(catalogue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash over the ordered (kind, name, size:mtime) of the usable files per source set."""
    part = F.concat_ws(":", "kind", "file_name", "size", "modified_ms")
    rank = F.when(F.col("kind") == "current", 0).otherwise(1)
    usable = catalogue.where(F.col("skipped").isNull())
    # fixed-size digest per file: the list that is hashed per set stays small
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("file_name").alias("n"), F.sha2(part, 256).alias("p"))))
    return usable.groupBy(*keys).agg(
        F.concat(
            F.lit("set_"), F.substring(F.sha2(F.array_join(F.transform(listed, lambda x: x["p"]), "|"), 256), 1, 24)
        ).alias("fingerprint"),
        F.count(F.lit(1)).alias("files"),
    )


def source_lifecycle_events(ranked: DataFrame) -> DataFrame:
    """Discovered, selected and unavailable sources as event rows."""
    found = ranked.select("source_id", F.lit("RuntimeSourceDiscovered").alias("event_type"), F.col("status").alias("detail"))
    chosen = ranked.where((F.col("rank") == 1) & (F.col("status") == "valid")).select(
        "source_id", F.lit("RuntimeSourceSelected").alias("event_type"), F.col("method").alias("detail")
    )
    lost = ranked.where(F.col("status").isin("missing", "permission_denied", "unsupported_channel")).select(
        "source_id", F.lit("RuntimeSourceUnavailable").alias("event_type"), F.col("status").alias("detail")
    )
    return found.unionByName(chosen).unionByName(lost)
