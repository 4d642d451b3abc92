"""Bytes and text to line frames, line frames to semantic records, plus the rejected rows as diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.constants import MAX_LINE_BYTES, MAX_RECORD_BYTES, MAX_RECORD_LINES
from tracewright.functions.text import WS, normalize_record
from tracewright.plans.scans import CHUNK_BYTES, Lane, last, lowest, scan, split_offsets, top_n, total

LANE = ["source_id", "generation"]
_OPENER = '<SHUDEvent_OnNotification> Added notification "'
_CLOSER = " to queue."


def diagnostics(df: DataFrame, code: str | Column, severity: str, *extra: Column) -> DataFrame:
    """The common diagnostic shape: lane, position, code, severity."""
    return df.select(
        *LANE,
        "line_no",
        "byte_offset",
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        F.lit(severity).alias("severity"),
        *extra,
    )


def frame_lines(raw: DataFrame, emit_incomplete: bool = False) -> DataFrame:
    """Split text cells ``(source_id, generation, text)`` into physical lines.

    Line numbers start at 1 and count empty lines; offsets are bytes. Empty lines are dropped, one trailing CR is
    stripped, and the piece after the last line feed is left out unless ``emit_incomplete``. Offsets come from a running
    sum inside the row's own array, so framing needs no shuffle at all. Use :func:`tracewright.sources.logs.read_log_lines`
    for files too large for one cell.
    """
    pieces = raw.withColumn("_parts", F.split(F.make_valid_utf8("text"), "\n", -1))
    sizes = F.transform("_parts", lambda p: F.octet_length(p).cast("bigint") + 1)
    cells = pieces.withColumn("_sizes", sizes).withColumn("_starts", _prefix_sums(F.col("_sizes")))
    lines = cells.select(
        *LANE,
        F.posexplode(F.arrays_zip(F.col("_parts").alias("part"), F.col("_starts").alias("start"))),
        (F.size("_parts") - 1).alias("_last"),
    )
    kept = lines if emit_incomplete else lines.where(F.col("pos") < F.col("_last"))
    text = F.col("col.part")
    return kept.where(~((F.col("pos") == F.col("_last")) & (F.length(text) == 0))).select(
        *LANE,
        (F.col("pos") + 1).cast("bigint").alias("line_no"),
        F.col("col.start").alias("byte_offset"),
        (F.octet_length(text) + F.when(F.col("pos") < F.col("_last"), 1).otherwise(0)).cast("bigint").alias("byte_length"),
        F.regexp_replace(text, r"\r\z", "").alias("text"),
    )


def _prefix_sums(sizes: Column, block: int = 1000) -> Column:
    """Exclusive prefix sums of a bigint array in two levels, so that appending stays cheap for very long arrays."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")),
        lambda b: F.slice(sizes, b * block + 1, F.lit(block)),
    )

    def running(xs: Column, start: Column) -> Column:
        grown = F.aggregate(xs, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.slice(grown, 1, F.size(xs))

    zero = F.lit(0).cast("bigint")
    sums = F.transform(blocks, lambda xs: F.aggregate(xs, zero, lambda acc, n: acc + n))
    pairs = F.arrays_zip(blocks.alias("xs"), running(sums, zero).alias("at"))
    return F.flatten(F.transform(pairs, lambda z: running(z["xs"], z["at"])))


def drop_empty(lines: DataFrame) -> DataFrame:
    return lines.where(F.length("text") > 0)


def split_oversized(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Lines within the byte limit, and ``line_too_long`` diagnostics; numbering and offsets are untouched."""
    over = F.col("byte_length") > max_line_bytes
    return drop_empty(lines).where(~over), diagnostics(
        lines.where(over), "line_too_long", "warn", F.col("byte_length").alias("measure")
    )


def encoding_diagnostics(raw: DataFrame) -> DataFrame:
    """Sources whose bytes were not valid UTF-8 (replaced during framing)."""
    bad = raw.where(~F.is_valid_utf8("text"))
    return diagnostics(
        bad.withColumn("line_no", F.lit(None).cast("bigint")).withColumn("byte_offset", F.lit(None).cast("bigint")),
        "invalid_utf8",
        "error",
    )


def incomplete_diagnostics(raw: DataFrame) -> DataFrame:
    """Sources ending without a line feed: the retained trailing piece."""
    parts = F.split("text", "\n", -1)
    tail = raw.where(F.length(F.element_at(parts, -1)) > 0).select(
        *LANE,
        F.size(parts).cast("bigint").alias("line_no"),
        (F.octet_length("text") - F.octet_length(F.element_at(parts, -1))).cast("bigint").alias("byte_offset"),
    )
    return diagnostics(tail, "incomplete_line_retained", "warn")


def _mark_records(lines: DataFrame, chunk_bytes: int) -> tuple[DataFrame, Lane]:
    """Number each line's record: ``rid`` is the record's start offset, null for orphan continuations.

    Every step is a running value over the lane, so a lane is processed in byte slices rather than in one task.
    """
    stamp = F.regexp_extract("text", r"^<([^>]+)>", 1)
    rest = F.regexp_replace(F.col("text"), rf"^<[^>]+>{WS}*", "")
    chunked, lane = split_offsets(lines, LANE, chunk_bytes=chunk_bytes)
    base = chunked.withColumns(
        {
            "_cont": F.col("text").rlike(rf"^{WS}"),
            "_stamp": F.nullif(stamp, F.lit("")),
            "_joins": (F.length(rest) > 0) & ~F.startswith(rest, F.lit("[Notice]")),
            "_open": F.contains("text", F.lit(_OPENER)),
            "_close": F.contains("text", F.lit(_CLOSER)),
        }
    )
    pos = F.col("byte_offset")
    # an open notification absorbs following lines with the same stamp until it is closed. `_head` is the start
    # row of the nearest candidate opener; a row after it breaks the run when it neither joins nor is plain continuation.
    head = F.when(~F.col("_cont") & F.col("_open"), F.struct(pos.alias("at"), F.col("_stamp").alias("stamp")))
    two = scan(base, lane, {"_head": last(head), "_prev_close": last(F.when(F.col("_close"), pos), inclusive=False)})
    inside = F.col("_head").isNotNull() & (pos > F.col("_head.at"))
    unclosed = F.col("_prev_close").isNull() | (F.col("_prev_close") < F.col("_head.at"))
    joins = inside & unclosed & F.col("_joins") & (F.col("_stamp") == F.col("_head.stamp"))
    breaks = inside & ~F.coalesce(joins, F.lit(False)) & ~F.col("_cont")
    three = scan(
        two.withColumn("_joined", F.coalesce(joins, F.lit(False))), lane, {"_break": last(F.when(breaks, pos))}
    )
    absorbed = F.col("_joined") & (F.col("_break").isNull() | (F.col("_break") < F.col("_head.at"))) & ~F.col("_cont")
    return scan(three, lane, {"rid": last(F.when(~F.col("_cont") & ~absorbed, pos))}), lane


def assemble_records(
    lines: DataFrame,
    max_lines: int = MAX_RECORD_LINES,
    max_bytes: int = MAX_RECORD_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Lines to semantic records and diagnostics.

    White-space-led lines join the record before them; an unclosed notification absorbs lines with its own stamp. A
    record whose white-space continuations take it past ``max_lines`` or ``max_bytes`` is quarantined whole, and what
    follows it until the next record start is reported as orphaned.
    """
    marked, lane = _mark_records(lines, chunk_bytes)
    in_record = marked.where(F.col("rid").isNotNull())
    sized = scan(
        in_record,
        lane.over("rid"),
        {"_lines": total(F.lit(1).cast("bigint")), "_bytes": total(F.col("byte_length"))},
    )
    excess = F.col("_cont") & ((F.col("_lines") > max_lines) | (F.col("_bytes") > max_bytes))
    spilled = scan(sized, lane.over("rid"), {"_spill": lowest(F.when(excess, F.col("byte_offset")))})
    # the text of a quarantined record is never collected: only lines up to the first excess one are gathered
    flagged = spilled.withColumn("_after", F.col("_spill").isNotNull() & (F.col("byte_offset") > F.col("_spill")))
    grouped = (
        flagged.groupBy(*LANE, "rid")
        .agg(
            F.min("line_no").alias("line_no"),
            F.max("line_no").alias("end_line"),
            F.sum("byte_length").alias("byte_length"),
            F.count(F.lit(1)).alias("line_count"),
            F.max(F.col("_spill")).alias("_spilled"),
            F.array_sort(
                F.collect_list(F.when(F.col("_spill").isNull(), F.struct("byte_offset", "text")))
            ).alias("_parts"),
        )
        .withColumnRenamed("rid", "byte_offset")
    )
    records = grouped.where(F.col("_spilled").isNull()).select(
        *LANE,
        "line_no",
        "end_line",
        "byte_offset",
        "byte_length",
        "line_count",
        normalize_record(F.array_join(F.transform("_parts", lambda p: p["text"]), "\n")).alias("text"),
    )
    limit = diagnostics(grouped.where(F.col("_spilled").isNotNull()), "record_continuation_limit_exceeded", "warn")
    lost = diagnostics(flagged.where("_after"), "orphan_continuation_line", "warn")
    first = diagnostics(marked.where(F.col("rid").isNull()), "orphan_continuation_line", "warn")
    return records, limit.unionByName(lost).unionByName(first)


def records_of(lines: DataFrame, **limits) -> DataFrame:
    return assemble_records(lines, **limits)[0]


def evidence_for(
    events: DataFrame, records: DataFrame, max_records: int, record_bytes: int, total_bytes: int
) -> DataFrame:
    """Original record text for events ``(source_id, generation, byte_offset, order_key, event_id)``.

    Newest first inside a lane; a record that does not fit the remaining byte budget is skipped and the next one tried.
    The budget only shrinks, so of all records of one size just the newest ``total_bytes / size`` (and no more than
    ``max_records``) can be chosen. That bounds what the fold of a lane sees without changing its result.
    """
    size = F.octet_length("text").cast("bigint")
    hits = events.join(records.select(*LANE, "byte_offset", "text"), [*LANE, "byte_offset"]).where(
        (size <= record_bytes) & ~F.contains("text", F.lit("\ufffd"))
    )
    sized = hits.select(*LANE, "order_key", F.col("event_id").cast("string").alias("event_id"), size.alias("size"))
    able = top_n(sized, [*LANE, "size"], [F.desc("order_key")], max_records, ["event_id"]).where(
        F.col("rank") * F.col("size") <= total_bytes
    )
    newest_first = F.sort_array(F.collect_list(F.struct("order_key", "event_id", "size")), asc=False)
    kept = F.aggregate(
        newest_first,
        F.expr("named_struct('ids', cast(array() as array<string>), 'spent', 0L)"),
        lambda acc, x: F.when(
            (F.size(acc["ids"]) < max_records) & (acc["spent"] + x["size"] <= total_bytes),
            F.struct(
                F.concat(acc["ids"], F.array(x["event_id"])).alias("ids"), (acc["spent"] + x["size"]).alias("spent")
            ),
        ).otherwise(acc),
    )
    chosen = able.groupBy(*LANE).agg(kept.alias("_k")).select(*LANE, F.explode("_k.ids").alias("event_id"))
    return hits.withColumn("event_id", F.col("event_id").cast("string")).join(chosen, [*LANE, "event_id"], "left_semi")


def read_text_cells(spark: SparkSession, df: DataFrame, source: str, text: str) -> DataFrame:
    """Any table with a text column as ``(source_id, generation, text)``."""
    return df.select(
        F.col(source).cast("string").alias("source_id"), F.lit(0).cast("bigint").alias("generation"), F.col(text).alias("text")
    )


__all__ = [
    "LANE", "assemble_records", "diagnostics", "drop_empty", "encoding_diagnostics", "evidence_for",
    "frame_lines", "incomplete_diagnostics", "read_text_cells", "records_of", "split_oversized",
]
