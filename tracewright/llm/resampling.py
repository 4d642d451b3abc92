"""Importance resampling towards a target distribution, over hashed runs of words.

Features of a text are all runs of one to ``longest`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its UTF-8
bytes modulo ``buckets``. The checksum of very many short spans is taken at once: a table holds what a byte adds to the checksum by its
distance from the end of its span, the contributions of each span are combined by ``bitwise_xor.reduceat``, and a constant for
the span's length accounts for the checksum's start value. Spans longer than the table are folded block by block.

The gain of a bucket is the logarithm of how much more frequent it is in the target than in the documents, a document's weight the mean gain
of its features. Weights get Gumbel noise from a hash of the document's id, so that taking the largest scores draws without replacement
in proportion to the weights. Ranks come from a histogram of the scores, which are integers, so no task sorts the whole table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.common import col, fresh, settle

#: distances from a span's end that the position table covers; longer spans are folded in blocks of this many bytes
REACH = 64
#: bytes of a text that are turned into features at once, and features that are counted at once
_PIECE, _HELD = 1 << 18, 1 << 17
#: The reflected polynomial of CRC-32, and the ASCII characters that belong to words once A-Z are lower-cased
POLYNOMIAL = 0xEDB88320
WORD_CHARACTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: scores are grouped by this many neighbouring values to number them
_COARSE = 128


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """``by_place[d * 256 + b]``: what byte b adds, d bytes before the end; ``by_length[n]``: the checksum of n zero bytes."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = (register >> 1) ^ np.where(register & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    places = [register]
    while len(places) < REACH:
        places.append((places[-1] >> 8) ^ register[places[-1] & 0xFF])
    lengths = [zlib.crc32(bytes(n)) for n in range(REACH + 1)]
    return np.concatenate(places), np.array(lengths, np.uint32)


def _contributions(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XOR of what the bytes of each span add; spans have 1 to ``REACH`` bytes and may overlap."""
    first = np.cumsum(sizes) - sizes
    total = int(first[-1] + sizes[-1])
    at = np.arange(total, dtype=np.int32)
    left = np.repeat((first + sizes - 1).astype(np.int32), sizes) - at
    place = np.repeat((starts - first).astype(np.int32), sizes) + at
    return np.bitwise_xor.reduceat(_tables()[0][(left << 8) | data[place]], first)


def _long_span(data: np.ndarray, start: int, size: int) -> int:
    """Checksum of one span beyond the table: a first short block, then whole blocks, into which the register is folded."""
    by_place = _tables()[0]
    head = size % REACH or REACH
    sizes = np.full((size - head) // REACH + 1, REACH, np.int64)
    sizes[0] = head
    blocks = _contributions(data, start + np.cumsum(sizes) - sizes, sizes)
    register, top = 0, (REACH - 1) << 8
    for block in blocks.tolist():
        # the four bytes of the register act as if they stood in front of the block's first four
        register = block ^ int(
            by_place[top | (register & 0xFF)] ^ by_place[top - 256 | (register >> 8 & 0xFF)]
            ^ by_place[top - 512 | (register >> 16 & 0xFF)] ^ by_place[top - 768 | (register >> 24)]
        )
    return register ^ _zeros(size)


def _zeros(size: int) -> int:
    """The constant of a long span's length."""
    sum_, piece = 0, bytes(min(size, 1 << 20))
    while size:
        sum_ = zlib.crc32(piece[:size], sum_)
        size -= min(size, len(piece))
    return sum_


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for every span (none empty); spans may overlap and be of any length."""
    sizes = ends - starts
    out = np.empty(sizes.size, np.uint32)
    short = sizes <= REACH
    if short.any():
        out[short] = _contributions(data, starts[short], sizes[short]) ^ _tables()[1][sizes[short]]
    for i in np.flatnonzero(~short).tolist():
        out[i] = _long_span(data, int(starts[i]), int(sizes[i]))
    return out


#: lower-cases A-Z and turns every other ASCII character that is in no word into a space
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or c in WORD_CHARACTERS else 32 for c in range(256))


def words_of(text: str) -> int:
    return len(text.encode().translate(_PLAIN).split())


def features_of(text: str, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of new words, buckets of new features) of a whole text, piece by piece."""
    raw, at, before = text.encode().translate(_PLAIN), 0, []
    while at < len(raw):
        cut = raw.find(b" ", at + _PIECE)
        cut = len(raw) if cut < 0 else cut
        new = raw[at:cut].split()
        at = cut
        if not new:
            continue
        words = [*before, *new]
        data = np.frombuffer(b" ".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        spans = [(starts[i:j], ends[i + k :]) for k in range(longest) if (i := max(0, len(before) - k)) < (j := len(words) - k)]
        sums = crc32_spans(data, *(np.concatenate(x) for x in zip(*spans, strict=True)))
        before = words[max(0, len(words) - longest + 1) :]
        yield len(new), (sums % np.uint32(buckets)).astype(np.int64)


def _counted(batches: Iterable[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total, held, size = np.zeros(buckets, np.int64), [], 0
    for b in batches:
        for text in b.column(0).to_pylist():
            for _, found in features_of(text or "", longest, buckets):
                held.append(found)
                size += found.size
                if size > _HELD:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket, summed inside each task first; buckets without features are missing."""
    parts = docs.select(col(text)).mapInArrow(lambda it: _counted(it, longest, buckets), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 2, buckets: int = 10_000) -> list[int]:
    """The gain of every bucket: floor of 1000 times the logarithm of the smoothed ratio of its shares in target and documents.

    The driver receives ``buckets`` numbers, however large the tables are. Every bucket counts one feature more than it has, so
    empty tables and empty buckets have a gain too.
    """
    of = {x: bucket_counts(frame, text, longest, buckets) for x, frame in (("s", docs), ("t", target))}
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for name, counts in of.items():
        every = every.join(counts.withColumnRenamed("n", name), "bucket", "left").fillna(0, [name])
    every = settle(every)
    total = every.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    above = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    gain = F.floor(F.lit(1000.0) * F.log(above / below))
    return [r["gain"] for r in every.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def weighed(docs: DataFrame, gain: list[int], text: str = "text", longest: int = 2) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight`` (floored mean gain; 0 without features) of each whole text.

    A null text has no words. Every row is kept, extra columns included; new names get underscores where they are taken. No
    rows move between tasks.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def measure(texts: pd.Series) -> pd.DataFrame:
        table, rows = shipped.value, []
        for t in texts:
            words = count = total = 0
            for new, found in features_of(t or "", longest, table.size):
                words, count, total = words + new, count + found.size, total + int(table[found].sum())
            rows.append((words, count, total // count if count else 0))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    found = fresh(docs, "_measured")
    out = docs.withColumn(found, measure(col(text)))
    names = {n: fresh(docs, n) for n in ("n_words", "n_features", "weight")}
    return out.withColumns({new: F.col(f"{found}.{n}") for n, new in names.items()}).drop(found)


def gumbel(key: Column, seed: int = 7) -> Column:
    """Noise of a key: floor of 1000 times a Gumbel variate from the first 32 bits of the SHA-256 of ``seed:key``; null is empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(rows: DataFrame, key: str = "doc_id", percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``rows`` (made by ``weighed``) with ``score`` and ``rank``: 1, 2, ... for the drawn ones, null for all others.

    Of the N rows with at least ``least_words`` words the ``percent * N div 100`` highest scores are drawn, ties to the smaller key (null
    keys last, then the other columns in order). Rows of one score are numbered among themselves; how many stand above each score
    comes from a histogram, whose size is bounded by the range of scores. An empty table gives an empty result.
    """
    score, rank, above, open_ = (fresh(rows, x) for x in ("score", "rank", "_above", "_open"))
    scored = rows.withColumn(score, F.col("weight") + gumbel(col(key), seed))
    scored = settle(scored.withColumn(open_, F.col("n_words") >= least_words))
    fine = scored.where(F.col(open_)).groupBy(score).agg(F.count(F.lit(1)).alias("c"))
    part = F.expr(f"floor(`{score}` / {_COARSE})")
    fine = settle(fine.withColumn("part", part))
    down = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    coarse = fine.groupBy("part").agg(F.sum("c").alias("total"))
    coarse = coarse.select(
        "part", F.coalesce(F.sum("total").over(down), F.lit(0)).alias("over"),
        F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"),
    )
    inner = W.partitionBy("part").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)
    fine = fine.join(coarse, "part").select(
        F.col(score).alias("_score"), (F.col("over") + F.coalesce(F.sum("c").over(inner), F.lit(0))).alias(above),
        F.expr(f"(n * {percent}) div 100").alias("_most"),
    )
    # rows that cannot be drawn need no order: a hash spreads them
    ties = F.when(F.col(open_) & (F.col(above) < F.col("_most")), F.lit(0)).otherwise(F.xxhash64(col(key)))
    joined = scored.join(fine, F.col(score) == F.col("_score"), "left").withColumn("_ties", ties)
    others = [col(c) for c in rows.columns if c != key and not rows.schema[c].dataType.typeName().startswith("map")]
    line = W.partitionBy(score, open_, "_ties").orderBy(col(key).asc_nulls_last(), *others)
    place = F.col(above) + F.row_number().over(line)
    value = F.when(F.col(open_) & (F.col(above) < F.col("_most")) & (place <= F.col("_most")), place).cast("long")
    return joined.withColumn(rank, value).select(*[col(c) for c in rows.columns], score, rank)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 25) -> DataFrame:
    """The drawn documents themselves, all their columns unchanged."""
    whole = F.struct(*[col(c) for c in docs.columns]).alias("_doc")
    rows = weighed(docs.select(whole, col(key).alias("_key"), col(text).alias("_text")), gains(docs, target, text), "_text")
    return drawn(rows.drop("_text"), "_key", percent).where("rank is not null").select("_doc.*")
