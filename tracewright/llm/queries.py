"""The registered queries ``opN_<name>``: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import (
    bpe, common, debruijn, embedding_dedup, mixing, nearest, quality, resampling, sharding, simhash, suffix_dedup, toxicity,
    url_filter, variants, windows,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def utf8(text: str = "text"):
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    size = (F.octet_length(utf8()) + 8).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(utf8()).alias("text_crc32"))
    placed = sharding.assign_shards(rows, 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), F.crc32(utf8()).alias("text_crc32"))
    mixed = mixing.mix(rows)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.repeated_bytes(docs)
    digests = found.select(
        "key", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    return windows.attach(docs, digests, "text").drop("text")


@query
def op4_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = debruijn.first_occurrences(docs)
    digests = found.select("key", "ord", "n_units", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    joined = debruijn.attach_first(docs, digests)
    return joined.select(
        "doc_id",
        F.col("n_units").alias("n_words"),
        F.when(F.col("later"), F.col("n_units")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("later"), F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_dedup.near_duplicates(vectors)


@query
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, F.col("id") % 50 == 0)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    known = common.settle(quality.featured(docs).drop("text"))
    return quality.score(known, quality.fit(known, common.table(spark, sf_dir, "labels")))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(docs, path), path)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    held_out = F.coalesce(part == 0, F.lit(False))
    known = common.settle(toxicity.votes(common.table(spark, sf_dir, "labels").where(~held_out)))
    net = toxicity.fit(docs, known)
    scored = common.settle(toxicity.scored(docs, net).drop("text"))
    thresholds = common.settle(toxicity.calibrate(scored.join(known, F.col("doc_id") == F.col("_id"))))
    return toxicity.flagged(scored, thresholds).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang", "threshold", "flagged"
    )


def drop_letter(doc_id: int | None, counts: Counter) -> Iterator[tuple[str, int]]:
    """The contract's changed words: where 199 divides the CRC-32 of ``<doc_id>:<word>``, one letter goes."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), start)
        if h % 199 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


@query
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.variants(docs, edit=drop_letter).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = resampling.gains(docs, common.table(spark, sf_dir, "benchmark"))
    rows = resampling.drawn(resampling.weighed(docs, gain).drop("text"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
