"""Repeated passages of words, by cells of windows in place of compaction of a de Bruijn graph of the corpus.

Consecutive windows of 50 words that share the minimiser of their grams form one run. Runs are cut into cells; a cell whose core
continues alike wherever it occurs is settled at once, where several continuations exist it is cut finer, down to single windows (see
``windows``). No edge table or degrees are built. Every repeated run keeps the coordinates of its source, in the document of smallest id that
holds it; they are carried, not verified again. Only ``repeated_passages`` glues adjacent runs into maximal spans; the query does not need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.common import col, fresh
from tracewright.llm.windows import Plan, attach, distinct_texts, rank_of, repeated_windows, without_repeats


def plan_of(length: int) -> Plan:
    """Gram and cell sizes for a window length in words."""
    cells = tuple(c for c in (16, 4) if c * 3 <= length) + (1,)
    return Plan(window=length, gram=max(1, length // 5), cells=cells, words=True)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """Glued repeated spans per distinct text: ``key, start, n_words, source_key, source_start``.

    A span is a maximal row of windows that stand in the same order in the source text.
    """
    plan = plan_of(length)
    marks = repeated_windows(distinct_texts(docs, text, doc_id), plan, smaller=True)
    marks = marks.withColumn("shift", F.col("lo") - F.col("source_lo"))
    line = W.partitionBy("key", "source_key", "shift").orderBy("lo")
    gap = F.col("lo") > F.coalesce(F.lag(F.col("lo") + F.col("n")).over(line), F.lit(-1))
    piece = F.sum(F.when(gap, 1).otherwise(0)).over(line.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marks.withColumn("piece", piece).groupBy("key", "source_key", "shift", "piece").agg(
        F.min("lo").alias("start"),
        (F.max(F.col("lo") + F.col("n")) - F.min("lo") + length - 1).alias("n_words"),
    ).select("key", "start", "n_words", "source_key", (F.col("start") - F.col("shift")).alias("source_start"))


def first_occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """Each distinct text without the words covered by a window of ``length`` words that also starts in a document of smaller id.

    Columns: ``key``, ``ord`` (smallest id with the text), ``n_units`` (words), ``n_removed``, ``spans`` of removed words, ``kept`` (words
    joined by one space, bytes). It holds for the document of smallest id; in any later one all windows repeat (see ``remove_later``).
    Words are runs of anything but space and the controls 9 to 13. A null text has none; null ids come after all ids and
    before none, so two of them never remove each other's words; rows of equal id and text are treated alike.
    """
    plan = plan_of(length)
    texts = distinct_texts(docs, text, doc_id)
    return without_repeats(texts, repeated_windows(texts, plan, smaller=True, sources=False), plan, False)


def attach_first(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """Results per distinct text for every document, with ``later``: whether a smaller id has the whole text.

    New names get underscores where they are taken.
    """
    later, ord_, units = (fresh(docs, c) for c in ("later", "_ord", "n_units"))
    joined = attach(docs, found.withColumnRenamed("ord", ord_), text)
    return joined.withColumn(later, (rank_of(col(doc_id)) > F.col(ord_)) & (F.col(units) >= length)).drop(ord_)


def remove_later(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """``docs`` with repeated words cut out of ``text``; all other columns unchanged, whatever their names."""
    found = first_occurrences(docs, doc_id, text, length)
    found = found.select("key", "ord", "n_units", F.col("kept").cast("string").alias("_kept"))
    whole = F.struct(*[col(c) for c in docs.columns]).alias("_doc")
    packed = docs.select(whole, col(doc_id).alias("_id"), col(text).alias("_text"))
    joined = attach_first(packed, found, "_id", "_text", length)
    cut = F.when(F.col("_text").isNull(), F.lit(None).cast("string")).when(F.col("later"), "").otherwise(F.col("_kept"))
    return joined.select(*[(cut if c == text else F.col("_doc")[c]).alias(c) for c in docs.columns])
