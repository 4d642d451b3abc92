"""Exact substring de-duplication over bytes: cells of windows around sampled positions, in place of prefix doubling.

A classic suffix array ranks every byte position by strings of doubling length; nothing is ranked here. Positions are sampled so that equal
strings share them (see ``windows``). Windows around a position are cut into cells of 64, 8 and 1 bytes, and each round takes the digests of
the strings of its cells from the text anew. A position whose string is unique leaves the rounds; one whose whole neighbourhood repeats is
settled for all windows around it. Equal strings meet by their 128-bit digest in one group of a Spark shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import col, fresh
from tracewright.llm.windows import Plan, attach, distinct_texts, repeated_windows, without_repeats


def plan_of(length: int) -> Plan:
    """Gram and cell sizes for a window length in bytes."""
    cells = tuple(c for c in (64, 8) if c * 4 <= length) + (1,)
    return Plan(window=length, gram=max(1, length * 4 // 25), cells=cells, words=False)


def repeated_bytes(docs: DataFrame, text: str = "text", length: int = 400, whole_characters: bool = False) -> DataFrame:
    """Each distinct text of ``docs`` without the bytes that a string of ``length`` bytes covers which also starts elsewhere.

    Columns: ``key`` (digest of the text, for ``attach``), ``ord``, ``n_units`` (bytes), ``n_removed``, ``spans`` of removed bytes and
    ``kept`` (bytes). Strings are judged on the input; they do not cross documents; a null text is empty; texts shorter than
    ``length`` stay whole; a text held by several rows is a repeat of itself. ``whole_characters`` shrinks spans so that they
    do not cut a UTF-8 character. Empty tables give empty results.
    """
    plan = plan_of(length)
    texts = distinct_texts(docs, text, None)
    return without_repeats(texts, repeated_windows(texts, plan, smaller=False, sources=False), plan, True, whole_characters)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``; whole characters only, all other columns unchanged."""
    found = repeated_bytes(docs, text, length, whole_characters=True)
    new = fresh(docs, "_kept")
    joined = attach(docs, found.select("key", F.col("kept").cast("string").alias(new)), text)
    value = F.when(col(text).isNull(), F.lit(None).cast("string")).otherwise(F.col(new))
    return joined.select(*[value.alias(c) if c == text else col(c) for c in docs.columns])
