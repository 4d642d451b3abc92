"""Spelling variants of the words of a corpus: words that differ by one letter, and the more frequent form that each one stands for.

Words are counted inside each task first, then by Spark. The kept vocabulary is dealt into blocks by length and by the number of letters of two
classes; one edit changes the length by one at most and each class by one at most, so a block meets only its neighbours. A pair of
blocks is one row for Spark and one matrix product for NumPy: with the letter counts of the words as rows, the squared distances of all
pairs are the two squared norms minus twice the Gram matrix. One replaced letter moves the counts by two, one inserted or deleted letter
by one; pairs beyond two are out, and the few others are compared letter by letter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import col, settle

#: words of a block, columns of its matrix of letter counts, and words that a task counts before it passes them on
BLOCK, COLUMNS, HELD = 1024, 64, 200_000
RUN = re.compile("[a-zÀ-ÿ]+")
#: two of three classes of letters by frequency of use; the third is what is left. Any choice gives the same result.
CLASSES = ("[aeiouyà-ÿ]", "[nrstl]")
#: neighbours of a cell, each pair once: change of the length and of the letters of each class by one edit
STEPS = ((0, 0, 0), (0, 1, -1), (0, 1, 0), (0, 0, 1), (1, 0, 0), (1, 1, 0), (1, 0, 1))
#: from the key of a document and the counts of its words: pairs of word and count
Edit = Callable[[object, Counter], Iterable[tuple[str, int]]]
_GROUP = methodcaller("group")


def _counted(batches: Iterable[pa.RecordBatch], least: int, edit: Edit | None) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for b in batches:
        keys = b.column(1).to_pylist()
        for text, key in zip(b.column(0).to_pylist(), keys, strict=True):
            if not text:
                continue
            # bytes.lower changes A-Z only
            found = Counter(map(_GROUP, RUN.finditer(text.encode().lower().decode())))
            for word, n in found.items() if edit is None else edit(key, found):
                if len(word) >= least:
                    held[word] += n
            if len(held) > HELD:
                yield flush()
    if held:
        yield flush()


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = 6, least_count: int = 5,
                edit: Edit | None = None) -> DataFrame:
    """``(word, n)``: runs of the letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, with their occurrences.

    Words below ``least_length`` code points or ``least_count`` occurrences are out. ``edit`` may change the counts of the words of one
    document, given its key, before words are counted over all documents. A null text has no words; the rows of a repeated document
    all count; other columns are not read.
    """
    given = docs.select(col(text).alias("text"), col(key).alias("key"))
    parts = given.mapInArrow(lambda it: _counted(it, least_length, edit), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def blocks_of(words: DataFrame) -> DataFrame:
    """``(length, c0, c1, block, words)``: the vocabulary in cells, and each cell in blocks of about ``BLOCK`` words by hash."""
    cells = words.withColumns(
        {"length": F.length("word")} | {f"c{i}": F.regexp_count("word", F.lit(c)) for i, c in enumerate(CLASSES)}
    )
    sizes = cells.groupBy("length", "c0", "c1").agg(F.expr(f"(count(1) + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    dealt = cells.join(sizes, ["length", "c0", "c1"]).withColumn("block", F.pmod(F.xxhash64("word"), "blocks"))
    dealt = dealt.repartition("length", "c0", "c1", "block")  # else the words of a large cell would stay in one task
    return dealt.groupBy("length", "c0", "c1", "blocks", "block").agg(F.sort_array(F.collect_list("word")).alias("words"))


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row a word (all of one length), and letter counts, letters folded into ``COLUMNS`` columns.

    Folding adds up the counts of letters, which can only shorten distances, so no near pair is lost.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    place = np.arange(len(words))[:, None] * COLUMNS + points % COLUMNS
    counts = np.bincount(place.ravel(), minlength=len(words) * COLUMNS).reshape(len(words), COLUMNS)
    return points, counts.astype(np.float32)


def near_pairs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``left``, in ``right``) of words that differ by one edit; the words of ``right`` are as long or longer by one."""
    a, x = _matrix(left)
    b, y = _matrix(right)
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(squared <= 2.5)
    if a.shape[1] == b.shape[1]:
        good = (a[i] != b[j]).sum(1) == 1
    else:
        front = np.minimum.accumulate(a[i] == b[j][:, :-1], 1).sum(1)
        back = np.minimum.accumulate((a[i] == b[j][:, 1:])[:, ::-1], 1).sum(1)
        good = front + back >= a.shape[1]
    return i[good], j[good]


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for left, right, same in zip(*(b.column(c).to_pylist() for c in ("words", "others", "same")), strict=True):
            i, j = near_pairs(left, right)
            if same:
                i, j = i[i < j], j[i < j]
            if i.size:
                one, two = pa.array(left).take(pa.array(i)), pa.array(right).take(pa.array(j))
                both = [pa.concat_arrays([one, two]), pa.concat_arrays([two, one])]
                yield pa.RecordBatch.from_arrays(both, ["word", "near"])


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, near)`` for every two words that one inserted, deleted or replaced code point parts, both ways round."""
    blocks = settle(blocks_of(words))
    cell = ["length", "c0", "c1"]
    cells = blocks.select(*cell, "blocks").distinct()
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, cell, strict=True)]) for s in STEPS])).alias("step")
    reach = cells.select("*", steps).select(
        *cell, "blocks", *[(F.col(c) + F.col(f"step.{c}")).alias(f"{c}_") for c in cell],
        reduce(lambda p, q: p & q, [F.col(f"step.{c}") == 0 for c in cell]).alias("own"),
    )
    met = reach.join(cells.select(*[F.col(c).alias(f"{c}_") for c in cell], F.col("blocks").alias("blocks_")), [f"{c}_" for c in cell])
    pairs = met.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1)))
    pairs = pairs.where("not own or block <= block_").drop("blocks", "blocks_")
    others = blocks.select(*[F.col(c).alias(f"{c}_") for c in [*cell, "block"]], F.col("words").alias("others"))
    rows = pairs.join(blocks.drop("blocks"), [*cell, "block"]).join(others, [f"{c}_" for c in [*cell, "block"]])
    rows = rows.select("words", "others", (F.col("own") & (F.col("block") == F.col("block_"))).alias("same"))
    spread = rows.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.col("words")[0], F.col("others")[0]))
    return spread.mapInArrow(_compared, "word string, near string")


def forms(words: DataFrame, factor: int = 5) -> DataFrame:
    """Every word with ``form`` (its near word of largest count, if that is ``factor`` times its own; else null), ``form_n`` and ``n_near``.

    Ties go to the word that is smallest in code-point order.
    """
    counted = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    strong = -F.col("best.n") >= F.col("n") * factor
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.n")).cast("long").alias("form_n"),
    )


def rooted(found: DataFrame) -> DataFrame:
    """``found`` (made by ``forms``) with ``root``: the last of the forms from each word on.

    Counts grow along forms, so there is no ring; each round doubles the steps that every word has taken.
    """
    way = settle(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count()
        way = step.drop("moved")
        if not moved:
            break
    return found.join(way, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", edit: Edit | None = None) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for the words of the corpus; an empty table gives an empty result."""
    return rooted(settle(forms(settle(word_counts(docs, text, key, edit=edit)))))
