"""Windows of fixed length that occur more than once, over bytes or words of whole texts.

All windows of a text are covered by a small sample of positions. The smallest hash among a window's grams owns the window, so equal windows
have equal owners at equal distances, wherever they stand; runs of windows with one owner (about one run per 170 windows of
400 bytes) are what Spark shuffles. Rounds then rank ever longer strings at the sampled positions:

1. the owner's gram alone: positions are sorted by it over all tasks, and one that differs from both neighbours holds no repeated window
   and drops out. A gram that a third of all texts hold is a stretch of the order, split wherever the sort cuts it;
2. runs are cut into cells by the distance to their owner. The *core* of a cell is what all its windows share, the *hull* what they
   cover together. A unique core ends the cell; a hull that occurs twice settles all its windows at once; a core
   with several hulls branches, and one copy of each hull is cut finer (all copies of the smallest ``ord`` of the hull, where only
   windows of smaller texts count and the hull has no source yet);
3. the last cells are single windows, where core and hull are the window itself.

Equality is that of 128-bit digests of the content. Texts are kept once, in a table bucketed by their digest, so no round
shuffles text. Every grouping is combined before its shuffle and every join back is on a key whose other side is unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import col, fresh, release, settle, settle_bucketed, written

LAST = 2**63 - 1
_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=_U) | _U(1)
_POWERS: list[np.ndarray] = []


@dataclass(frozen=True)
class Plan:
    """Length of a window, of a gram, the cell sizes of the rounds (the last is 1), and what a unit is (bytes or words)."""

    window: int
    gram: int
    cells: tuple[int, ...]
    words: bool


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if _POWERS and _POWERS[0].size >= n:
        return _POWERS[0], _POWERS[1]
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, dtype=_U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    if n <= 2 * _PIECE + 4096:
        _POWERS[:] = out
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(values.size + 1, _PIECE + 4096))
    total = np.zeros(values.size + 1, _U)
    np.cumsum(values * up[: values.size], out=total[1:])
    return total, down


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    total, down = _sums(values)
    return _mixed((total[gram:] - total[:-gram]) * down[: values.size - gram + 1])


class Units:
    """A text as bytes, or as words joined by single spaces, with slices by unit."""

    def __init__(self, text: bytes, words: bool) -> None:
        self.words = words
        if words:
            text = b" ".join(text.split())
            gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            self.start = np.concatenate([[0], gaps + 1]) if text else np.zeros(0, np.int64)
            self.end = np.concatenate([gaps, [len(text)]]) if text else np.zeros(0, np.int64)
        self.text = text
        self.n = self.start.size if words else len(text)

    def slice(self, i: int, j: int) -> bytes:
        """Content of units i..j-1, where i < j."""
        return self.text[self.start[i] : self.end[j - 1]] if self.words else self.text[i:j]

    def values(self) -> np.ndarray:
        if not self.words:
            return _TABLE[np.frombuffer(self.text, np.uint8)]
        out, raw, at, w = np.empty(self.n, _U), np.frombuffer(self.text, np.uint8), 0, 0
        while w < self.n:
            w2 = max(w + 1, int(np.searchsorted(self.end, at + _PIECE, "right")))
            total, down = _sums(_TABLE[raw[at : self.end[w2 - 1]]])
            s, e = self.start[w:w2] - at, self.end[w:w2] - at
            out[w:w2] = _mixed((total[e] - total[s]) * down[s])
            at, w = int(self.end[w2 - 1]) + 1, w2
        return out


def owned_runs(values: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (gram hash, owner position, first window, number of windows), piece by piece of a long text."""
    width = window - gram + 1
    for base in range(0, max(0, values.size - window + 1), _PIECE):
        part = values[base : base + _PIECE + window - 1]
        h = gram_hashes(part, gram)
        # the hash in front, the position behind it: equal hashes go to the right-most
        v = (h >> _U(20) << _U(20)) | (_U(0xFFFFF) - np.arange(h.size, dtype=_U))
        x = np.concatenate([v, np.full(-h.size % width, ~_U(0))]).reshape(-1, width)
        left = np.minimum.accumulate(x, 1).ravel()
        right = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
        m = h.size - width + 1
        own = (_U(0xFFFFF) - (np.minimum(right[:m], left[width - 1 : width - 1 + m]) & _U(0xFFFFF))).astype(np.int64)
        cut = np.flatnonzero(np.diff(own)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [m]])
        yield h[own[lo]].view(np.int64), own[lo] + base, lo + base, hi - lo


def _runs_of(batches, plan: Plan):
    for b in batches:
        keys, out = b.column("key").to_pylist(), []
        for key, text in zip(keys, b.column("text").to_pylist(), strict=True):
            u = Units(text, plan.words)
            if u.n >= plan.window:
                for arrays in owned_runs(u.values(), plan.window, plan.gram):
                    out.append((key, arrays))
        if out:
            lengths = [a[0].size for _, a in out]
            cols = [np.concatenate([a[k] for _, a in out]) for k in range(4)]
            which = pa.array(np.repeat(np.arange(len(out)), lengths))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.binary()).take(which), *map(pa.array, cols)], ["key", "gram", "a", "lo", "n"]
            )


def _shared_of(batches):
    """Rows of sorted batches whose gram equals a neighbour's; the first and last row of the task too, as theirs may stand in another."""
    names, before, held = ["key", "a", "lo", "n"], None, None
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("gram").to_numpy()
        same = g[1:] == g[:-1]
        left = np.concatenate([[before is None or g[0] == before], same])
        # whether the last row has an equal neighbour behind it shows in the next batch, so that row is held back
        if held is not None and (held[1] or left[0]):
            yield held[0].select(names)
        keep = left[:-1] | same
        before, held = g[-1], (b.slice(b.num_rows - 1), bool(left[-1]))
        if keep.any():
            yield b.slice(0, b.num_rows - 1).filter(pa.array(keep)).select(names)
    if held is not None:
        yield held[0].select(names)


def shared_grams(runs: DataFrame) -> DataFrame:
    """Runs (``key, a, lo, n``) whose gram stands elsewhere too, and at most two more a task.

    Runs are dealt by ranges of (gram, text, position) and sorted, so no task holds more of a frequent gram than its share of the order.
    """
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["gram", "key", "a", "lo"]
    in_order = runs.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return in_order.mapInArrow(_shared_of, "key binary, a long, lo long, n long")


_CELL = pa.schema(
    [("key", pa.binary()), ("ord", pa.int64()), ("core", pa.binary()), ("hull", pa.binary()), ("a", pa.int64()),
     ("lo", pa.int64()), ("n", pa.int64()), ("w", pa.int64())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CELL.types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_CELL)


def _cells_of(batches, plan: Plan, size: int):
    digest = xxhash.xxh3_128_digest
    for b in batches:
        rows: list[tuple] = []
        columns = (b.column(c).to_pylist() for c in ("key", "text", "ord", "copies", "spans"))
        for key, text, rank, copies, spans in zip(*columns, strict=True):
            u = Units(text, plan.words)
            for s in spans:
                a, lo, w = s["a"], s["lo"], s["w"] or copies
                near, far = a - (lo + s["n"] - 1), a - lo
                for q in range(near // size, far // size + 1):
                    j0, j1 = max(near, q * size), min(far, q * size + size - 1)
                    hull = digest(u.slice(a - j1, a - j0 + plan.window), (j0 << 32) | j1)
                    core = hull
                    if size > 1:
                        core = digest(u.slice(a - q * size, a - q * size - size + 1 + plan.window), (1 << 62) | (size << 32) | q)
                    rows.append((key, rank, core, hull, a, a - j1, j1 - j0 + 1, w))
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def rank_of(order: Column | None) -> Column:
    """Documents in order of their id, null ids after all others."""
    return F.lit(LAST) if order is None else F.coalesce(order.cast("long"), F.lit(LAST))


def distinct_texts(docs: DataFrame, text: str, order: str | None) -> DataFrame:
    """Each text once: ``key``, ``text`` (bytes), ``copies`` and the smallest id ``ord``; bucketed by key in the shared folder."""
    raw = docs.select(
        text_key(col(text)).alias("key"), F.coalesce(col(text), F.lit("")).cast("binary").alias("text"),
        rank_of(col(order) if order else None).alias("ord"),
    )
    once = raw.groupBy("key").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("ord").alias("ord")
    )
    return settle_bucketed(once, "key")


def _per_text(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts with their spans: bounded by the text, since spans of a text do not overlap more than their rounds."""
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("a", "lo", "n", "w")).alias("spans"))
    return texts.join(lists, "key")


def repeated_windows(texts: DataFrame, plan: Plan, smaller: bool, sources: bool = True) -> DataFrame:
    """Runs of repeated windows: ``key, lo, n`` and, with ``sources``, ``source_key, source_lo``.

    With ``smaller`` a window counts where an equal one starts in a text of smaller ``ord``; else where one starts anywhere
    else, in another copy of the text or in the same one. The source is an occurrence in the text of smallest ``ord``.
    What a round found is stored, so its tables go as soon as the next round has its cells.
    """
    spark, before = texts.sparkSession, written()
    runs = settle(
        texts.select("key", "text").mapInArrow(
            lambda it: _runs_of(it, plan), "key binary, gram long, a long, lo long, n long"
        )
    )
    spent = written() - before
    spans = shared_grams(runs).withColumn("w", F.lit(None).cast("long"))
    found: DataFrame | None = None
    # a hull carries what its rule asks for and no more: every byte of it is shuffled
    told = [F.min("ord").alias("least"), F.max("ord").alias("most")] if smaller else [F.sum("w").alias("c")]
    source = [F.col("one.key").alias("source_key"), F.col("one.lo").alias("source_lo")] if sources else []
    for size in plan.cells:
        given = _per_text(texts, spans)
        cells = given.select("key", "text", "ord", "copies", "spans").mapInArrow(
            lambda it, size=size: _cells_of(it, plan, size),
            "key binary, ord long, core binary, hull binary, a long, lo long, n long, w long",
        )
        before = written()
        cells = settle(cells)
        release(spark, spent, texts)
        hulls = settle(
            cells.groupBy("hull").agg(
                F.min("core").alias("core"), *told, F.min(F.struct("ord", "key", "lo", "a", "n")).alias("one"),
            )
        )
        spent = written() - before
        again = hulls.where("most > least" if smaller else "c > 1")
        again = again.select("hull", *(["least"] if smaller else []), *source)
        marks = cells.join(again, "hull")
        if smaller:
            marks = marks.where("ord > least")
        marks = settle(marks.select("key", "lo", "n", *(("source_key", "source_lo") if sources else ())))
        found = marks if found is None else found.unionByName(marks)
        if size == 1:
            break
        open_ = F.max("least") > F.min("least") if smaller else F.min("c") == 1
        branching = hulls.groupBy("core").agg(
            F.count(F.lit(1)).alias("width"), open_.alias("open"), *([F.min("least").alias("first")] if smaller else [])
        ).where("width > 1 and open")
        if smaller:
            # every copy that has no source yet goes on, but of hulls that hold the first text of their core one copy as a source
            cut = hulls.join(branching, "core").select("hull", "least", "first", "one")
            spans = cells.join(cut, "hull").where("ord = least and (least > first or (key = one.key and a = one.a and lo = one.lo))")
            spans = spans.select("key", "a", "lo", "n", "w")
        else:
            spans = hulls.join(branching, "core", "left_semi").select(
                F.col("one.key").alias("key"), F.col("one.a").alias("a"), F.col("one.lo").alias("lo"), F.col("one.n").alias("n"),
                F.col("c").alias("w"),
            )
    release(spark, spent, texts)
    return found


def covered(los: np.ndarray, ns: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of units covered by windows lo..lo+n-1."""
    order = np.argsort(los, kind="stable")
    lo = los[order]
    end = np.maximum.accumulate(lo + ns[order] - 1 + window)
    first = np.concatenate([[True], lo[1:] > end[:-1]])
    at = np.flatnonzero(first)
    return lo[at], end[np.concatenate([at[1:] - 1, [lo.size - 1]])]


def _whole_characters(text: bytes, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _kept_of(batches, plan: Plan, whole: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        ns, removed, spans, kept = [], [], [], []
        for text, copies, marks in zip(*(b.column(c).to_pylist() for c in ("text", "copies", "marks")), strict=True):
            u = Units(text, plan.words)
            runs: list[tuple[int, int]] = []
            if copies > 1 and u.n >= plan.window:
                runs = [(0, u.n)]
            elif marks:
                los, sizes = (np.fromiter((m[k] for m in marks), np.int64, len(marks)) for k in ("lo", "n"))
                runs = list(zip(*(x.tolist() for x in covered(los, sizes, plan.window)), strict=True))
                if whole:
                    runs = [r for r in (_whole_characters(text, *r) for r in runs) if r[0] < r[1]]
            parts, at = [], 0
            for s, e in runs:
                if s > at:
                    parts.append(u.slice(at, s))
                at = e
            if at < u.n:
                parts.append(u.slice(at, u.n))
            ns.append(u.n)
            removed.append(sum(e - s for s, e in runs))
            spans.append([{"start": s, "end": e} for s, e in runs])
            kept.append((b" " if plan.words else b"").join(parts))
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("ord"), pa.array(ns, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind),
             pa.array(kept, pa.binary())], ["key", "ord", "n_units", "n_removed", "spans", "kept"],
        )


def without_repeats(texts: DataFrame, marks: DataFrame, plan: Plan, whole_copies: bool, whole_characters: bool = False) -> DataFrame:
    """Each distinct text without its repeated windows: ``key, ord, n_units, n_removed, spans(start, end), kept`` (bytes).

    With ``whole_copies`` a text that several documents share is itself a repeat.
    """
    lists = marks.groupBy("key").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))
    given = texts.join(lists, "key", "left").select(
        "key", "ord", "text", (F.col("copies") if whole_copies else F.lit(1).cast("long")).alias("copies"), "marks"
    )
    return given.mapInArrow(
        lambda it: _kept_of(it, plan, whole_characters),
        "key binary, ord long, n_units long, n_removed long, spans array<struct<start: long, end: long>>, kept binary",
    )


def attach(docs: DataFrame, results: DataFrame, text: str) -> DataFrame:
    """Join what was found per distinct text back to every document; ``results`` has ``key`` and columns of its own, whose names
    are changed where they clash."""
    key = fresh(docs, "_text_key")
    named = results.select(*[F.col(c).alias(key if c == "key" else fresh(docs, c)) for c in results.columns])
    return docs.withColumn(key, text_key(col(text))).join(named, key).drop(key)
