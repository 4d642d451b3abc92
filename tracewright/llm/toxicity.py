"""Toxicity of texts by a convolutional classifier: hashed embeddings, filters of several widths, max pooling, logistic output.

A word is the sum of the embeddings of its hash and of the hashes of its first bytes, so inflected forms of a stem share what was learnt.
Filters of one to three words slide over the whole text, each keeps its largest response, and a logistic layer weighs them. The text is
all that the score sees. It is trained in NumPy, in one task, on a sample of labelled rows of bounded size (``MOST`` documents of each
class, ``MOST_WORDS`` words in all, chosen by a hash of the id); only the responses that won the pooling carry gradients.

``calibrate`` then picks the threshold of each language, by its labelled rows, where F1 is largest; it decides ``flagged`` and never the score.
Texts are read in pieces, so memory does not grow with their length, and scoring moves no rows between tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.common import col, fresh, settle

#: bounds of the training sample: documents of each class, words in all
MOST, MOST_WORDS = 3_000, 4_000_000
#: rows of the embedding table, its columns, first bytes of a word that are hashed too, widths of filters, filters of each width
BUCKETS, COLUMNS, LEADING, WIDTHS, FILTERS = 1 << 15, 16, (5, 7), (1, 2, 3), 16
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.08, 2e-4
#: documents of each class that a language needs for a threshold of its own, and steps of thresholds
ENOUGH, STEPS = 5, 200
_PIECE, _ROWS = 1 << 19, 4096
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


#: what a byte adds to the hash of its word, A-Z as a-z; 0 for the ASCII characters that part words
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=_U)
_BYTES[65:91] = _BYTES[97:123]
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _folded(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) + _U(salt)
    h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB)
    return 1 + ((h ^ (h >> _U(31))) % _U(BUCKETS - 1)).astype(np.int32)


def word_ids(raw: np.ndarray) -> np.ndarray:
    """Rows of the embedding table for every word of some bytes: of the word, and of its first bytes (0 where it has no more)."""
    solid = np.concatenate([[False], ~_PARTS[raw], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(max(_PIECE * 2, 1 << (raw.size + 1).bit_length()))
    total = np.zeros(raw.size + 1, _U)
    np.cumsum(_BYTES[raw] * up[: raw.size], out=total[1:])
    ids = np.zeros((start.size, 1 + len(LEADING)), np.int32)
    for i, most in enumerate((raw.size, *LEADING)):
        h = (total[np.minimum(end, start + most)] - total[start]) * down[start]
        ids[:, i] = np.where((i == 0) | (end - start > most), _folded(h, i), 0)
    return ids


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """``word_ids`` of a whole text, in pieces that end between words; at least one, which stands for a text without words if need be."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    at, some = 0, False
    while at < raw.size:
        cut = min(raw.size, at + _PIECE)
        while cut < raw.size:
            gap = np.flatnonzero(_PARTS[raw[cut : cut + _PIECE]])
            if gap.size:
                cut += int(gap[0])
                break
            cut = min(raw.size, cut + _PIECE)
        ids = word_ids(raw[at:cut])
        at = cut
        if ids.size:
            some = True
            yield ids
    if not some:
        yield np.zeros((1, 1 + len(LEADING)), np.int32)


@dataclass
class Net:
    """Embeddings, filters ``[width][place] -> (COLUMNS, FILTERS)`` as one matrix, their offsets, and the output layer."""

    table: np.ndarray
    filters: np.ndarray  # (COLUMNS, sum(WIDTHS) * FILTERS): place after place, width after width
    offsets: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (BUCKETS, COLUMNS)).astype(np.float32)
        table[0] = 0
        n = len(WIDTHS) * FILTERS
        filters = rng.normal(0, 0.3, (COLUMNS, sum(WIDTHS) * FILTERS)).astype(np.float32)
        return Net(table, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.offsets, self.out, self.bias]

    def dump(self) -> bytes:
        return b"".join(p.astype("<f4").tobytes() for p in self.parts())

    @staticmethod
    def load(raw: bytes) -> Net:
        shapes, flat, at, out = [p.shape for p in Net.start().parts()], np.frombuffer(raw, "<f4"), 0, []
        for s in shapes:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return Net(*out)

    def responses(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings with two empty words behind them, and the response of every filter at every word."""
        x = np.zeros((len(ids) + WIDTHS[-1] - 1, COLUMNS), np.float32)
        for i in range(ids.shape[1]):
            x[: len(ids)] += self.table[ids[:, i]]
        placed = x @ self.filters
        z = np.empty((len(ids), len(WIDTHS) * FILTERS), np.float32)
        at = 0
        for k, w in enumerate(WIDTHS):
            part = z[:, k * FILTERS : (k + 1) * FILTERS]
            part[:] = placed[: len(ids), at : at + FILTERS]
            for o in range(1, w):
                part += placed[o : o + len(ids), at + o * FILTERS : at + (o + 1) * FILTERS]
            at += w * FILTERS
        return x, z

    def score(self, text: str | None) -> float:
        """Probability that a whole text is toxic."""
        best, rest, reach = np.full(self.offsets.size, -np.inf, np.float32), None, WIDTHS[-1] - 1
        for ids in pieces(text):
            rest = ids if rest is None else np.concatenate([rest, ids])
            while len(rest) > _ROWS + reach:  # filters reach into the words behind, of the next piece too
                best = np.maximum(best, self.responses(rest[: _ROWS + reach])[1][:_ROWS].max(0))
                rest = rest[_ROWS:]
        best = np.maximum(best, self.responses(rest)[1].max(0))
        value = float(np.maximum(best + self.offsets, 0) @ self.out + self.bias[0])
        return 1 / (1 + np.exp(-np.clip(value, -30.0, 30.0)))


def _places() -> list[tuple[int, int, slice, slice]]:
    """(width, place, columns of the filter matrix, columns of the responses)."""
    out, at = [], 0
    for k, w in enumerate(WIDTHS):
        for o in range(w):
            out.append((w, o, slice(at, at + FILTERS), slice(k * FILTERS, (k + 1) * FILTERS)))
            at += FILTERS
    return out


def trained(docs: list[tuple[np.ndarray, float]], seed: int = 5) -> Net:
    """A net fitted to (word ids, label from 0 to 1) by stochastic gradients with one step size per weight.

    Each class has the same weight in the loss up to a square root, so that rare toxic texts count without drowning the clean ones.
    """
    net, rng = Net.start(seed), np.random.default_rng(seed)
    if not docs:
        return net
    y = np.array([v for _, v in docs], np.float32)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    net.bias[0] = np.log(share / (1 - share)) / 2
    ratio = np.sqrt((1 - share) / share)
    seen = [np.full(p.shape[:1] if p is net.table else p.shape, 1e-2, np.float32) for p in net.parts()]
    places = _places()
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 0.005
        order = rng.permutation(len(docs))
        for b in range(0, len(order), BATCH):
            chosen = order[b : b + BATCH]
            gap = np.zeros((WIDTHS[-1] - 1, docs[0][0].shape[1]), np.int32)
            ids = np.concatenate([x for i in chosen for x in (docs[i][0], gap)])
            x, z = net.responses(ids)
            ids = np.concatenate([ids, gap])
            best = np.empty((len(chosen), z.shape[1]), np.int64)
            at = 0
            for r, i in enumerate(chosen):
                n = len(docs[i][0])
                best[r] = at + z[at : at + n].argmax(0)
                at += n + len(gap)
            pooled = np.take_along_axis(z, best, 0) + net.offsets
            active = np.maximum(pooled, 0)
            kept = rng.random(active.shape) < 0.8  # dropout
            active = active * kept / 0.8
            p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.bias[0], -30, 30)))
            weight = y[chosen] * ratio + (1 - y[chosen])
            delta = (weight * (p - y[chosen]) / len(chosen)).astype(np.float32)
            back = (delta[:, None] * net.out * (pooled > 0) * kept / 0.8).astype(np.float32)
            grads = [None, np.zeros_like(net.filters), back.sum(0), active.T.astype(np.float32) @ delta + DECAY * net.out, delta.sum(keepdims=True)]
            rows, moves = [], []
            for _, o, fs, zs in places:
                spot = best[:, zs] + o
                grads[1][:, fs] = np.einsum("bf,bfd->df", back[:, zs], x[spot]) + DECAY * net.filters[:, fs]
                rows.append(spot.ravel())
                moves.append((back[:, zs, None] * net.filters[:, fs].T[None]).reshape(-1, COLUMNS))
            used, inverse = np.unique(ids[np.concatenate(rows)].ravel(), return_inverse=True)
            step = np.zeros((used.size, COLUMNS), np.float32)
            np.add.at(step, inverse, np.repeat(np.concatenate(moves), ids.shape[1], 0))
            step += DECAY * net.table[used]
            step[used == 0] = 0
            seen[0][used] += (step * step).mean(1)
            net.table[used] -= rate * step / np.sqrt(seen[0][used])[:, None]
            for part, grad, sums in zip(net.parts()[1:], grads[1:], seen[1:], strict=True):
                sums += grad * grad
                part -= rate * grad / np.sqrt(sums)
    return net


def _encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [np.concatenate(list(pieces(t))) for t in b.column("text").to_pylist()]
        sizes, raw = pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), sizes, raw], ["h", "y", "n", "ids"])


def _fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += zip(b.column("h").to_pylist(), b.column("ids").to_pylist(), b.column("y").to_pylist(), strict=True)
    rows.sort()
    docs = [(np.frombuffer(x, np.int32).reshape(-1, 1 + len(LEADING)), y) for _, x, y in rows]
    yield pa.RecordBatch.from_arrays([pa.array([trained(docs).dump()], pa.binary())], ["net"])


def votes(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``(_id, y)``: the mean label of each labelled document; null ids and null labels are left out."""
    known = labels.where(col(doc_id).isNotNull() & col(label).isNotNull())
    return known.groupBy(col(doc_id).alias("_id")).agg(F.avg(F.when(col(label) > 0, 1.0).otherwise(0.0)).alias("y"))


def fit(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """Train on a bounded sample of ``labelled`` (made by ``votes``) and the whole texts of those documents.

    The sample holds up to ``MOST`` documents of each class, in order of a hash of their id, as far as ``MOST_WORDS`` words go. Without
    labelled documents the net is left as it starts and knows nothing.
    """
    classes = [labelled.where(c).withColumn("h", F.xxhash64("_id")).orderBy("h", "_id").limit(MOST) for c in ("y >= 0.5", "y < 0.5")]
    sample = classes[0].unionByName(classes[1])  # 2 * MOST rows at most
    texts = docs.select(col(doc_id).alias("_doc"), col(text).alias("text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    coded = texts.select("h", "y", "text").mapInArrow(_encoded, "h long, y double, n long, ids binary")
    coded = settle(coded).orderBy("h", "n").limit(2 * MOST)
    so_far = F.sum("n").over(W.orderBy("h", "n", "ids").rowsBetween(W.unboundedPreceding, W.currentRow))
    chosen = coded.withColumn("so_far", so_far).where(F.col("so_far") <= MOST_WORDS)
    net = chosen.select("h", "y", "ids").repartition(1).mapInArrow(_fitted, "net binary")
    return bytes(net.first()["net"])


def scored(docs: DataFrame, net: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of each whole text; a null text is empty, and an empty one scores like one of unknown words.

    Every row and column is kept; the new name gets underscores where it is taken.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = _loaded(shipped.value)
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.withColumn(fresh(docs, "score"), score(col(text)))


@lru_cache(maxsize=2)
def _loaded(raw: bytes) -> Net:
    return Net.load(raw)


def calibrate(known: DataFrame, lang: str = "lang", score: str = "score") -> DataFrame:
    """``(_lang, threshold)`` by the labelled rows ``known`` (with ``y`` from 0 to 1), and a row of null ``_lang`` and ``pooled`` for all others.

    The threshold of a language is where F1 is largest among ``STEPS`` steps, the highest such step; languages with fewer than ``ENOUGH`` rows of
    either class have the pooled one, and 0.5 holds where nothing is labelled.
    """
    step = F.least(F.floor(col(score) * STEPS), F.lit(STEPS - 1))
    cut = known.select(col(lang).alias("_lang"), step.alias("step"), "y").groupBy("_lang", "step").agg(
        F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")
    )
    own = cut.withColumn("pooled", F.lit(False))
    every = cut.groupBy("step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    every = every.select(F.lit(None).cast(known.schema[lang].dataType).alias("_lang"), "step", "good", "bad", F.lit(True).alias("pooled"))
    both = own.unionByName(every)
    down = W.partitionBy("pooled", "_lang").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("pooled", "_lang")
    ranked = both.select(
        "_lang", "pooled", "step", F.sum("good").over(down).alias("hit"), F.sum("bad").over(down).alias("false"),
        F.sum("good").over(whole).alias("all"), F.sum("bad").over(whole).alias("clean"),
    )
    f1 = 2 * F.col("hit") / (F.col("hit") + F.col("false") + F.col("all"))
    best = ranked.where(f"pooled or (all >= {ENOUGH} and clean >= {ENOUGH})").groupBy("_lang", "pooled").agg(
        F.max_by("step", F.struct(f1.alias("f1"), "step")).alias("step"), F.max("all").alias("all"), F.max("clean").alias("clean")
    )
    value = F.when((F.col("all") > 0) & (F.col("clean") > 0), F.col("step") / STEPS).otherwise(0.5)
    return best.select("_lang", "pooled", value.alias("threshold"))


def flagged(rows: DataFrame, thresholds: DataFrame, lang: str = "lang", score: str = "score") -> DataFrame:
    """``rows`` with ``threshold`` (of the row's language) and ``flagged``; a language without one, null too, has the pooled one."""
    pooled = thresholds.where("pooled").first()
    other = float(pooled["threshold"]) if pooled else 0.5
    own = thresholds.where("not pooled").select("_lang", F.col("threshold").alias("_own"))
    value, flag = fresh(rows, "threshold"), fresh(rows, "flagged")
    joined = rows.join(own, col(lang).eqNullSafe(F.col("_lang")), "left").withColumn(value, F.coalesce("_own", F.lit(other)))
    return joined.drop("_lang", "_own").withColumn(flag, col(score) >= F.col(value))
