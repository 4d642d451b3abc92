"""Approximate nearest neighbours by cosine: stable projections, a kd-tree over them, and a chi-square stopping test.

Unit vectors are projected on a few Gaussian directions. The squared projected distance of two points over their squared distance follows a
chi-square law, so once the projected distance of everything unseen exceeds ``quantile * (distance of the k-th best)`` each
unseen point is nearer only with probability ``1 - confidence``, and the search stops. Upper levels of the kd-tree are fitted on a bounded sample and
deal all rows over leaves; leaves are cut into blocks of bounded size with a kd-tree of their own. A query first searches its own leaf, which
gives it a bound, then only the leaves whose box passes the test; blocks and queries meet as rows of a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.common import settle
from tracewright.llm.vectors import block_rows, matrix, unit, valid_rows

#: rows of the bounded sample that the upper kd-tree is fitted on, rows aimed at per leaf, and the most leaves
FIT_ROWS, LEAF_ROWS, MOST_LEAVES = 20_000, 2048, 4096
SMALL = 64


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number of degrees of freedom, from the closed form of the distribution."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(100):
        lo, hi = ((lo + hi) / 2, hi) if below((lo + hi) / 2) < p else (lo, (lo + hi) / 2)
    return hi


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, m]).standard_normal((dim, m))


class Splits:
    """Upper kd-tree: medians along the widest side, down to a given depth."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.axis = np.zeros(1 << depth, np.int32)
        self.at = np.zeros(1 << depth)
        self.depth = depth
        parts = {1: points}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            if len(own):
                axis = int(np.argmax(own.max(0) - own.min(0)))
                at = float(np.median(own[:, axis]))
                self.axis[node], self.at[node] = axis, at
                low = own[:, axis] <= at
                parts[2 * node], parts[2 * node + 1] = own[low], own[~low]
            else:
                parts[2 * node] = parts[2 * node + 1] = own

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[rows, self.axis[node]] > self.at[node])
        return node.astype(np.int32)


def _gap(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of one point to boxes."""
    d = np.maximum(np.maximum(low - p, p - high), 0.0)
    return (d * d).sum(1)


class Block:
    """Vectors of one block under a small kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, g: np.ndarray) -> None:
        p = unit(vecs) @ g
        parts, stack = [], [np.arange(len(ids))]
        while stack:
            own = stack.pop()
            if own.size <= SMALL:
                parts.append(own)
                continue
            axis = int(np.argmax(p[own].max(0) - p[own].min(0)))
            order = own[np.argsort(p[own, axis], kind="stable")]
            stack += [order[: own.size // 2], order[own.size // 2 :]]
        self.low = np.array([p[o].min(0) for o in parts])
        self.high = np.array([p[o].max(0) for o in parts])
        self.parts = [(ids[o], vecs[o], np.sqrt((vecs[o] * vecs[o]).sum(1))) for o in parts]

    def search(self, own: int | None, q: np.ndarray, g: np.ndarray, k: int, bound: float, quantile: float):
        """The k best (cosine, id) other than the query itself, in order; ``bound`` is a squared distance already reached."""
        norm = float(np.sqrt((q * q).sum()))
        gaps = _gap(q / norm @ g, self.low, self.high)
        best: list[tuple[float, int]] = []
        for part in np.argsort(gaps, kind="stable").tolist():
            if gaps[part] > quantile * bound:
                break
            ids, vecs, norms = self.parts[part]
            cosine = (vecs * q).sum(1) / (norms * norm)
            if len(best) == k:
                some = np.flatnonzero((cosine >= -best[-1][0]) & (ids != own))
            else:
                some = np.flatnonzero(ids != own)
            best = sorted(best + [(-float(cosine[i]), int(ids[i])) for i in some.tolist()])[:k]
            if len(best) == k:
                bound = min(bound, 2 + 2 * best[-1][0])
        return best


def _leaves_of(batches, splits: Splits, g: np.ndarray):
    for b in batches:
        if b.num_rows:
            leaf = splits.leaf(unit(matrix(b.column("vec"))) @ g)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])


def _boxes_of(batches, splits: Splits, g: np.ndarray):
    """Boxes of the leaves as far as one task sees them: at most one row per leaf."""
    boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        if not b.num_rows:
            continue
        p = unit(matrix(b.column("vec"))) @ g
        leaf = splits.leaf(p)
        for x in np.unique(leaf).tolist():
            own = p[leaf == x]
            low, high = boxes.get(x, (own[0], own[0]))
            boxes[x] = (np.minimum(low, own.min(0)), np.maximum(high, own.max(0)))
    kind = pa.list_(pa.float64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(boxes), pa.int32()), pa.array([b[0].tolist() for b in boxes.values()], kind),
         pa.array([b[1].tolist() for b in boxes.values()], kind)], ["leaf", "low", "high"],
    )


def _blocks_of(batches, dim: int):
    """Cut rows sorted by leaf into blocks: ``leaf, ids, vecs, bounds``."""
    leaf, rows, out = None, [], []

    def flush():
        ids, vecs, bounds = zip(*rows, strict=True)
        return leaf, np.array(ids, np.int64).tobytes(), np.array(vecs).tobytes(), np.array(bounds).tobytes()

    def batch():
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["leaf", "ids", "vecs", "bounds"])

    for b in batches:
        for x, i, v, d in zip(*(b.column(c).to_pylist() for c in ("leaf", "id", "vec", "bound")), strict=True):
            if rows and (x != leaf or len(rows) >= block_rows(dim)):
                out.append(flush())
                rows = []
            leaf = x
            rows.append((i, v, d))
        if len(out) >= 32:
            yield batch()
            out = []
    if rows:
        out.append(flush())
    if out:
        yield batch()


def _visits_of(batches, g, leaves, low, high, quantile: float):
    """Leaves other than the own one that a query has to search."""
    for b in batches:
        out = []
        for i, v, home, bound in zip(*(b.column(c).to_pylist() for c in ("id", "vec", "home", "bound")), strict=True):
            q = np.array(v)
            gaps = _gap(q / np.sqrt((q * q).sum()) @ g, low, high)
            out += [(x, i, v, bound) for x in leaves[gaps <= quantile * bound].tolist() if x != home]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["leaf", "id", "vec", "bound"]
        )


def _search_of(batches, dim: int, g, k: int, quantile: float):
    for x in batches:
        for ids, vecs, qids, qvecs, bounds in zip(
            *(x.column(c).to_pylist() for c in ("ids", "vecs", "qids", "qvecs", "qbounds")), strict=True
        ):
            block = Block(np.frombuffer(ids, np.int64), np.frombuffer(vecs).reshape(-1, dim), g)
            q, n, s = [], [], []
            queries = zip(np.frombuffer(qids, np.int64).tolist(), np.frombuffer(qvecs).reshape(-1, dim),
                          np.frombuffer(bounds).tolist(), strict=True)
            for own, vec, bound in queries:
                for cosine, other in block.search(own, vec, g, k, bound, quantile):
                    q.append(own), n.append(other), s.append(-cosine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"]
            )


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    order = ["leaf", "id"]
    dealt = rows.select("leaf", "id", "vec", "bound").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda it: _blocks_of(it, dim), "leaf int, ids binary, vecs binary, bounds binary")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _search(queries: DataFrame, blocks: DataFrame, dim: int, g: np.ndarray, k: int, quantile: float) -> DataFrame:
    asked = _blocks(queries, dim).select("leaf", *[F.col(c).alias(f"q{c}") for c in ("ids", "vecs", "bounds")])
    both = asked.join(blocks.select("leaf", "ids", "vecs"), "leaf").select("ids", "vecs", "qids", "qvecs", "qbounds")
    return both.mapInArrow(lambda it: _search_of(it, dim, g, k, quantile), "query_id long, vec_id long, score double")


def nearest(
    df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, m: int = 8,
    confidence: float = 0.99, seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` nearest other vectors found, by cosine, ties to the smaller id.

    ``is_query`` is a condition on the id (named ``id``) that picks the queries; every valid row is a candidate of every query but itself. Invalid
    vectors (null, zero, with null, NaN or infinite components) and null ids take no part. Vectors of unequal length are never compared. Of equal
    vectors only the ``k + 1`` smallest ids can be among a query's nearest, so only those are indexed. Rows that agree in id
    and vector count once. Where fewer than ``k`` candidates exist, all are returned; an empty table gives an empty result.
    """
    quantile = chi_square_quantile(confidence, m)
    rows = settle(valid_rows(df, vec_id, vector).where("id is not null").withColumn("id", F.col("id").cast("long")))
    copies = W.partitionBy("vec").orderBy("id")
    found: DataFrame | None = None
    dims = [r[0] for r in rows.select("dim").distinct().orderBy("dim").collect()]
    for dim in dims or [1]:
        g = directions(dim, m, seed)
        own = rows.where(F.col("dim") == dim)
        points = own.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "vec")
        points = settle(points)
        sample = points.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vec").collect()
        n = points.count()
        depth = max(0, min(int(math.log2(MOST_LEAVES)), math.ceil(math.log2(max(1, n / LEAF_ROWS)))))
        splits = Splits(unit(np.array([r[0] for r in sample])) @ g if sample else np.zeros((0, m)), depth)
        kind = "id long, vec array<double>, leaf int"
        placed = points.mapInArrow(lambda it, s=splits, g=g: _leaves_of(it, s, g), kind).withColumn("bound", F.lit(0.0))
        blocks = settle(_blocks(placed, dim))
        boxes = points.mapInArrow(
            lambda it, s=splits, g=g: _boxes_of(it, s, g), "leaf int, low array<double>, high array<double>"
        )
        # at most MOST_LEAVES rows reach the driver
        boxes = boxes.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("at", "side")).groupBy("leaf", "at").agg(
            F.min("side.low").alias("low"), F.max("side.high").alias("high")
        ).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("sides")).collect()
        leaves = np.array([b["leaf"] for b in boxes], np.int64)
        low, high = (np.array([[s[x] for s in b["sides"]] for b in boxes]).reshape(len(boxes), -1) for x in ("low", "high"))

        asked = own.where(is_query).select("id", "vec").mapInArrow(lambda it, s=splits, g=g: _leaves_of(it, s, g), kind)
        asked = settle(asked)
        # squared distances of unit vectors are at most 4, so this bound holds nothing back
        first = settle(_best(_search(asked.withColumn("bound", F.lit(4.0)), blocks, dim, g, k, quantile), k))
        reached = first.where(F.col("rank") == k).select(
            F.col("query_id").alias("id"), F.greatest(2 - 2 * F.col("score"), F.lit(0.0)).alias("bound")
        )
        # without k neighbours yet the bound is infinite: every leaf is searched
        known = asked.join(reached, "id", "left").select(
            "id", "vec", F.col("leaf").alias("home"), F.coalesce("bound", F.lit(float("inf"))).alias("bound")
        )
        visits = known.mapInArrow(
            lambda it, g=g, a=leaves, b=low, c=high: _visits_of(it, g, a, b, c, quantile),
            "leaf int, id long, vec array<double>, bound double",
        )
        more = _search(visits, blocks, dim, g, k, quantile)
        best = _best(first.drop("rank").unionByName(more).distinct(), k)
        found = best if found is None else found.unionByName(best)
    return found.select("query_id", "rank", "vec_id", "score")
