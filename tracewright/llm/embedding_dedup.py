"""Near duplicates among embeddings by tiled comparison in principal-component order.

Equal vectors of a label are one class. Class vectors are scaled to length one and rotated into principal components, so the leading
dimensions carry most of each product. Vectors whose cosine reaches the threshold lie within ``sqrt(2 - 2 t)``, so a grid of that width over
the first two components leaves only neighbouring cells to compare. Cells are cut into tiles of bounded size; a pair of tiles is one
row of a Spark join. Inside a pair products are accumulated block by block of dimensions, and a pair of vectors is dropped as soon as the sum plus
the product of the suffix norms cannot reach the threshold; what is left is decided by the cosine of the original vectors. Tiles return
link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import col, settle
from tracewright.llm.components import components
from tracewright.llm.vectors import as_doubles, block_rows, in_range, is_valid, matrix, unit

#: rows of the bounded sample that the rotation is fitted on; results do not depend on it
FIT_ROWS = 5000
SLACK = 1e-9
HALF = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def principal_axes(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Orthonormal axes by falling variance, for each vector length in the sample."""
    axes, by_dim = {}, {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    for dim, rows in by_dim.items():
        u = unit(np.array(rows))
        _, vectors = np.linalg.eigh(np.cov(u, rowvar=False).reshape(dim, dim) if len(rows) > 1 else np.eye(dim))
        axes[dim] = vectors[:, ::-1]
    return axes


def _rotated(v: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    u = unit(v)
    return u @ axes[u.shape[1]] if u.shape[1] in axes else u


class Tile:
    """Rotated unit vectors with the norms of what follows each block of dimensions."""

    def __init__(self, vecs: np.ndarray, axes: dict[int, np.ndarray]) -> None:
        self.vecs, self.y = vecs, _rotated(vecs, axes)
        self.norm = np.sqrt((vecs * vecs).sum(1))
        dim, self.cuts = vecs.shape[1], [min(16, vecs.shape[1])]
        while self.cuts[-1] < dim:
            self.cuts.append(min(dim, 2 * self.cuts[-1]))
        tails = np.cumsum((self.y * self.y)[:, ::-1], 1)[:, ::-1]
        self.suffix = [np.sqrt(tails[:, c]) if c < dim else np.zeros(len(vecs)) for c in self.cuts]


def close_pairs(a: Tile, b: Tile, threshold: float, step: int = 64):
    """Yield arrays (i, j) of the pairs whose cosine reaches the threshold, for some rows of ``a`` at a time."""
    least = threshold - SLACK
    for at in range(0, len(a.y), step):
        y, c = a.y[at : at + step], a.cuts[0]
        p = y[:, :c] @ b.y[:, :c].T
        i, j = np.nonzero(p + np.outer(a.suffix[0][at : at + step], b.suffix[0]) >= least)
        p, i = p[i, j], i + at
        for k in range(1, len(a.cuts)):
            if not i.size:
                break
            lo, hi = a.cuts[k - 1], a.cuts[k]
            p = p + np.einsum("ij,ij->i", a.y[i, lo:hi], b.y[j, lo:hi])
            on = p + a.suffix[k][i] * b.suffix[k][j] >= least
            p, i, j = p[on], i[on], j[on]
        if i.size:
            on = (a.vecs[i] * b.vecs[j]).sum(1) / (a.norm[i] * b.norm[j]) >= threshold
            yield i[on], j[on]


def _merge(roots: np.ndarray, i: np.ndarray, j: np.ndarray, links: list[tuple[int, int]] | None = None) -> None:
    """Merge the groups of linked members; ``roots`` stays flat. Each round joins pairs of groups until none differs."""
    while True:
        ri, rj = roots[i], roots[j]
        differ = np.flatnonzero(ri != rj)
        if not differ.size:
            return
        a, b = int(ri[differ[0]]), int(rj[differ[0]])
        if links is not None:
            links.append((a, b))
        roots[roots == max(a, b)] = min(a, b)


def _tiles_of(batches, axes, threshold: float):
    """Cut rows sorted by cell into tiles and compare each with itself."""

    def flush(cell, keys, sizes, vecs):
        tile, n = Tile(np.array(vecs), axes), len(keys)
        size, roots, links = np.array(sizes, np.int64), np.arange(n, dtype=np.int32), np.zeros(n, np.int64)
        for i, j in close_pairs(tile, tile, threshold):
            other = i != j
            i, j = i[other], j[other]
            np.add.at(links, i, size[j])
            _merge(roots, i, j)
        return (*cell, keys[0], b"".join(keys), tile.vecs.tobytes(), size.tobytes(), roots.tobytes(), (links + size - 1).tobytes())

    cell, rows, out = None, [], []
    for b in batches:
        names = ("label", "dim", "cx", "cy", "key", "size", "vec")
        for label, dim, cx, cy, key, size, vec in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if rows and (cell != (label, dim, cx, cy) or len(rows) >= block_rows(dim)):
                out.append(flush(cell, *zip(*rows, strict=True)))
                rows = []
            cell = (label, dim, cx, cy)
            rows.append((key, size, vec))
        if len(out) >= 32:
            yield _tile_batch(out)
            out = []
    if rows:
        out.append(flush(cell, *zip(*rows, strict=True)))
    if out:
        yield _tile_batch(out)


_TILE = pa.schema(
    [("label", pa.string()), ("dim", pa.int32()), ("cx", pa.int32()), ("cy", pa.int32())]
    + [(c, pa.binary()) for c in ("first", "keys", "vecs", "sizes", "roots", "links")]
)


def _tile_batch(out: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TILE.types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_TILE)


def _cells_of(batches, axes, width: float):
    for b in batches:
        dims = np.array(b.column("dim"))
        for d in np.unique(dims):
            part = b.filter(pa.array(dims == d))
            y = _rotated(matrix(part.column("vec")), axes)
            at = np.floor(np.pad(y[:, :2], ((0, 0), (0, max(0, 2 - int(d))))) / width).astype(np.int32)
            columns = [part.column(c) for c in ("label", "dim", "key", "size", "vec")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(at[:, 0]), pa.array(at[:, 1])], ["label", "dim", "key", "size", "vec", "cx", "cy"]
            )


def _found(keys: list[bytes], others: list[bytes | None], n: list[int | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(others, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"]
    )


def _split(keys: bytes) -> list[bytes]:
    return [keys[k : k + 16] for k in range(0, len(keys), 16)]


def _inside(batches):
    """Links and link counts that tiles found in themselves."""
    for x in batches:
        a, b, n = [], [], []
        for keys, roots, links in zip(*(x.column(c).to_pylist() for c in ("keys", "roots", "links")), strict=True):
            own, counts = _split(keys), np.frombuffer(links, np.int64).tolist()
            for i, (r, c) in enumerate(zip(np.frombuffer(roots, np.int32).tolist(), counts, strict=True)):
                if r != i:
                    a.append(own[i]), b.append(own[r]), n.append(None)
                if c:
                    a.append(own[i]), b.append(None), n.append(c)
        yield _found(a, b, n)


def _across(batches, axes, threshold: float):
    """Links and link counts between two tiles."""
    names = ("dim", "keys", "vecs", "sizes", "roots", "keys2", "vecs2", "sizes2", "roots2")
    for x in batches:
        for dim, k1, v1, s1, r1, k2, v2, s2, r2 in zip(*(x.column(c).to_pylist() for c in names), strict=True):
            left, right = (Tile(np.frombuffer(v).reshape(-1, dim), axes) for v in (v1, v2))
            m = len(left.vecs)
            size = [np.frombuffer(s, np.int64) for s in (s1, s2)]
            roots = np.concatenate([np.frombuffer(r1, np.int32), np.frombuffer(r2, np.int32) + np.int32(m)])
            links, counts = [], np.zeros(roots.size, np.int64)
            for i, j in close_pairs(left, right, threshold):
                np.add.at(counts, i, size[1][j])
                np.add.at(counts, j + m, size[0][i])
                _merge(roots, i, j + m, links)
            keys = _split(k1) + _split(k2)
            some = np.flatnonzero(counts).tolist()
            yield _found(
                [keys[i] for i, _ in links] + [keys[i] for i in some],
                [keys[j] for _, j in links] + [None] * len(some),
                [None] * len(links) + counts[some].tolist(),
            )


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors link if their labels are equal and not null and their cosine in double precision reaches ``threshold`` (positive).
    Vectors of unequal length, null and zero vectors and those with null, NaN or infinite components link with nothing: no
    links, their own component. Rows that agree in id, label and vector are one vector; other vectors with the same id are
    vectors of their own. A null id takes part but names no component; where a component has no other ids it is null. ``kept``
    compares ids null-safe. An empty table gives an empty result.
    """
    name = F.when(is_valid(col(vector)), col(label).cast("string"))
    same = F.transform(as_doubles(col(vector)), lambda x: x + 0.0)
    key = F.when(name.isNotNull(), F.unhex(F.md5(F.concat_ws(",", name, same.cast("array<string>")).cast("binary"))))
    base = df.select(col(vec_id).alias("id"), name.alias("label"), same.alias("vec"), key.alias("key"), col(label).alias("_l"))
    rows = settle(base.distinct())
    classes = settle(
        rows.where("key is not null").groupBy("key").agg(
            F.first("label").alias("label"), F.first(in_range(F.col("vec"))).alias("vec"), F.count(F.lit(1)).alias("size"), F.min("id").alias("id")
        ).withColumn("dim", F.size("vec"))
    )
    sample = [r[0] for r in classes.orderBy("key").limit(FIT_ROWS).select("vec").collect()]
    axes, width = principal_axes(sample), float(np.sqrt(2 - 2 * threshold)) + SLACK
    placed = classes.select("label", "dim", "key", "size", "vec").mapInArrow(
        lambda it: _cells_of(it, axes, width),
        "label string, dim int, key binary, size long, vec array<double>, cx int, cy int",
    )
    order = ["label", "dim", "cx", "cy", "key"]
    tiles = settle(
        settle(placed).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            lambda it: _tiles_of(it, axes, threshold),
            "label string, dim int, cx int, cy int, first binary, keys binary, vecs binary, sizes binary, roots binary, links binary",
        )
    )
    found = tiles.select("keys", "roots", "links").mapInArrow(_inside, "a binary, b binary, n long")
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in HALF])
    left = tiles.withColumn("d", F.explode(steps)).select(
        "label", "dim", (F.col("cx") + F.col("d.x")).alias("cx"), (F.col("cy") + F.col("d.y")).alias("cy"),
        ((F.col("d.x") == 0) & (F.col("d.y") == 0)).alias("home"), "first", "keys", "vecs", "sizes", "roots",
    )
    right = tiles.select("label", "dim", "cx", "cy", *[F.col(c).alias(f"{c}2") for c in ("first", "keys", "vecs", "sizes", "roots")])
    both = left.join(right, ["label", "dim", "cx", "cy"]).where("not home or first < first2")
    both = both.select("dim", "keys", "vecs", "sizes", "roots", "keys2", "vecs2", "sizes2", "roots2")
    found = settle(found.unionByName(both.mapInArrow(lambda it: _across(it, axes, threshold), "a binary, b binary, n long")))
    roots = components(found.where("b is not null").select("a", "b"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    placed = classes.select("key", "id").join(roots, F.col("key") == F.col("node"), "left").select(
        "key", "id", F.coalesce("root", "key").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("id").alias("least"))
    known = settle(placed.join(least, "root").join(counts, "key", "left").select("key", "least", "n_links", F.lit(True).alias("in")))
    return rows.select("id", "key", F.col("_l").alias("label")).join(known, "key", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("in"), F.col("least")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("in"), F.col("id").eqNullSafe(F.col("least"))).otherwise(True).alias("kept"),
        "label",
    )
