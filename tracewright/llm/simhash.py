"""SimHash fingerprints of word shingles, and near duplicates by BK-trees.

Fingerprints within ``radius`` bits agree in at least one of ``blocks`` bit blocks, so the distinct fingerprints are dealt by (block, value)
and cut into shards of bounded size. Each shard is a BK-tree: a child hangs at its Hamming distance to its parent, and a search follows
only edges within the radius of the distance found. Trees are shipped to the other shards of their block value only; a batch of queries
walks a tree together. Links are reduced to a spanning forest where they are found, so a group of near copies of any size yields
links in proportion to its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from tracewright.llm.common import col, fresh, settle
from tracewright.llm.components import components

SHARD = 2048


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, 42)  # of a single shingle every bit that is set is set in over half
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(parts) - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    set_, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65_536):
        pairs = zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)
        h = np.fromiter((digest(joined[s:e], 42) for s, e in pairs), np.uint64)
        set_ += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in text], np.uint64).view(np.int64))


class BKTree:
    """Nodes of one shard; children by integer distance to their parent."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in range(values.size)]
        stack = [np.arange(values.size)] if values.size else []
        while stack:
            members = stack.pop()
            root, rest = members[0], members[1:]
            if rest.size:
                d = np.bitwise_count(values[rest] ^ values[root])
                order = np.argsort(d, kind="stable")
                rest, d = rest[order], d[order]
                cuts = np.flatnonzero(np.diff(d)) + 1
                for part, far in zip(np.split(rest, cuts), d[np.concatenate([[0], cuts])].tolist(), strict=True):
                    self.children[root].append((far, int(part[0])))
                    stack.append(part)

    def search(self, queries: np.ndarray, radius: int):
        """Yield (node, indices of the queries within the radius), one node at a time."""
        stack = [(0, np.arange(queries.size))] if self.values.size else []
        while stack:
            node, active = stack.pop()
            d = np.bitwise_count(queries[active] ^ self.values[node]).astype(np.int16)
            hit = active[d <= radius]
            if hit.size:
                yield node, hit
            for far, child in self.children[node]:
                on = active[np.abs(d - far) <= radius]
                if on.size:
                    stack.append((child, on))


def _join(roots: np.ndarray, node: int, others: np.ndarray, links: list[tuple[int, int]]) -> None:
    """Merge the groups of ``others`` into that of ``node``, by one direct link each; ``roots`` holds the group of each member, kept flat."""
    mine = roots[node]
    found, at = np.unique(roots[others], return_index=True)
    for r, i in zip(found.tolist(), at.tolist(), strict=True):
        if r != mine:
            links.append((node, int(others[i])))
            roots[roots == r] = mine


def _shards_of(batches, radius: int, shard: int):
    """Cut rows sorted by key into shards; each is searched against itself."""

    def flush(key, values):
        fps = np.array(values, np.int64)
        roots, links = np.arange(fps.size, dtype=np.int32), []
        if fps.size > 1:
            u = fps.view(np.uint64)
            for node, hit in BKTree(u).search(u, radius):
                if hit.size > 1:
                    _join(roots, node, hit, links)
        return key, values[0], fps.tobytes(), roots.tobytes(), np.array(links, np.int32).tobytes()

    key, values, out = None, [], []
    for b in batches:
        for k, fp in zip(b.column("key").to_pylist(), b.column("fp").to_pylist(), strict=True):
            if values and (k != key or len(values) == shard):
                out.append(flush(key, values))
                values = []
            key = k
            values.append(fp)
        if len(out) > 1000:
            yield _rows(out)
            out = []
    if values:
        out.append(flush(key, values))
    if out:
        yield _rows(out)


_SHARD = "key long, first long, fps binary, roots binary, links binary"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "first", "fps", "roots", "links"])


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _inside(batches):
    for x in batches:
        a, b = [], []
        for fps, links in zip(x.column("fps").to_pylist(), x.column("links").to_pylist(), strict=True):
            if links:
                f, at = np.frombuffer(fps, np.int64), np.frombuffer(links, np.int32)
                a += f[at[::2]].tolist()
                b += f[at[1::2]].tolist()
        yield _pairs(a, b)


def _across(batches, radius: int):
    for x in batches:
        a, b = [], []
        for f1, r1, f2, r2 in zip(*(x.column(c).to_pylist() for c in ("fps", "roots", "fps2", "roots2")), strict=True):
            left, right = np.frombuffer(f1, np.uint64), np.frombuffer(f2, np.uint64)
            roots = np.concatenate([np.frombuffer(r1, np.int32), np.frombuffer(r2, np.int32) + np.int32(left.size)])
            links: list[tuple[int, int]] = []
            for node, hit in BKTree(left).search(right, radius):
                _join(roots, node, hit + left.size, links)
            both = np.concatenate([left, right]).view(np.int64)
            a += both[[i for i, _ in links]].tolist()
            b += both[[j for _, j in links]].tolist()
        yield _pairs(a, b)


def fingerprint_links(fps: DataFrame, radius: int = 3, blocks: int = 4, shard: int = SHARD) -> DataFrame:
    """A spanning set of links ``(a, b)`` between the distinct fingerprints ``fps(fp)`` at ``radius`` bits or fewer.

    ``blocks`` must exceed ``radius``; more blocks than ``radius + 1`` deal by tuples of blocks and make smaller shards.
    """
    from itertools import combinations

    if blocks <= radius:
        raise ValueError("blocks must exceed the radius")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for no, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        parts = [
            F.shiftrightunsigned("fp", cuts[c]).bitwiseAND(F.lit((1 << (cuts[c + 1] - cuts[c])) - 1)) for c in chosen
        ]
        # one block is its own key; a tuple is hashed, and a clash only puts strangers into one shard
        keys.append(F.lit(no << 56).cast("long") + (parts[0] if len(parts) == 1 else F.xxhash64(*parts).bitwiseAND(F.lit((1 << 56) - 1))))
    keyed = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    dealt = keyed.repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    shards = settle(dealt.mapInArrow(lambda it: _shards_of(it, radius, shard), _SHARD))
    inside = shards.select("fps", "links").mapInArrow(_inside, "a long, b long")
    other = shards.select("key", F.col("first").alias("first2"), F.col("fps").alias("fps2"), F.col("roots").alias("roots2"))
    across = shards.join(other, "key").where("first < first2").select("fps", "roots", "fps2", "roots2")
    return inside.unionByName(across.mapInArrow(lambda it: _across(it, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, blocks: int = 4) -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` (long) and ``component_id``, the smallest id it reaches by links.

    Words are runs of anything but space and the controls 9 to 13, A-Z lower-cased; shingles have three words, a shorter text is
    one shingle, a text without words (or null) has fingerprint 0 and links like any other. Equal fingerprints are linked. A null id
    takes part but is never the smallest; a component of null ids only has a null ``component_id``. Repeated rows are
    returned as often as they come; an empty table gives an empty result.
    """
    fp, component = fresh(docs, "fingerprint"), fresh(docs, "component_id")
    marked = docs.withColumn(fp, _fingerprints(col(text)))
    ids = settle(marked.select(F.col(fp).alias("fp"), col(doc_id).alias("id")).groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(fingerprint_links(ids.select("fp"), radius, blocks))
    placed = ids.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("least"))
    known = settle(placed.join(least, "root").select(F.col("fp").alias("_fp"), F.col("least").alias(component)))
    return marked.join(known, F.col(fp) == F.col("_fp")).drop("_fp")


#: minimum hashes of a set in BANDS bands of ROWS: at a similarity of 0.8 no band agrees with a probability of 5e-8
BANDS, ROWS = 32, 4
#: members and bytes of text of a block of a candidate cluster
BLOCK, BLOCK_BYTES = 256, 8 << 20
_U = np.uint64
_MULTIPLY, _ADD = np.random.default_rng(20240301).integers(1, 2**63, (2, BANDS * ROWS, 1), dtype=_U) << _U(1) | _U(1)


def shingles_of(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the set of word shingles; a shorter text is one shingle, a text without words has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    starts, ends = [0], [len(joined)]
    if len(parts) > words:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = [0, *(gaps[: len(parts) - words] + 1).tolist()], [*gaps[words - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def bands_of(shingles: np.ndarray) -> list[int]:
    """One key per band of minimum hashes; none for an empty set."""
    if not shingles.size:
        return []
    least = np.full(BANDS * ROWS, ~_U(0))
    for at in range(0, shingles.size, 2048):
        np.minimum(least, (shingles[at : at + 2048] * _MULTIPLY + _ADD).min(1), out=least)
    raw = least.tobytes()
    step = 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) - (1 << 63) for k in range(BANDS)]


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between positions of ``sets`` whose Jaccard similarity reaches ``similarity``, as many as join what all such links join."""
    n = len(sets)
    sizes = np.array([s.size for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, codes = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    group, links, mark = np.arange(n), [], np.zeros(values.size, bool)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(n - 1):
        if (group[i + 1 :] == group[i]).all():
            continue
        mine = codes[cuts[i] : cuts[i + 1]]
        mark[mine] = True
        tail = cuts[i + 1]
        shared = np.bincount(owner[tail:][mark[codes[tail:]]] - i - 1, minlength=n - i - 1)
        mark[mine] = False
        union = sizes[i] + sizes[i + 1 :] - shared
        near = np.flatnonzero(shared / np.maximum(union, 1) >= similarity) + i + 1
        _join(group, i, near, links)
    return links


@F.pandas_udf(StructType().add("digest", BinaryType()).add("bands", ArrayType(LongType())))
def _sets(text: pd.Series) -> pd.DataFrame:
    found = [shingles_of(t) for t in text]
    return pd.DataFrame({"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in found], "bands": [bands_of(s) for s in found]})


def candidate_links(sets: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Links ``(a, b)`` between the nodes of ``sets(node, fp, bands)`` that join all candidates: equal fingerprints, fingerprints within
    ``radius`` bits, and equal minimum hashes in a band, whatever the distance of the fingerprints."""
    prints = settle(sets.groupBy("fp").agg(F.min("node").alias("least")))
    same = sets.join(prints, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    ends = [prints.select(F.col("fp").alias(c), F.col("least").alias("n" + c)) for c in "ab"]
    close = fingerprint_links(prints.select("fp"), radius, blocks).join(ends[0], "a").join(ends[1], "b").select("na", "nb")
    dealt = sets.select("node", F.explode("bands").alias("band"))
    least = dealt.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("most > least")
    banded = dealt.join(least, "band").select("node", "least")
    return same.union(close).union(banded).where("a <> b").distinct()


def verified_links(texts: DataFrame, clusters: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of similar texts within each cluster; ``texts(node, t)``, ``clusters(node, root)`` with the roots themselves.

    Each text goes to its cluster once. A large cluster is dealt in blocks, and each pair of blocks is one group.
    """
    placed = settle(texts.join(clusters, "node"))
    weight = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("t")) / BLOCK_BYTES)).cast("int")
    sizes = placed.groupBy("root").agg(F.greatest(weight, F.lit(1)).alias("k"))
    block = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    others = F.expr("filter(sequence(0, k - 1), x -> x <> block or k = 1)")
    dealt = placed.join(sizes, "root").withColumn("block", block).withColumn("other", F.explode(others))
    tiles = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "t")

    def links(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        found = similar_links([shingles_of(t) for t in group.column("t").to_pylist()], similarity)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return tiles.groupBy("root", "i", "j").applyInArrow(links, "a long, b long")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 7, blocks: int = 9, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest id. Columns unchanged.

    Groups are joined by pairs whose sets of five-word shingles have the ``similarity``, decided on the whole sets. Candidates
    (see ``candidate_links``) only say which texts are compared: all texts of a cluster of candidates are, so no link depends on a bridge.
    Equal sets are copies, texts without words among them. Null ids come last; of rows with equal ids one stays; an empty table gives an
    empty result.
    """
    marked = settle(
        docs.select(F.struct(*[col(c) for c in docs.columns]).alias("doc"), col(doc_id).alias("id"), col(text).alias("t"))
        .select("doc", "id", _fingerprints("t").alias("fp"), _sets("t").alias("set"), F.monotonically_increasing_id().alias("row"))
    )
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
    one = F.min(F.struct(order.alias("o"), F.col("fp").alias("fp"), F.col("set.bands").alias("bands"))).alias("one")
    sets = settle(
        marked.groupBy(F.col("set.digest").alias("digest")).agg(one)
        .select("one.o.last", "one.o.id", F.col("one.o.row").alias("node"), "one.fp", "one.bands")
    )
    known = components(candidate_links(sets.select("node", "fp", "bands"), radius, blocks))
    clusters = settle(known.union(known.select("root", "root").distinct()))
    texts = marked.select(F.col("row").alias("node"), col("doc").getField(text).alias("t"))
    groups = components(settle(verified_links(texts, clusters, similarity)))
    placed = sets.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("group"))
    first = F.min(F.struct("last", "id", F.col("node").alias("row"))).alias("first")
    stay = settle(placed.agg(first).select(F.col("first.row").alias("row")))
    return marked.join(stay, "row", "left_semi").select("doc.*")
