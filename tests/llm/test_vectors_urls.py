"""Embedding links, nearest neighbours, shards, mixing and url verdicts against brute force."""

from os.path import dirname

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm import common, embedding_dedup, mixing, nearest, sharding, url_filter


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = []
    for i in range(400):
        c = centres[i % 30] if i % 3 else rng.normal(size=16)
        rows.append((i, [float(x) for x in c + rng.normal(size=16) * 0.08], None if i % 41 == 0 else i % 4))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1), (404, rows[7][1], rows[7][2])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embedding_dedup(spark):
    _, frame = vectors(spark)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    ok = [r for r in rows if usable(r[1]) and r[2] is not None]
    unit = np.array([np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for r in ok])
    label = np.array([r[2] for r in ok])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = {r[0]: (0, r[0]) for r in rows}
    for i, r in enumerate(ok):
        reach, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        want[r[0]] = (int(near[i].sum()), min(ok[j][0] for j in reach))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got == want and any(n for n, _ in want.values())


def test_extreme_vectors(spark):
    """Vectors whose squares leave the range of doubles are neither zero nor infinite."""
    rows = [(0, [1e200, 1.0], 1), (1, [1e200, 1.0], 1), (50, [1e-200, 0.0], 1), (51, [1e-200, 0.0], 1), (52, [5e-324, 0.0], 1), (53, [0.0, 1.7e308], 1), (54, [0.0, 2.0], 1),
            (55, [0.0, 0.0], 1), (56, [float("inf"), 1.0], 1), (57, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame).collect()}
    x = {i: (4, 0) for i in (0, 1, 50, 51, 52)}
    assert got == x | {53: (1, 53), 54: (1, 53), 55: (0, 55), 56: (0, 56), 57: (0, 57)}
    frame = frame.where("vec_id <> 57")
    near = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest.nearest(frame, F.col("id") % 50 == 0).collect()}
    assert [near[0, k][0] for k in (1, 2, 3, 4)] == [1, 50, 51, 52] and all(abs(near[0, k][1] - 1) < 1e-15 for k in (1, 2, 3, 4))
    assert near[50, 5][0] == 53 and (0, 7) not in near


def test_nearest_recall(spark):
    _, frame = vectors(spark)
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect() if usable(r["embedding"])]
    unit = np.array([np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v in rows])
    want = set()
    for i, (q, _) in enumerate(rows):
        if q % 50 == 0:
            s = unit @ unit[i]
            order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-s[j], rows[j][0]))[:5]
            want |= {(q, rows[j][0]) for j in order}
    out = nearest.nearest(frame.select("vec_id", "embedding"), F.col("id") % 50 == 0).collect()
    assert len(out) == len(want) and len(want & {(r["query_id"], r["vec_id"]) for r in out}) >= 0.9 * len(want)


def test_shards(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", F.lit(0).alias("slot_"))
    docs = docs.unionByName(docs.limit(50))
    rows = sharding.assign_shards(docs, 24).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert len(rows) == docs.count() and set(by) == set(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_mix(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "source", common.word_count(F.col("text")).alias("size"))
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    names = sorted({r["source"] for r in rows})
    sizes = {s: sum(r["size"] for r in rows if r["source"] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, 1.5 * total
    while True:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: share * weight[s] for s in open_}
    largest = max(r["size"] for r in rows)
    for s in names:
        took = sum(r["size"] * r["copies"] for r in rows if r["source"] == s)
        assert abs(took - target[s]) <= largest and all(abs(r["target"] - target[s]) < 1e-6 * total for r in rows if r["source"] == s)
    assert max(r["copies"] for r in rows) <= 2
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_names_and_full_sources(spark):
    """Columns of any name stay, and a source at its cap takes nothing more, empty documents included."""
    rows = [(i, "abc"[i % 3], 0 if i % 7 == 0 else 10 + i % 5, i, "x", i, i, i, i) for i in range(90)] + [(90 + i, "d", 0 if i < 3 else 2, 1, "y", 1, 1, 1, 1) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, h long, sid string, base long, target long, copies long, _ordinal long")
    out = mixing.mix(docs, most=1.2)
    assert out.columns == [*docs.columns, "source_size", "target_", "copies_"] and out.select(*docs.columns).exceptAll(docs).count() == 0
    assert max(r["copies_"] for r in mixing.mix(docs).collect()) <= 2
    small = spark.createDataFrame([("a", 5), ("a", 0), ("a", 0), ("b", 1000)], "source string, size long")
    got = mixing.mix(small.withColumn("n", F.monotonically_increasing_id()))
    assert {(r["source"], r["copies"]) for r in got.where("source = 'a'").collect()} == {("a", 2)}


def test_url_rules(spark):
    urls = [
        (1, "https://A.example.ORG/es/x?y"), (2, "http://example.org/en/1#z"), (3, "http://x.org"), (4, "ftp://sub.foo.com/fr/1"),
        (5, "http://foo.com/de/2"), (6, None), (7, "no scheme"), (8, "http://notexample.org/es/"), (9, ""), (9, ""),
    ]
    out = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == 10
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/1", "example.org/en/1", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[8][2:] == ("org/", "allow")
    assert got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and all(v[3] in ("allow", "block") for v in got.values())


def judged_sections(spark, rows):
    """Verdicts of the first segment that differs: ``rows`` of (path, label, pages)."""
    pages = [(f"http://h.net/{path}/{'page' * (k % 2)}x", label) for path, label, n in rows for k in range(n)]
    docs = spark.createDataFrame(pages, "url string, label string")
    return url_filter.judge_urls(docs, label="label").groupBy("path").agg(F.max("verdict"), F.min("verdict"), F.max("template")).collect()


def test_url_wide_node(spark):
    """A wholly blocked section among sixty even ones stays a branch of its own."""
    out = judged_sections(spark, [(f"s{chr(97 + k // 26)}{chr(97 + k % 26)}", "block" if k == 7 else "allow", 200) for k in range(60)])
    blocked = {r[0].split("/")[1] for r in out if r[1] == "block"}
    assert blocked == {"sah"} and all(r[1] == r[2] for r in out)


def test_url_deep_paths(spark):
    """Branches below the fourth segment keep their own labels."""
    out = judged_sections(spark, [(f"a/b/c/d/e/{w}", "block" if w == "bad" else "allow", 200) for w in ("good", "fine", "bad")])
    assert {r[0].split("/")[6] for r in out if r[1] == "block"} == {"bad"} and all("**" not in r[3] for r in out)
    lone = spark.createDataFrame([("http://h.net/" + "z/" * 300,), ("http://h.net/q",)], "url string")
    assert max(len(r["template"]) for r in url_filter.judge_urls(lone).collect()) == 600


def plain_templates(paths):
    """Level by level in plain Python: template of each (host, parts), from counted paths (host, parts, n, allow, block)."""
    out = {}

    def kind(parts, at):
        if at >= len(parts):
            return 0
        return 1 if parts[at] in ("<n>", "<hash>") else 2 if "<" in parts[at] else 3

    def chi(own, pool):
        n, total = sum(own), sum(pool)
        return sum((o - n * p / total) ** 2 / (n * p / total) for o, p in zip(own, pool, strict=True) if n * p)

    def walk(host, rows, at, template):
        branches = {}
        for r in rows:
            if len(r[0]) == at:
                out[host, tuple(r[0])] = template
            else:
                branches.setdefault(r[0][at], []).append(r)
        shapes = {s: [sum(r[1] for r in b if kind(r[0], at + 1) == k) for k in range(4)] for s, b in branches.items()}
        tastes = {s: [sum(r[i] for r in b) for i in (2, 3)] for s, b in branches.items()}
        pools = [[sum(c) for c in zip(*t.values(), strict=True)] for t in (shapes, tastes)]
        below = {}
        for s, b in branches.items():
            alike = chi(shapes[s], pools[0]) <= url_filter.CHI_3 and (not sum(tastes[s]) or chi(tastes[s], pools[1]) <= url_filter.CHI_1)
            below.setdefault("*" if alike and len(branches) > 1 else s, []).extend(b)
        for s, b in below.items():
            walk(host, b, at + 1, f"{template}/{s}")

    for host in {p[0] for p in paths}:
        walk(host, [p[1:] for p in paths if p[0] == host], 0, "")
    return out


def test_url_templates_against_plain_walk(spark, sf):
    """Templates of random trees, of paths with 500 shared segments, of paths that are starts of others, and of the given pages."""
    from random import Random

    r = Random(11)
    words = ["a", "b", "c", "<n>", "p<n>", "<hash>"]
    rows = {("r.net", tuple(r.choices(words, k=r.randint(0, 5)))) for _ in range(300)}
    rows |= {("deep.net", ("d",) * n + (w,)) for n, w in ((500, "x"), (500, "y"), (499, "z"))} | {("deep.net", ("d",) * 250), ("one.net", ())}
    counted = [(h, list(p), r.randint(1, 9), r.randint(0, 6), r.randint(0, 6) * (p[:1] == ("a",))) for h, p in sorted(rows)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    given = pages.groupBy("h", url_filter.typed_segments(F.col("p")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    counted += [("given " + g["h"], g["s"], g["n"], i % 3, i % 2) for i, g in enumerate(sorted(given, key=lambda g: (g["h"], g["s"])))]
    found = url_filter.templates(spark.createDataFrame(counted, "host string, parts array<string>, n long, allow long, block long")).collect()
    assert {(f["host"], tuple(f["parts"])): f["template"] for f in found} == plain_templates(counted) and len(found) == len(counted)


def test_url_labels_held_out(spark, sf):
    """With a fifth of the labelled urls hidden, their templates tell more of the labels that the rules gave them than one verdict for all would."""
    pages = spark.read.parquet(f"{dirname(sf)}/sf0.1/pages.parquet").select("page_id", "url")
    ruled = url_filter.judge_urls(pages).where("rule is not null").select("page_id", "url", F.col("verdict").alias("truth"))
    hidden = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0
    marked = ruled.withColumn("label", F.when(~hidden, F.col("truth")))
    got = url_filter.judge_urls(marked, rules=(), label="label").where("label is null").select("truth", "verdict").collect()
    right, allowed = sum(g["truth"] == g["verdict"] for g in got), sum(g["truth"] == "allow" for g in got)
    assert len(got) > 150 and right >= 0.8 * len(got) > 1.1 * max(allowed, len(got) - allowed)
    assert sum(g["truth"] == "allow" and g["verdict"] == "block" for g in got) <= 0.08 * allowed
