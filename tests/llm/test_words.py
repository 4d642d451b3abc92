"""Spelling variants and importance resampling against brute force, toxicity by held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import common, queries, resampling, toxicity, variants

ODD = [
    (1, None, "x"), (2, "", "x"), (3, "word " * 70_000 + "a" * 5_000 + " tail", "x"), (4, "Ça ÇA ça élève éleve elève eleves", "y"),
    (4, "Ça ÇA ça élève éleve elève eleves", "y"), (None, "no key at all " * 3, "z"), (7, "\t\n..", None),
]
SCHEMA = "doc_id long, text string, n string"


def brute_words(rows):
    total = Counter()
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            total[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute_near(words):
    """Near words by deleting letters: words are near if they share a form with one letter less, at fitting places."""
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (head, tail), group in by.items():
        if head + tail in near:
            for w in group:
                near[w].add(head + tail)
                near[head + tail].add(w)
        for w in group:
            near[w] |= group - {w}
    return near


def test_variants(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()]
    words = brute_words(rows)
    near = brute_near(words)
    want = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        want[w] = best if best is not None and words[best] >= 5 * n else None
    got = {r["word"]: r for r in queries.op12_variants(spark, sf).collect()}
    assert set(got) == set(words) and len(words) > 1000
    for w, r in got.items():
        root = w
        while want[root] is not None:
            root = want[root]
        form_n = words[want[w]] if want[w] else None
        assert (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) == (words[w], len(near[w]), want[w], form_n, root)
    assert sum(r["form"] is not None for r in got.values()) > 20


def test_variants_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = {r["word"]: r["n"] for r in variants.variants(docs).collect()}
    assert got == {}
    got = {r["word"]: r["n"] for r in variants.word_counts(docs, least_length=2, least_count=1).collect()}
    assert got["word"] == 70_000 and got["a" * 5_000] == 1 and got["élève"] == 2 and got["Ça"] == 4 and got["ça"] == 2
    assert variants.variants(docs.limit(0)).count() == 0
    some = spark.createDataFrame([("letter", 100), ("leter", 20), ("lettre", 19), ("léter", 4)], "word string, n long")
    found = {r["word"]: (r["form"], r["root"]) for r in variants.rooted(variants.forms(some)).collect()}
    assert found == {"letter": (None, "letter"), "leter": ("letter", "letter"), "lettre": (None, "lettre"), "léter": ("leter", "letter")}


def test_near_pairs_blocks():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcé"), rng.integers(6, 9))) for _ in range(600)})
    near = brute_near(words)
    by = {n: [w for w in words if len(w) == n] for n in (6, 7, 8)}
    got = set()
    for left, right in ((by[6], by[6]), (by[7], by[7]), (by[8], by[8]), (by[6], by[7]), (by[7], by[8])):
        i, j = variants.near_pairs(left, right)
        got |= {(left[a], right[b]) for a, b in zip(i, j, strict=True)} | {(right[b], left[a]) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a in near for b in near[a]}


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [" ".join(p) for p in zip(words, words[1:], strict=False)]


def brute_resampling(docs, target):
    s, t = Counter(), Counter()
    for count, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            count.update(zlib.crc32(f.encode()) % 10_000 for f in features(x)[1])
    total, goal = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (goal + 10_000)))) for b in range(10_000)]
    out = []
    for doc, x in docs:
        n, found = features(x)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(order[: 25 * len(order) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()]
    want = brute_resampling(docs, [r["text"] for r in common.table(spark, sf, "benchmark").collect()])
    got = sorted((tuple(r) for r in queries.op13_resampling(spark, sf).collect()), key=str)
    assert got == want and sum(r[4] is not None for r in want) > 20


def test_resampling_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    target = spark.createDataFrame([("tail word word",), (None,)], "text string")
    gain = resampling.gains(docs, target)
    rows = resampling.drawn(resampling.weighed(docs, gain), percent=100, least_words=5)
    want = {r[:4] for r in brute_resampling([r[:2] for r in ODD], ["tail word word", None])}
    assert {(r["doc_id"], r["n_features"], r["weight"], r["score_"]) for r in rows.collect()} == want
    assert sorted(r["rank"] for r in rows.collect() if r["rank"]) == [1, 2, 3, 4] and rows.count() == 7
    assert resampling.resample(docs, target).columns == docs.columns
    assert resampling.drawn(resampling.weighed(docs.limit(0), gain)).count() == 0
    assert len(set(resampling.gains(docs.limit(0), target.limit(0)))) == 1


@pytest.mark.parametrize("sizes", [(1, 2, 64, 65, 128, 129, 1000), (300_000,)])
def test_crc_of_spans(sizes):
    data = np.random.default_rng(1).integers(0, 256, sum(sizes) + 10, dtype=np.uint8)
    ends = np.cumsum(sizes) + 5
    starts = ends - np.array(sizes)
    got = resampling.crc32_spans(data, starts, ends).tolist()
    assert got == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_word_pieces(monkeypatch):
    text = "Some Words é1 " * 50 + "x" * 400 + " ... end"
    whole = [n for n, _ in resampling.features_of(text, 3, 97)], np.sort(np.concatenate([x for _, x in resampling.features_of(text, 3, 97)]))
    ids = np.concatenate(list(toxicity.pieces(text)))
    score = toxicity.Net.start().score(text)
    monkeypatch.setattr(resampling, "_PIECE", 37)
    monkeypatch.setattr(toxicity, "_PIECE", 37)
    monkeypatch.setattr(toxicity, "_ROWS", 5)
    parts = list(resampling.features_of(text, 3, 97))
    assert len(parts) > 9 and sum(n for n, _ in parts) == sum(whole[0])
    assert np.array_equal(np.sort(np.concatenate([x for _, x in parts])), whole[1])
    assert np.array_equal(np.concatenate(list(toxicity.pieces(text))), ids)
    assert abs(toxicity.Net.start().score(text) - score) < 1e-6


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op11_toxicity(spark, sf).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for d, r in rows.items())
    held = [(rows[d]["score"], y) for d, y in truth.items() if d in rows and rows[d]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    area = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert len(good) >= 5 and area > 0.85


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r[:2], "en", r[2]) for r in ODD], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(3, 0), (4, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    known = toxicity.votes(labels)
    net = toxicity.fit(docs, known)
    rows = toxicity.scored(docs, net)
    assert rows.count() == 7 and rows.columns == [*docs.columns, "score_"]
    assert all(0 <= r["score_"] <= 1 for r in rows.collect())
    cuts = toxicity.calibrate(rows.join(known, rows["doc_id"] == known["_id"]), score="score_")
    assert toxicity.flagged(rows, cuts, score="score_").where("flagged is null").count() == 0
    empty = toxicity.fit(docs.limit(0), toxicity.votes(labels.limit(0)))
    assert toxicity.scored(docs.limit(0), empty).count() == 0
    none = toxicity.calibrate(rows.join(known, rows["doc_id"] == known["_id"]).limit(0), score="score_")
    assert {r["threshold"] for r in toxicity.flagged(rows, none, score="score_").collect()} == {0.5}
