"""Suffix-array, de Bruijn and SimHash de-duplication against brute force on small texts."""

import hashlib
import itertools
import random
import re

import pyarrow as pa
import pytest
import xxhash

from tracewright.llm import debruijn, simhash, suffix_dedup, windows
from tracewright.llm.common import settle, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdeéü", k=rng.randint(1, 6))) for _ in range(300)]

    def words(n):
        return " ".join(rng.choices(vocab, k=n))

    shared = [words(n) for n in (60, 90, 200, 55)]
    out = [None, "", " \t\n ", "one", "a " * 700, "x" * 1500]
    for i in range(30):
        parts = [words(rng.randint(5, 120)), *rng.sample(shared, rng.randint(0, 2)), words(rng.randint(0, 60))]
        out.append((" " if i % 3 else "\n").join(parts))
    out += [out[10], out[10], out[11], out[12] + " tail"]
    return out


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\x01" * length
        kept = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        spans = sum(1 for i in range(len(b)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(b), sum(hit), spans, kept))
    return out


@pytest.mark.parametrize("length", [400, 64, 20])
def test_suffix_array_brute_force(spark, texts, length):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix_dedup.repeated_bytes(docs, length=length)
    rows = windows.attach(docs, found, "text").collect()
    want = brute_bytes(texts, length)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("length", [50, 12])
def test_de_bruijn_brute_force(spark, texts, length):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in debruijn.remove_later(docs, length=length).collect()}
    first, words = {}, [WORD.findall((t or "").encode()) for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    for d, w in enumerate(words):
        hit = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                hit[i : i + length] = [True] * length
        want = None if texts[d] is None else b" ".join(x for x, h in zip(w, hit, strict=True) if not h).decode()
        assert rows[d] == want, d


def brute_first(rows, length):
    """Words removed and text kept of each (id, text); null ids come last and are one."""
    rank = [float("inf") if i is None else i for i, _ in rows]
    first, words = {}, [WORD.findall(t.encode()) for _, t in rows]
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            gram = tuple(w[i : i + length])
            first[gram] = min(first.get(gram, rank[d]), rank[d])
    out = []
    for d, w in enumerate(words):
        hit = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < rank[d]:
                hit[i : i + length] = [True] * length
        out.append((sum(hit), b" ".join(x for x, h in zip(w, hit, strict=True) if not h)))
    return out


@pytest.mark.parametrize("part", [50, 57, 65, 90])
def test_de_bruijn_every_copy_of_a_passage(spark, part):
    """A passage that stands several times at one rank, of which a smaller document holds a part only."""
    rng = random.Random(part)

    def words(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    inner, other = words(part), words(part)
    passage, nulls = f"{words(80)} {inner} {words(80)}", f"{words(80)} {other} {words(80)}"
    rows = [(3, f"{words(9)} {inner} {words(9)}"), (5, " ".join(f"{words(7)} {passage}" for _ in range(4))), (2, f"{words(4)} {other}")]
    rows += [(None, f"{words(6)} {nulls} {words(5)}") for _ in range(3)]
    rows += [(9, f"{words(5)} {passage} {words(3)}"), (8, f"{words(2)} {passage} {words(3)}"), (8, f"{words(5)} {passage}")]
    docs = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "no long, doc_id long, text string")
    found = debruijn.attach_first(docs, debruijn.first_occurrences(docs)).collect()
    got = {r["no"]: (r["n_removed"], bytes(r["kept"])) for r in found}
    assert [got[k] for k in range(len(rows))] == brute_first(rows, 50)


def brute_fingerprint(text):
    w = [x.lower() for x in WORD.findall((text or "").encode())]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_simhash_brute_force(spark, texts):
    near = [t.replace(t.split()[3], "new", 1) for t in texts[6:20] if t]
    given = texts + near
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    fps = [brute_fingerprint(t) for t in given]
    links = [(a, b) for a, b in itertools.combinations(range(len(given)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = roots_of(len(given), links)
    for r in simhash.near_duplicates(docs).collect():
        assert r["fingerprint"] % (1 << 64) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]


def test_fingerprint_links_brute_force(spark):
    """Many prints around few centres: the same components as all pairs, for both ways of dealing."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(8)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for c in centres for _ in range(60)})
    frame = settle(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"))
    for radius, blocks, shard in ((3, 4, 5), (7, 9, 2048), (3, 6, 7)):
        pairs = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= radius]
        at = {f: i for i, f in enumerate(fps)}
        got = [(at[r["a"] % (1 << 64)], at[r["b"] % (1 << 64)]) for r in simhash.fingerprint_links(frame, radius, blocks, shard).collect()]
        assert set(map(tuple, map(sorted, got))) <= set(pairs)
        assert roots_of(len(fps), got) == roots_of(len(fps), pairs)


def test_keep_one(spark):
    rng = random.Random(5)
    base = [rng.choices([f"w{i}" for i in range(5000)], k=400) for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join([*w[:200], "changed", *w[201:]])) for i, w in enumerate(base)]
    rows += [(200, " ".join(base[0])), (0, " ".join(base[0])), (None, " ".join(base[1])), (300, None), (301, ""), (302, "a b")]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fp string")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(12), 300, 302]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def brute_keep(given):
    """Ids that stay: the smallest of each component of pairs of similarity 0.8 or more."""
    sets = []
    for t in given:
        w = [x.lower() for x in WORD.findall((t or "").encode())]
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(a, b) for a, b in itertools.combinations(range(len(given)), 2)]
    links = [(a, b) for a, b in pairs if not (sets[a] | sets[b]) or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    return sorted(set(roots_of(len(given), links))), links


def kept_by(spark, given):
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())


def words_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_keep_one_all_pairs(spark):
    """Families of changed copies around the threshold, short and long: far fingerprints and bridges included."""
    rng, given = random.Random(11), []
    for n in (8, 12, 20, 40, 80, 200, 600):
        for _ in range(12):
            base = words_of(rng, n)
            given.append(" ".join(base))
            for changes in range(1, 4):
                copy = list(base)
                cut = rng.randint(1, max(1, n // 8))
                copy[-cut:] = words_of(rng, rng.randint(0, cut + 1))
                for _ in range(changes - 1):
                    copy[rng.randrange(len(copy))] = "new"
                given.append(" ".join(copy))
    want, links = brute_keep(given)
    fps = [brute_fingerprint(t) for t in given]
    assert any((fps[a] ^ fps[b]).bit_count() > 7 for a, b in links)
    assert kept_by(spark, given) == want


def test_keep_one_equal_fingerprints(spark):
    """A frequent line decides every bit of texts that share nothing else."""
    rng = random.Random(12)
    given = ["one two three " * 900 + " ".join(words_of(rng, 60)) for _ in range(4)]
    given += [given[1] + " tail"]
    assert len({brute_fingerprint(t) for t in given}) == 1
    assert kept_by(spark, given) == brute_keep(given)[0] == [0, 1, 2, 3]


def test_keep_one_bridged(spark):
    """Texts of one frequent line are near each other in bits; only pairs among them are similar."""
    rng, given = random.Random(15), []
    for _ in range(20):
        tail = words_of(rng, 60)
        given += ["one two three " * 12 + " ".join(tail), "one two three " * 12 + " ".join([*tail[:-1], "end"])]
    fps = [brute_fingerprint(t) for t in given]
    assert len(set(fps)) > 20 and sum((a ^ b).bit_count() <= 7 for a, b in itertools.combinations(fps, 2)) > 200
    want, _ = brute_keep(given)
    assert len(want) == 20 and kept_by(spark, given) == want


def test_keep_one_exact_at_the_threshold(spark):
    """Texts of a thousand words just above and just below the similarity."""
    rng, given = random.Random(13), []
    for k in range(40):
        base, cut = words_of(rng, 1000), 109 if k % 2 else 113
        given += [" ".join(base), " ".join([*base[:-cut], *words_of(rng, cut)])]
    want, links = brute_keep(given)
    assert len(links) == 20 and kept_by(spark, given) == want


def test_similar_links_across_blocks(spark, monkeypatch):
    rng, given = random.Random(14), []
    common = words_of(rng, 60)
    for k in range(30):
        base = [*common, *words_of(rng, 20 if k % 3 else 4)]
        given += [" ".join(base), " ".join([*base[:-1], "x"])]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert kept_by(spark, given) == brute_keep(given)[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert debruijn.remove_later(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def test_kept_bytes_stay_characters(spark):
    text = "é" * 500
    rows = [(0, "ab" + text), (1, text + "cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert "�" not in "".join(out.values())
    assert hashlib.sha256(out[1].encode()).hexdigest() and out[1].endswith("cd")


def test_remove_later_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 0, True, "a", 1), (2, text, 0, True, "b", 2), (3, "short " + text, 0, False, "c", 3), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_units long, later boolean, `_ord` string, `_kept` long")
    out = {r["doc_id"]: tuple(r) for r in debruijn.remove_later(docs).collect()}
    assert out == {1: rows[0], 2: (2, "", *rows[1][2:]), 3: (3, "short", *rows[2][2:]), None: rows[3]}


@pytest.mark.parametrize("rows", [1, 2, 3, 50])
def test_shared_grams_in_batches_of_any_size(rows):
    rng = random.Random(rows)
    grams = sorted(rng.choices(range(40), k=30) + [7] * 12 + [99])
    table = pa.table({"key": [b"k"] * len(grams), "gram": grams, "a": list(range(len(grams))), "lo": grams, "n": grams})
    got = [a for b in windows._shared_of(iter(table.to_batches(rows))) for a in b.column("a").to_pylist()]
    inner = [i for i, g in enumerate(grams) if grams.count(g) > 1]
    assert got == sorted({0, len(grams) - 1, *inner})


def test_shared_grams_keeps_every_occurrence_of_a_frequent_gram(spark):
    rows = [(f"{i:05d}".encode(), 5 if i % 3 == 0 else 1000 + i // 2, i, i, 1) for i in range(3000)]
    runs = spark.createDataFrame(rows, "key binary, gram long, a long, lo long, n long")
    counts = runs.groupBy("gram").count().where("count > 1")
    want = {r.a for r in runs.join(counts, "gram").collect()}
    kept = [r.a for r in windows.shared_grams(runs).collect()]
    assert len(kept) == len(set(kept)) and want <= set(kept)
    assert len(set(kept) - want) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert windows.shared_grams(runs.limit(0)).count() == 0


def test_tables_of_past_rounds_go(spark, texts):
    """After the last round only the texts and what each round found are on disk."""
    before, plan = written(), suffix_dedup.plan_of(40)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = windows.repeated_windows(windows.distinct_texts(docs, "text", None), plan, smaller=False, sources=False)
    assert marks.columns == ["key", "lo", "n"] and marks.count() > 0
    assert len(written() - before) == 1 + len(plan.cells)
