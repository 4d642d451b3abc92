"""Quality classifier by held-out accuracy and by its shrinkage; BPE against the public library."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import bpe, common, quality

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "<|endoftext|>", "a<|endoftext|> b  <|endoftext", "x\x1c\x1d y\x85 z 　 w", "I'll he's 'S ’s ½²",
    "漢字 \U0001f600\U0001f469‍\U0001f469", "a" * 5000, "ab " * 3000 + "\n\n  \t x", "\x00\x7f é é", "﻿�  ",
]


def test_bpe_equals_library(spark, sf):
    given = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD + ODD[:3])], "doc_id long, text string, ids string, Decoded string")
    docs = common.table(spark, sf, "documents").select("doc_id", "text", F.lit("x").alias("ids"), F.lit("y").alias("Decoded"))
    coded = bpe.decode(bpe.encode(given.unionByName(docs), PATH), PATH, ids="ids_")
    tok = Tokenizer.from_file(PATH)
    rows = coded.collect()
    assert len(rows) == len(ODD) + 3 + docs.count()
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids_"]) == ids and r["decoded_"] == tok.decode(ids, skip_special_tokens=False)


def test_bpe_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, PATH), PATH).collect() == []


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    known = common.settle(quality.featured(docs).drop("text"))
    model = quality.fit(known, labels.where("doc_id % 5 <> 0"))
    held = quality.score(known, model).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in held) >= 0.95 * len(held)


def test_quality_site_posteriors(spark):
    """Rates against the moment formulas in plain Python: sparse sites lie nearer to their parent than large ones."""
    counts = {("a", "p"): (0, 40), ("a", "q"): (30, 40), ("b", "p"): (1, 1), ("c", "p"): (0, 1), ("d", "p"): (55, 60), (None, None): (9, 10)}
    rows = [(h, p, float(g), float(n)) for (h, p), (g, n) in counts.items()]
    prior = 0.6
    got = {(r[0], r[1]): r[2] for r in quality._sites(spark.createDataFrame(rows, "_site0 string, _site1 string, good double, n double"), ("h", "p"), prior).collect()}

    def shrink(groups, parents):
        over = sum(n * (g / n - parents[k]) ** 2 - parents[k] * (1 - parents[k]) for k, (g, n) in groups.items())
        rho = over / sum((n - 1) * parents[k] * (1 - parents[k]) for k, (g, n) in groups.items())
        m = (1 - rho) / rho + 1 if rho < 1 else 1.0
        return {k: parents[k] if rho <= 1e-9 else (g + m * parents[k]) / (n + m) for k, (g, n) in groups.items()}

    hosts = {}
    for (h, _), (g, n) in counts.items():
        a, b = hosts.get(h, (0, 0))
        hosts[h] = (a + g, b + n)
    up = shrink(hosts, dict.fromkeys(hosts, prior))
    want = shrink(counts, {k: up[k[0]] for k in counts})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert abs(got["b", "p"] - prior) < abs(1 - got["b", "p"]) + 0.5


def test_quality_odd_rows(spark):
    rows = [(1, "good words here.", None, "en", "k"), (1, "good words here.", None, "en", "k"), (None, None, "s", None, "k"), (3, "", "s", "en", "k"),
            (4, "%%% ### $$$ " * 20_000, "s", "en", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 0), (3, None)], "doc_id long, quality int")
    known = common.settle(quality.featured(docs).drop("text"))
    out = quality.score(known, quality.fit(known, labels))
    assert out.count() == 5 and "kept_" in out.columns and out.where("kept_ is null").count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert quality.keep_good(docs, none).count() == 5 and quality.keep_good(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "x" * 200_000])
def test_features_bounded(text):
    assert all(0 <= v < 5000 for v in quality.features_of(text)) and len(quality.features_of(text)) == len(quality.NAMES)


def test_bpe_split_below_256():
    """Texts of characters below U+0100 are split by a table of their classes, as the general pattern splits them."""
    from random import Random

    import regex

    r, general = Random(3), regex.compile(bpe.PATTERN)
    letters = [chr(i) for i in range(256)]
    texts = ["".join(r.choices(letters, k=80)) for _ in range(3000)] + ["a'll 've'x  \n\n y\x85\xa0z \x1c\x1d 12\xb23", " " * 9, "'", ""]
    plain = [t for t in texts if not bpe.NOT_LATIN.search(t)]
    assert 100 < len(plain) and all(bpe.LATIN_WORDS.findall(t) == general.findall(t) for t in plain)
    assert all(bpe.NOT_LATIN.search(c) for c in "\xb2\xbdĀ漢")
