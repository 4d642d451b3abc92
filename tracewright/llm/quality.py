"""Quality classifier: evidence of the document itself, combined with what is known of its site by hierarchical empirical Bayes.

* Document: figures of the whole text (``features_of``) enter a ridge logistic regression. It is fitted on all labelled rows by Newton steps
  whose sums Spark aggregates, so the driver sees one small matrix per step.
* Site: levels from host to path (of ``documents``: source, and language within it). The rate of good documents of a host
  shrinks towards the global rate, that of a path towards its host's. How strongly is estimated from the spread of the rates themselves
  (beta-binomial moments): sparse sites stay near their parent, large ones speak for themselves.
* Both: the odds of the document, with the global prior replaced by the posterior of its site. Documents below ``threshold`` are rejected.

Counts are grouped sums that combine before their shuffle; the table of sites grows with the number of sites only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tracewright.llm.common import col, fresh, settle

#: in the order of ``features_of``; the squares follow, then the constant
NAMES = (
    "words", "word_length", "longest_word", "letters", "upper", "digits", "symbols", "pipes", "exclaims", "non_ascii",
    "distinct", "top_word", "adjacent", "symbol_ends", "lines", "distinct_lines", "line_words", "stops", "capital_starts",
)
WIDTH = 2 * len(NAMES) + 1
STEPS, RIDGE, FAR = 12, 1.0, 12.0
_PLAIN = " \t\n\r.,;:'\"()-?!"
_KIND = np.zeros(128, np.uint8)  # 1 letter, 2 upper-case letter, 3 digit, 4 other symbol
for _c in range(33, 127):
    _s = chr(_c)
    _KIND[_c] = 2 if _s.isupper() else 1 if _s.isalpha() else 3 if _s.isdigit() else 0 if _s in _PLAIN else 4


def features_of(text: str | None) -> list[float]:
    """Figures of one whole text, of the order of 1; zeros for a text without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(text)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ascii_ = raw[raw < 128]
    kinds = np.bincount(_KIND[ascii_], minlength=5)
    marks = np.bincount(ascii_, minlength=128)
    beyond = size - ascii_.size
    letters = int(kinds[1] + kinds[2]) + beyond
    solid = max(1, sum(map(len, words)))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(not (w[-1].isalnum() or w[-1] in _PLAIN) for w in words)
    return [
        float(np.log1p(n)) / 10, float(np.log1p(solid / n)) / 5, float(np.log1p(max(map(len, words)))) / 5, letters / solid,
        float(kinds[2]) / max(1, letters), float(kinds[3]) / solid, float(kinds[4]) / solid, float(marks[124]) / n,
        float(marks[33]) / n, beyond / solid, len(counts) / n, max(counts.values()) / n, same / n, ends / n,
        float(np.log1p(len(lines))) / 10, len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))) / 10,
        sum(w[-1] in ".?!" for w in words) / n, sum(w[0].isupper() for w in words) / n,
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def _features(text: pd.Series) -> pd.Series:
    return pd.Series([features_of(t) for t in text], dtype=object)


def featured(docs: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    return docs.withColumn(name, _features(col(text)))


@dataclass(frozen=True)
class Model:
    """Weights of the document's evidence, the global rate of good documents, and the posterior rate of each site."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    prior: float
    levels: tuple[str, ...]
    sites: DataFrame  # the level columns as _site0, _site1, ... and site_rate


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -FAR, FAR)
    return np.hstack([z, np.minimum(z * z, FAR), np.ones((len(z), 1))])


def _sums(batches, mean, scale, weights):
    """Gradient and Hessian of the labelled rows of one partition, as (place, value)."""
    mean, scale, w = np.array(mean), np.array(scale), np.array(weights)
    grad, hess = np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))
    for b in batches:
        if b.num_rows:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            good, n = b.column("good").to_numpy().astype(float), b.column("n").to_numpy().astype(float)
            d = _design(x, mean, scale)
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            grad += d.T @ (good - n * p)
            hess += d.T @ (d * (n * p * (1 - p))[:, None])
    values = np.concatenate([grad, hess.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(values.size)), pa.array(values)], ["place", "value"])


def _weights(train: DataFrame, mean: list[float], scale: list[float], start: float) -> list[float]:
    w = np.zeros(WIDTH)
    w[-1] = start
    keep = np.full(WIDTH, RIDGE)
    keep[-1] = 1e-6
    for _ in range(STEPS):
        given = w.tolist()
        parts = train.select("features", "good", "n").mapInArrow(
            lambda it, given=given: _sums(it, mean, scale, given), "place long, value double"
        )
        total = np.zeros(WIDTH + WIDTH * WIDTH)
        for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():  # WIDTH * (WIDTH + 1) rows
            total[r["place"]] = r["value"]
        grad, hess = total[:WIDTH] - keep * (w - (np.arange(WIDTH) == WIDTH - 1) * w), total[WIDTH:].reshape(WIDTH, WIDTH)
        step = np.linalg.solve(hess + np.diag(keep), grad)
        w = w + step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w.round(9).tolist()


def _strength(groups: DataFrame) -> float:
    """Weight of the parent's rate, in documents: from the spread of the groups' rates ``good / n`` around ``parent``.

    A group of n has n * (rate - parent)^2 = v * (1 + (n - 1) * rho) on average, with v = parent * (1 - parent); the weight is
    (1 - rho) / rho, and endless where the groups differ by chance only.
    """
    v = F.col("parent") * (1 - F.col("parent"))
    off = F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("parent"), 2) - v
    got = groups.where("n > 0").agg(F.sum(off).alias("over"), F.sum((F.col("n") - 1) * v).alias("room")).first()
    rho = (got["over"] or 0.0) / got["room"] if got["room"] else 0.0
    return float("inf") if rho <= 1e-9 else max(0.0, (1 - rho) / rho) + 1.0


def _sites(counted: DataFrame, levels: Sequence[str], prior: float) -> DataFrame:
    """Posterior rates of all sites, from counts per most detailed site."""
    places = [f"_site{i}" for i in range(len(levels))]
    rates = None
    for depth in range(1, len(places) + 1):
        keys = places[:depth]
        groups = counted.groupBy(*keys).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
        if rates is None:
            groups = groups.withColumn("parent", F.lit(prior))
        else:
            above = rates.select(*[F.col(k).alias(f"{k}_up") for k in keys[:-1]], F.col("site_rate").alias("parent"))
            same = [F.col(k).eqNullSafe(F.col(f"{k}_up")) for k in keys[:-1]]
            groups = groups.join(above, same).drop(*[f"{k}_up" for k in keys[:-1]])
        groups = settle(groups)
        m = _strength(groups)
        rate = F.col("parent") if m == float("inf") else (F.col("good") + m * F.col("parent")) / (F.col("n") + m)
        rates = groups.select(*keys, rate.alias("site_rate"))
    return settle(rates)


def fit(
    features: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", levels: tuple[str, ...] = ("source", "lang")
) -> Model:
    """Fit on all labelled rows of ``features`` (made by ``featured``; settle it first).

    Labels are 1 (good) or 0; null labels and null ids are left out; several labels of a document each count. A null host or path is a
    site of its own. Without any label the model knows nothing and every document has the odds 1.
    """
    votes = labels.where(col(doc_id).isNotNull() & col(label).isNotNull()).groupBy(col(doc_id).alias("_id")).agg(
        F.sum(F.when(col(label) > 0, 1.0).otherwise(0.0)).alias("good"), F.count(F.lit(1)).cast("double").alias("n")
    )
    named = features.select(col(doc_id).alias("_doc"), "features", *[col(c).alias(f"_site{i}") for i, c in enumerate(levels)])
    train = settle(named.join(votes, F.col("_doc") == F.col("_id")).drop("_id", "_doc"))
    k = len(NAMES)
    moments = train.agg(
        F.sum("good").alias("good"), F.sum("n").alias("n"),
        *[f(F.col("features")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    good, n = moments["good"] or 0.0, moments["n"] or 0.0
    prior = (good + 1) / (n + 2)
    mean = [moments[f"m{i}"] or 0.0 for i in range(k)]
    scale = [max(1e-3, moments[f"s{i}"] or 0.0) for i in range(k)]
    weights = _weights(train, mean, scale, float(np.log(prior / (1 - prior)))) if n else [0.0] * WIDTH
    places = [f"_site{i}" for i in range(len(levels))]
    counted = named.groupBy(*places).agg(F.lit(0.0).alias("good"), F.lit(0.0).alias("n")).unionByName(train.select(*places, "good", "n"))
    return Model(mean, scale, weights, prior, levels, _sites(counted, levels, prior))


def _evidence(features: Column, model: Model) -> Column:
    """Log odds of the document by its own figures, under the global prior."""
    k = len(NAMES)
    total = F.lit(model.weights[-1])
    z = F.transform(
        features,
        lambda x, i: F.greatest(
            F.lit(-FAR), F.least(F.lit(FAR), (x - F.array(*map(F.lit, model.mean))[i]) / F.array(*map(F.lit, model.scale))[i])
        ),
    )
    w, sq = F.array(*map(F.lit, model.weights[:k])), F.array(*map(F.lit, model.weights[k : 2 * k]))
    terms = F.transform(z, lambda x, i: x * w[i] + F.least(x * x, F.lit(FAR)) * sq[i])
    return total + F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def score(features: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``features`` with ``evidence`` (log odds), ``site_rate``, ``probability`` (of being good) and ``kept``.

    New names get underscores where they are taken. Texts without words are judged by their figures, which are all zero; sites that the
    model has not seen have the global prior. Every row is returned as often as it comes.
    """
    seen = model.sites.select(*[F.col(f"_site{i}").alias(f"_known{i}") for i in range(len(model.levels))], F.col("site_rate").alias("_rate"))
    same = [col(c).eqNullSafe(F.col(f"_known{i}")) for i, c in enumerate(model.levels)]
    joined = features.join(seen, same, "left").drop(*[f"_known{i}" for i in range(len(model.levels))])
    rate = F.coalesce("_rate", F.lit(model.prior))
    evidence = _evidence(F.col("features"), model)
    odds = evidence + F.log(rate / (1 - rate)) - F.lit(float(np.log(model.prior / (1 - model.prior))))
    names = {c: fresh(features, c) for c in ("evidence", "site_rate", "probability", "kept")}
    out = joined.withColumns({names["evidence"]: evidence, names["site_rate"]: rate, names["probability"]: 1 / (1 + F.exp(-odds))})
    return out.withColumn(names["kept"], F.col(names["probability"]) >= threshold).drop("_rate", "features")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns unchanged."""
    known = settle(featured(docs.select("doc_id", "source", "lang", "text")).drop("text"))
    model = fit(known, labels)
    scored = score(featured(docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_doc"), "source", "lang", "text")), model, threshold)
    return scored.where("kept").select("_doc.*")
