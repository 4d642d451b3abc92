"""URL verdicts from rules and, where no rule fits, from a path-template tree per host.

The tree is built level by level over counted paths, never over single pages. Number and hash runs inside a segment are
variable and become placeholders at once. On each level the branches of a node are compared with the node's pool by chi-square,
once by what follows below them and once by their labels; branches that do not differ merge into a wildcard, rare ones like any
other. The tree reaches to the end of every path; a path that is alone at its node needs no further level. A template is then
rejected by the share of blocked pages among its labelled ones, smoothed towards its host and the host towards all pages.

Everything runs on DataFrame functions; hosts with a third of all pages are combined before each shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import col, fresh, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: chi-square quantiles at 0.99 for 1 and 3 degrees of freedom (fixed values)
CHI_1, CHI_3 = 6.635, 11.345


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and all paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty for null and for urls without ``://``."""
    found = F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path between host and query or fragment; empty for null and for urls without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does. The rule list is a fixed, small parameter."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def typed_segments(path: Column) -> Column:
    """Segments of a path without empty ones; hash-like and digit runs become placeholders."""
    plain = F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "<hash>")
    plain = F.regexp_replace(plain, r"[0-9]+", "<n>")
    return F.filter(F.split(plain, "/", -1), lambda s: s != "")


def _kind(segment: Column) -> Column:
    """What follows a branch: nothing, a placeholder alone, a mix, or a plain word."""
    return (
        F.when(segment.isNull(), 0)
        .when(segment.rlike(r"\A<(n|hash)>\z"), 1)
        .when(segment.contains("<"), 2)
        .otherwise(3)
    )


def _chi(own: list[Column], own_n: Column, all_: list[Column], all_n: Column) -> Column:
    """Chi-square of a branch's counts against the shares of its pool."""
    out = F.lit(0.0)
    for o, a in zip(own, all_, strict=True):
        expected = own_n * a / all_n
        out = out + F.when(expected > 0, (o - expected) * (o - expected) / expected).otherwise(0.0)
    return out


def _common(lo: Column, hi: Column) -> Column:
    """How many segments two paths share at their start."""
    same = F.zip_with(lo, hi, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def templates(paths: DataFrame) -> DataFrame:
    """Template of each counted path: ``paths(host, parts, n, allow, block)`` with ``template`` added.

    A round takes every node past what all its paths share (the common start of the smallest and the largest of them), to their ends if there
    is only one, and then compares the branches there. Rounds are thus as many as branchings on one path, however long the paths are.
    """
    done: list[DataFrame] = []
    tree = settle(paths.withColumn("template", F.lit("")).withColumn("at", F.lit(0)))
    while True:
        rest = F.slice("parts", F.col("at") + 1, F.greatest(F.size("parts") - F.col("at"), F.lit(0)))
        ends = tree.groupBy("host", "template").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
        shared = ends.select("host", "template", _common(F.col("lo"), F.col("hi")).alias("jump"))
        further = F.concat_ws("/", "template", F.slice("parts", F.col("at") + 1, F.col("jump")))
        moved = settle(
            tree.join(shared, ["host", "template"]).withColumns({"template": further, "at": F.col("at") + F.col("jump")}).drop("jump")
        )
        done.append(moved.where(F.size("parts") <= F.col("at")).drop("at"))
        node = moved.where(F.size("parts") > F.col("at"))
        if node.isEmpty():
            return reduce(DataFrame.unionByName, done)
        node = node.withColumn("seg", F.try_element_at("parts", F.col("at") + 1))
        below = _kind(F.try_element_at("parts", F.col("at") + 2))
        counts = [F.sum(F.when(below == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(4)]
        branch = node.groupBy("host", "template", "seg").agg(
            F.sum("n").alias("bn"), F.sum("allow").alias("ba"), F.sum("block").alias("bb"), *counts
        )
        branch = settle(branch)
        pool = branch.groupBy("host", "template").agg(
            F.sum("bn").alias("pn"), F.sum("ba").alias("pa"), F.sum("bb").alias("pb"), F.count(F.lit(1)).alias("width"),
            *[F.sum(f"k{k}").alias(f"p{k}") for k in range(4)],
        )
        both = branch.join(pool, ["host", "template"])
        shape = _chi([F.col(f"k{k}") for k in range(4)], F.col("bn"), [F.col(f"p{k}") for k in range(4)], F.col("pn"))
        labels = F.col("ba") + F.col("bb")
        taste = _chi([F.col("ba"), F.col("bb")], labels, [F.col("pa"), F.col("pb")], F.col("pa") + F.col("pb"))
        alike = (shape <= CHI_3) & ((labels == 0) | (taste <= CHI_1))
        merged = F.when((F.col("width") > 1) & alike, F.lit("*")).otherwise(F.col("seg"))
        step = both.select("host", "template", "seg", merged.alias("to"))
        tree = node.join(step, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.lit("/"), "to"))
        tree = settle(tree.drop("seg", "to").withColumn("at", F.col("at") + 1))


def judge_urls(
    pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, prior: float = 1.0, reject: float = 0.5,
    label: str | None = None,
) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule``, ``template``, ``purity`` and ``verdict`` (allow or block).

    A fitting rule decides. Its verdict also labels the page for the template tree, unless ``label`` names a column of own labels
    (allow, block, null). Otherwise a template whose smoothed share of blocked labels, ``(block + prior * host share) / (labels +
    prior)``, exceeds ``reject`` is blocked. ``prior`` and ``reject`` are set by labels held out (see the README). Null urls and urls without ``://`` have an empty host and path and are judged like any
    template. Repeated rows get equal verdicts; an empty table gives an empty result. Columns of ``pages`` whose names clash with a
    new one keep their names, and the new one gets underscores.
    """
    host, path, rule, template, purity, verdict = (
        fresh(pages, c) for c in ("host", "path", "rule", "template", "purity", "verdict")
    )
    ruled, parts, key = fresh(pages, "_ruled"), fresh(pages, "_parts"), fresh(pages, "_key")
    rows = pages.withColumn(host, host_of(col(url))).withColumn(path, path_of(col(url)))
    text, said = rule_of(F.col(host), F.col(path), rules)
    rows = rows.withColumn(rule, text).withColumn(ruled, said).withColumn(parts, typed_segments(F.col(path)))
    rows = rows.withColumn(key, F.concat_ws("/", F.col(parts)))
    truth = col(label) if label else F.col(ruled)
    yes, no = F.count(F.when(truth == "allow", 1)), F.count(F.when(truth == "block", 1))
    paths = rows.groupBy(F.col(host).alias("host"), F.col(key).alias("key"), F.col(parts).alias("parts")).agg(
        F.count(F.lit(1)).alias("n"), yes.alias("allow"), no.alias("block")
    )
    tree = settle(templates(paths))
    total = tree.agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()
    overall = ((total["b"] or 0) + 1.0) / ((total["a"] or 0) + (total["b"] or 0) + 2.0)
    hosts = tree.groupBy("host").agg(
        ((F.sum("block") + prior * overall) / (F.sum("block") + F.sum("allow") + prior)).alias("share")
    )
    leaves = tree.groupBy("host", "template").agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).join(hosts, "host")
    leaves = leaves.select(
        "host", "template", ((F.col("b") + prior * F.col("share")) / (F.col("a") + F.col("b") + prior)).alias("purity")
    )
    known = settle(tree.select("host", "template", "key").join(leaves, ["host", "template"]))
    h, k = fresh(rows, "_h"), fresh(rows, "_k")
    known = known.select(
        F.col("host").alias(h), F.col("key").alias(k), F.col("template").alias(template), F.col("purity").alias(purity)
    )
    judged = rows.join(known, (F.col(host) == F.col(h)) & (F.col(key) == F.col(k)), "left")
    own = F.when(F.col(purity) > reject, "block").otherwise("allow")
    return judged.select(
        *[col(c) for c in pages.columns], host, path, rule, template, purity, F.coalesce(F.col(ruled), own).alias(verdict)
    )
