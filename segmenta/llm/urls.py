"""URL filters: host and path rules, and gradient-boosted trees for urls that no rule fits.

Everything runs in DataFrame functions: features are expressions over the url, and the
trees, once grown, are nested conditions. The trees are grown on the driver from
labelled urls; in the query those are the urls that a rule decides (label 1: block). At
most TRAIN_ROWS of them, a share of the hashes of their rows, are used.

Features: length of url, host and path, depth of the path, labels of the host, share of
digits in url and path, hyphens of the host, entropy of the host's characters, number
of parameters, whether there is a fragment, a file suffix or a final slash, and
statistics of the host's last label and of its last two over all labelled urls: the share
of blocked ones (towards one half by PRIOR pseudo-counts) and the logarithm of their
number. Statistics are kept for the SUFFIXES most frequent of each; all others share one
value. While the trees are grown, a url's shares are counted without its own fold of
FOLDS, so that its own label is not among its features.

Defined results: null urls and urls without "://" have an empty host and path and no
rule; empty urls, repeated rows and very long urls are judged like any other; with
labels of one class only (or none) every url without a rule gets that class (allow);
of rules that fit, the longest wins, of equally long ones the first in the alphabet;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: rules as (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 16
MIN_LEAF, L2 = 20, 1.0
SUFFIXES = 200
PRIOR = 20.0
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none fits."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _entropy(s: Column) -> Column:
    """Bits a character, over the distinct characters of s."""
    n = F.length(s)
    chars = F.array_distinct(F.split(s, ""))
    share = F.transform(chars, lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def suffix_of(host: Column, labels: int = 1) -> Column:
    """The last labels of a host."""
    return F.substring_index(host, ".", -labels)


def features(url: Column, host: Column, path: Column, stats: dict[str, dict[str, float]], fold: Column | None = None) -> dict[str, Column]:
    """The features by name, as doubles; with fold the shares are those without it."""
    u = F.coalesce(url, F.lit(""))
    asked = F.regexp_extract(u, r"\?([^#]*)", 1)

    def stat(name: str, last: Column, default: float) -> Column:
        values = stats.get(name, {})
        if not values:
            return F.lit(default)
        pairs = [F.lit(x) for kv in sorted(values.items()) for x in kv]
        return F.coalesce(F.element_at(F.create_map(*pairs), last), F.lit(default))

    def share(labels: int) -> Column:
        last = suffix_of(host, labels)
        if fold is None:
            return stat(f"share{labels}", last, 0.5)
        return stat(f"without{labels}", F.concat_ws(" ", fold.cast("string"), last), 0.5)

    digits = lambda s: F.regexp_count(s, F.lit("[0-9]"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = {
        "length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")),
        "labels": F.regexp_count(host, F.lit(r"\.")),
        "digit_ratio": ratio(digits(u), F.length(u)),
        "path_digit_ratio": ratio(digits(path), F.length(path)),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "entropy": _entropy(host),
        "parameters": F.when(asked != "", F.regexp_count(asked, F.lit("&")) + 1).otherwise(0),
        "fragment": u.contains("#"),
        "file_suffix": path.rlike(r"\.[A-Za-z0-9]{1,5}$"),
        "final_slash": path.endswith("/"),
        "suffix_share": share(1),
        "suffix_seen": stat("seen1", suffix_of(host), 0.0),
        "domain_share": share(2),
        "domain_seen": stat("seen2", suffix_of(host, 2), 0.0),
    }
    return {k: v.cast("double") for k, v in out.items()}


def grow_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """(start, trees) of a boosted logistic model; a tree is (feature, threshold, at most, above) or a leaf's value."""
    if not len(y) or y.min() == y.max():
        return (-1.0 if not len(y) or y[0] == 0 else 1.0), []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), start)
    trees = []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = float(-RATE * g[rows].sum() / (h[rows].sum() + L2))
        best = (1e-6, None, None)
        if depth:
            gt, ht = g[rows].sum(), h[rows].sum()
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < MIN_LEAF) | (len(rows) - ns < MIN_LEAF)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), f, k)
        if best[1] is None:
            z[rows] += value
            return value
        left = binned[rows, best[1]] <= best[2]
        return best[1], float(edges[best[1]][best[2]]), split(rows[left], g, h, depth - 1), split(rows[~left], g, h, depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(split(np.arange(len(y)), p - y, p * (1 - p), DEPTH))
    return start, trees


def tree_value(node, row) -> float:
    """A tree's value for a row of features, for tests."""
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def _condition(node, names: list[str]) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    return F.when(F.col(names[node[0]]) <= F.lit(node[1]), _condition(node[2], names)).otherwise(_condition(node[3], names))


class UrlModel:
    """The grown trees and the statistics of suffixes that their features need."""

    def __init__(self, start: float, trees: list, stats: dict[str, dict[str, float]]):
        self.start, self.trees, self.stats = start, trees, stats

    def log_odds(self, names: list[str]) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + _condition(t, names)
        return out


def suffix_statistics(d: DataFrame) -> dict[str, dict[str, float]]:
    """Shares of label 1 by suffix, the same without each fold, and numbers, over rows (host, label, fold)."""
    stats: dict[str, dict[str, float]] = {}
    for labels in (1, 2):
        by_fold = d.groupBy(suffix_of(F.col("host"), labels).alias("suffix"), "fold").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
        top = by_fold.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "k")))).alias("of"))
        share = lambda k, n: (k + PRIOR / 2) / (n + PRIOR)
        for r in top.orderBy(F.desc("n"), "suffix").limit(SUFFIXES).collect():
            stats.setdefault(f"share{labels}", {})[r.suffix] = share(r.k, r.n)
            stats.setdefault(f"seen{labels}", {})[r.suffix] = float(np.log1p(r.n))
            for fold in range(FOLDS):
                mine = r["of"].get(fold)
                stats.setdefault(f"without{labels}", {})[f"{fold} {r.suffix}"] = share(r.k - mine.k, r.n - mine.n) if mine else share(r.k, r.n)
    return stats


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> UrlModel:
    """Grow trees from labelled urls (url, label 0 or 1, and key, which tells rows with equal urls apart)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    d = labelled.filter("label is not null").select("url", F.col("label").cast("int").alias("label"), host.alias("host"), path.alias("path"), F.xxhash64("url", "key").alias("h"))
    # urls of one host are one fold, as they share their labels' reasons
    d = d.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    stats = suffix_statistics(d)
    named = features(F.col("url"), F.col("host"), F.col("path"), stats, F.col("fold"))
    # a share of the hashes that holds about as many rows as the bound, so that no task sends more than its part
    total = d.count()
    if total > rows:
        d = d.filter(F.shiftrightunsigned("h", 32) < int((1 << 32) * 0.95 * rows / total))
    got = sorted(d.select("h", *(v.alias(k) for k, v in named.items()), "label").collect())
    x = np.array([[r[k] for k in named] for r in got], np.float64).reshape(-1, len(named))
    start, trees = grow_trees(x, np.array([r.label for r in got], np.float64))
    return UrlModel(start, trees, stats)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block by the trees)."""
    url = F.col("url")
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    d = d.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    if model is None:
        model = fit(d.filter("hit is not null").select("url", (F.col("hit.verdict") == "block").cast("int").alias("label"), F.col("page_id").alias("key")))
    named = features(url, F.col("host"), F.col("path"), model.stats)
    d = d.withColumns({f"_{k}": v for k, v in named.items()})
    odds = model.log_odds([f"_{k}" for k in named])
    d = d.withColumn("score", 1 / (1 + F.exp(-odds)))
    return d.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
