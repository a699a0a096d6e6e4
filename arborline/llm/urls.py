"""URL filter: a rule list, and gradient-boosted trees on lexical features for the rest.

The rules label the URLs they fit; on a bounded sample of those (SAMPLE distinct URLs with the smallest hashes, half of
either label where there are so many) trees are fitted in numpy on the driver. Endings of hosts and first segments of
paths are hashed to BUCKETS, each with its log-odds of block over the whole sample; for fitting, a URL's own fold is left
out of its figures, so trees don't learn what the labels told the figures. Scoring is one DataFrame expression, with no
Python.

Defined results: a null URL, or one without "://", has an empty host and path, no rule, and the method's verdict;
a null id is kept; repeated rows are judged alike and count once in the sample; without labelled URLs of both kinds the
verdict is that of the only kind, or allow; an empty table gives no rows. Only page_id and url are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict); a rule fits its host and all subdomains where the URL's path starts with its path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: At most so many distinct labelled URLs are used for fitting; buckets of endings and segments; folds of the sample.
SAMPLE, BUCKETS, FOLDS = 20_000, 4096, 5
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.3, 32, 20

FEATURES = ["n_chars", "depth", "digit_ratio", "entropy", "n_params", "host_dots", "path_chars", "ending1", "ending2", "segment"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, upper.lower()), path


def matched(host: Column, path: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int")


def lexical(pages: DataFrame, rules=tuple(RULES)) -> DataFrame:
    """page_id, url, host, path, rule, ruled and the features that need no labels, and the buckets of endings and segment."""
    url = F.coalesce("url", F.lit(""))
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, ruled = matched(F.col("host"), F.col("path"), rules)
    chars = F.greatest(F.length("url"), F.lit(1)).cast("double")
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    # Shannon entropy of the characters, in bits
    entropy = F.expr("""aggregate(array_distinct(split(url, '')), 0.0D, (acc, c) -> acc - IF(length(c) = 0, 0.0D,
        (length(url) - length(replace(url, c, ''))) / length(url) * log2((length(url) - length(replace(url, c, ''))) / length(url))))""")
    labels = F.split("host", r"\.")
    return rows.select(
        "*", rule.alias("rule"), ruled.alias("ruled"), F.length("url").cast("double").alias("n_chars"), (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/")))).cast("double").alias("depth"),
        (F.length(F.regexp_replace("url", "[^0-9]", "")) / chars).alias("digit_ratio"), entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise((F.length(query) - F.length(F.replace(query, F.lit("&"))) + 1).cast("double")).alias("n_params"),
        (F.size(labels) - 1).cast("double").alias("host_dots"), F.length("path").cast("double").alias("path_chars"),
        _bucket(F.element_at(labels, -1)).alias("end1"), _bucket(F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".")).alias("end2"),
        _bucket(F.regexp_extract("path", "^/[^/]*/?", 0)).alias("seg"),
    )


@dataclass
class Model:
    """Log-odds of text features by bucket, and the trees: nested (feature, cut, low, high) or a leaf value."""

    odds: dict[str, np.ndarray]
    start: float
    trees: list

    def score(self, col) -> Column:
        def walk(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, cut, low, high = node
            return F.when(col(name) <= float(cut), walk(low)).otherwise(walk(high))

        out = F.lit(float(self.start))
        for t in self.trees:
            out = out + walk(t)
        return out


_TEXTS = {"ending1": "end1", "ending2": "end2", "segment": "seg"}


def _odds(buckets: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-odds of block in each bucket; 0 where nothing fell."""
    block, every = np.bincount(buckets, y, BUCKETS), np.bincount(buckets, minlength=BUCKETS)
    return np.log((block + 1) / (every - block + 1))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, depth: int):
    value = -RATE * g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(g) < 2 * LEAST:
        return value
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        n = len(cut) + 1
        gs, hs, cs = (np.cumsum(np.bincount(binned[:, j], w, n))[:-1] for w in (g, h, None))
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
        gain[(cs < LEAST) | (len(g) - cs < LEAST)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, k)
    if best[1] is None:
        return value
    _, j, k = best
    low = binned[:, j] <= k
    return (FEATURES[j], float(cuts[j][k]), *(_grow(x[m], g[m], h[m], cuts, binned[m], depth - 1) for m in (low, ~low)))


def fit(rows: list) -> Model:
    """Boost trees on logistic loss; rows have the features of ``lexical`` and ``ruled``."""
    y = np.array([r["ruled"] == "block" for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model({k: np.zeros(BUCKETS) for k in _TEXTS}, 1.0 if len(y) and y[0] else -1.0, [])
    x = np.array([[r[_TEXTS.get(f, f)] for f in FEATURES] for r in rows], float)
    fold, odds = np.arange(len(y)) % FOLDS, {}
    for f in _TEXTS:
        j = FEATURES.index(f)
        buckets = x[:, j].astype(np.int64)
        odds[f] = _odds(buckets, y)
        for k in range(FOLDS):
            x[fold == k, j] = _odds(buckets[fold != k], y[fold != k])[buckets[fold == k]]
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(middles if len(middles) < BINS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    f, trees = np.full(len(y), start), []

    def value(node, rows_):
        if not isinstance(node, tuple):
            return np.full(len(rows_), node)
        name, cut, low, high = node
        left = rows_[:, FEATURES.index(name)] <= cut
        out = np.empty(len(rows_))
        out[left], out[~left] = value(low, rows_[left]), value(high, rows_[~left])
        return out

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        tree = _grow(x, p - y, p * (1 - p), cuts, binned, DEPTH)
        trees.append(tree)
        f = f + value(tree, x)
    return Model(odds, start, trees)


def train(rows: DataFrame) -> Model:
    """Fit on a sample of the labelled rows of ``lexical``: distinct URLs that hash lowest, of either label at least half where it has so many."""
    # a URL is counted once: equal ones meet before the shuffle
    distinct = rows.where("ruled IS NOT NULL").select("url", "ruled").distinct().withColumn("_order", F.md5("url"))
    allow, block = (distinct.where(F.col("ruled") == label).orderBy("_order").limit(SAMPLE).collect() for label in ("allow", "block"))
    half = SAMPLE // 2
    chosen = sorted([*allow[: max(half, SAMPLE - len(block))], *block[: max(half, SAMPLE - len(allow))]], key=lambda r: r["_order"])
    if not chosen:
        return fit([])
    table = rows.sparkSession.createDataFrame([(i, r["url"]) for i, r in enumerate(chosen)], "page_id int, url string")
    made = lexical(table).select("page_id", *[_TEXTS.get(f, f) for f in FEATURES]).orderBy("page_id").collect()
    return fit([{**r.asDict(), "ruled": c["ruled"]} for r, c in zip(made, chosen, strict=True)])


def judge(pages: DataFrame, rules=tuple(RULES), model: Model | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score (log-odds of block) of every URL."""
    rows = lexical(pages, rules)
    model = model or train(rows)
    for name, c in _TEXTS.items():
        rows = rows.withColumn(name, F.get(F.from_json(F.lit(json.dumps(model.odds[name].tolist())), "array<double>"), F.col(c)))
    rows = rows.withColumn("score", model.score(F.col))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def filter_report(pages: DataFrame) -> DataFrame:
    return judge(pages)
