"""Alignments: distances between taxa, and the likelihood of trees under the model of equal rates (JC69)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

# Bases, the ambiguity codes that stand for one of them, and the gap.
STATES = {"a": 0, "c": 1, "g": 2, "t": 3, "-": 4, "r": 0, "y": 1, "m": 0, "k": 2}


def state(base: Column) -> Column:
    """0..3 for a base, 4 for a gap; another letter is an error."""
    out = F.raise_error(F.concat(F.lit("unknown base: "), base)).cast("int")
    for letter, n in STATES.items():
        out = F.when(F.lower(base) == letter, n).otherwise(out)
    return out


def _kept_sites(alignment: DataFrame, key: str, pairwise: bool) -> DataFrame:
    """(key, taxon, s): the bases as an array; without ``pairwise``, only sites where no taxon of the alignment has a gap or a code."""
    rows = alignment.select(key, "taxon", F.split(F.lower("seq"), "").alias("s"))
    if pairwise:
        return rows
    gaps = rows.select(key, F.posexplode("s").alias("site", "base")).where("base <> '' AND base NOT IN ('a', 'c', 'g', 't')")
    gaps = gaps.groupBy(F.col(key).alias("_key")).agg(F.collect_set("site").alias("_gaps"))
    kept = F.transform(F.filter(F.transform("s", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: ~F.array_contains("_gaps", e["i"])), lambda e: e["x"])
    joined = rows.join(gaps, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(key, "taxon", F.when(F.col("_gaps").isNull(), F.col("s")).otherwise(kept).alias("s"))


def _corrected(model: str, alpha: float | None) -> Column:
    """A distance from the shares p of differing sites, pr and py of transitions among purines and pyrimidines, and the frequencies a, c, g, t."""
    c = F.col
    if model == "raw":
        return c("p")
    # -k ln w, or with rates drawn from a gamma distribution, k alpha w^(-1/alpha) less its value at w = 1
    grown = (lambda k, w: -k * F.ln(w)) if alpha is None else (lambda k, w: k * F.lit(float(alpha)) * (F.pow(w, F.lit(-1.0 / alpha)) - 1))
    one, tv = F.lit(1.0), c("p") - c("pr") - c("py")
    if model == "JC69":
        return grown(F.lit(0.75), one - c("p") * F.lit(4.0 / 3))
    if model == "K80":
        return grown(F.lit(0.5), one - 2 * (c("pr") + c("py")) - tv) + grown(F.lit(0.25), one - 2 * tv)
    if model == "F81":
        e = one - c("a") * c("a") - c("c") * c("c") - c("g") * c("g") - c("t") * c("t")
        return grown(e, one - c("p") / e)
    r, y = c("a") + c("g"), c("c") + c("t")
    kr, ky = 2 * c("a") * c("g") / r, 2 * c("c") * c("t") / y
    kv = 2 * (r * y - c("a") * c("g") * y / r - c("c") * c("t") * r / y)
    return grown(kr, one - c("pr") / kr - tv / (2 * r)) + grown(ky, one - c("py") / ky - tv / (2 * y)) + grown(kv, one - tv / (2 * r * y))


#: Cells of a matrix of bases that are held at once.
CELLS = 1 << 21


def _shares(left: pa.ChunkedArray, right: pa.ChunkedArray, among: bool) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Matrices of the shares of differing sites of two lists of texts, with ``among`` also of transitions a-g and c-t; and where no site is known in both.

    Sites count where both texts have a base, so the longer one's rest does not. Counts are sums of products of 0 and 1,
    a few thousand sites at a time, exact in single precision.
    """
    one, two = _bytes(left), _bytes(right)
    n, m, sites = len(one), len(two), min(one.shape[1], two.shape[1])
    known, same, ag, ct = (np.zeros((n, m)) for _ in range(4))
    step = min(max(1, CELLS // max(n, m)), 1 << 16)
    for at in range(0, sites, step):
        x, y = ([(t[:, at : min(at + step, sites)] == ord(b)).astype(np.float32) for b in "acgt"] for t in (one, two))
        known += sum(x) @ sum(y).T
        for u, v in zip(x, y, strict=True):
            same += u @ v.T
        if among:
            ag += x[0] @ y[2].T + x[2] @ y[0].T
            ct += x[1] @ y[3].T + x[3] @ y[1].T
    none = known == 0
    with np.errstate(invalid="ignore", divide="ignore"):
        found = [d / known for d in (known - same, *((ag, ct) if among else ()))]
    return found, none if none.any() else None


def _rounded(shares: np.ndarray, digits: int) -> np.ndarray:
    """Rounded by half up of the shortest decimals, as Spark's ``round`` does; shares repeat, so each is rounded once."""
    unit, out = Decimal(1).scaleb(-digits), np.empty_like(shares)
    seen: dict[float, float] = {}
    for row, to in zip(shares, out, strict=True):
        values, at = np.unique(row, return_inverse=True)
        to[:] = np.array([seen[x] if x in seen else seen.setdefault(x, x if x != x else float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP))) for x in values.tolist()])[at]
    return out


def _bytes(texts: pa.ChunkedArray) -> np.ndarray:
    """A row of bytes for each text, filled up with zeros; a null is an empty text."""
    rows = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    size = max(map(len, rows), default=0)
    return np.frombuffer(b"".join(t.ljust(size, b"\0") for t in rows), np.uint8).reshape(len(rows), size)


MODELS = ("raw", "JC69", "K80", "F81", "TN93")


def distances(alignment: DataFrame, model: str = "JC69", gamma: float | bool = False, key: str | None = None, pairwise_deletion: bool = False, digits: int | None = None) -> DataFrame:
    """([key,] a, b, distance) for a < b of the taxa of an alignment, or of each alignment of a table by its ``key``.

    ``gamma`` is the shape of the rates' distribution (True: 1). Sites with a gap or an ambiguity code anywhere in an
    alignment are left out, or with ``pairwise_deletion`` those where the pair has one. Taxa are compared block by block
    in an Arrow kernel, which counts equal bases by products of matrices. Distances are rounded to ``digits``, raw ones by
    the kernel, where they are few.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    table = alignment if key else alignment.withColumn("alignment_id", F.lit(0))
    key_ = key or "alignment_id"
    s = _kept_sites(table.where(F.col(key_).isNotNull()), key_, pairwise_deletion)
    # what isn't a base is one letter, so that a site is a byte
    text = F.array_join(F.transform("s", lambda x: F.when(x.isin("a", "c", "g", "t"), x).otherwise(F.lit("-"))), "").alias("text")
    shares = ["p"] if model in ("raw", "JC69", "F81") else ["p", "pr", "py"]
    more = list("acgt") if model in ("F81", "TN93") else []
    rows = s.select(key_, "taxon", text)
    if more:
        count = lambda b: F.sum(F.size(F.filter("s", lambda x: x == b)))
        sums = s.groupBy(F.col(key_).alias("_of")).agg(*[count(b).alias(b) for b in "acgt"])
        total = sum((F.col(b) for b in "acgt"), F.lit(0))
        rows = rows.join(sums.select("_of", *[(F.col(b) / total).alias(b) for b in "acgt"]), F.col(key_) == F.col("_of")).drop("_of")

    def compare(left: pa.Table, right: pa.Table) -> list[tuple[np.ndarray, np.ndarray | None]]:
        found, null = _shares(left.column("text"), right.column("text"), len(shares) > 1)
        if model == "raw" and digits is not None:
            found = [_rounded(x, digits) for x in found]
        shape = (len(left), len(right))
        return [(x, null) for x in found] + [(np.broadcast_to(left.column(c).to_numpy()[:, None], shape), None) for c in more]

    schema = ", ".join(f"{c} double" for c in shares + more)
    pairs = blocks.all_pairs(rows, key_, "taxon", ["text", *more], F.length("text"), schema, compare, key is not None)
    alpha = None if gamma is False or gamma is None else float(gamma)
    return pairs.select(*([key_] if key else []), F.col("x").alias("a"), F.col("y").alias("b"), (_corrected(model, alpha) if model == "raw" or digits is None else F.round(_corrected(model, alpha), digits)).alias("distance"))


def patterns(alignment: DataFrame, key: str = "alignment_id") -> DataFrame:
    """(key, site pattern, weight): the distinct columns of alignments, states by ``leaf``, with their counts.

    The group by a column's states is what compresses an alignment; sums are partial before the shuffle.
    """
    sites = alignment.select(key, "leaf", F.posexplode(F.split("seq", "")).alias("site", "base")).where("base <> ''")
    columns = sites.groupBy(key, "site").agg(F.sort_array(F.collect_list(F.struct("leaf", state(F.col("base")).alias("s")))).alias("c"))
    return columns.groupBy(key, F.col("c.s").alias("states")).agg(F.count(F.lit(1)).alias("weight"))


def log_likelihood(rows: Column, bls: Column, states: Column) -> Column:
    """ln of a pattern's likelihood: partial likelihoods are folded up the ancestry, scaled at each node."""
    k = F.size(rows)
    ones = lambda: F.array(*[F.lit(1.0)] * 4)
    tip = lambda s: F.when(s == 4, ones()).otherwise(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.when(j == s, 1.0).otherwise(0.0)))

    # binds a value to a name inside a fold, so that it is computed once
    let = lambda x, f: F.transform(F.array(x), f).getItem(0)
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x)

    def step(acc, e):
        def below(child, length):
            part = F.when(child <= k, tip(F.get(states, child))).otherwise(F.get(acc["parts"], child - k - 1))
            moved = lambda q, d, t: F.transform(q, lambda x: d * x + (F.lit(1.0) - d) * F.lit(0.25) * t)
            return let(part, lambda q: let(F.exp(F.lit(-4.0 / 3) * length), lambda d: let(total(q), lambda t: moved(q, d, t))))

        r, b = e["r"], e["b"]
        both = F.zip_with(below(r["c1"], b["b1"]), below(r["c2"], b["b2"]), lambda x, y: x * y)
        scaled = lambda p, top: F.struct(F.array_append(acc["parts"], F.transform(p, lambda x: x / top)).alias("parts"), (acc["log"] + F.ln(top)).alias("log"))
        return let(both, lambda p: let(F.array_max(p), lambda top: scaled(p, top)))

    start = F.struct(F.expr("cast(array() as array<array<double>>)").alias("parts"), F.lit(0.0).alias("log"))
    steps = F.zip_with(rows, bls, lambda r, b: F.struct(r.alias("r"), b.alias("b")))
    end = lambda acc: acc["log"] + F.ln(F.lit(0.25) * F.aggregate(F.element_at(acc["parts"], -1), F.lit(0.0), lambda a, x: a + x))
    return F.aggregate(steps, start, step, end)


def _pruned(c1, c2, p, b1, b2, states, frequencies: np.ndarray) -> np.ndarray:
    """ln of the likelihoods of rows with trees of one size: a matrix each, with a row for each of them."""
    n, k = c1.shape
    at, tips = np.arange(n), np.concatenate([np.eye(4), np.ones((1, 4))])
    parts = np.ones((n, 2 * k + 1, 4))
    parts[:, : k + 1] = tips[states]
    log = np.zeros(n)
    for r in range(k):
        up = np.ones((n, 4))
        for child, length in ((c1[:, r], b1[:, r]), (c2[:, r], b2[:, r])):
            q, d = parts[at, child], np.exp(-4.0 / 3 * length)[:, None]
            up *= d * q + (1 - d) * 0.25 * q.sum(1, keepdims=True)
        top = up.max(1)
        parts[at, p[:, r]] = up / top[:, None]
        log += np.log(top)
    return log + np.log(parts[:, 2 * k] @ frequencies)


def jc69(trees: DataFrame, columns: DataFrame, key: str = "alignment_id", frequencies=(0.25,) * 4, rates=(1.0,), weights=(1.0,)) -> DataFrame:
    """(tree_id, loglik): trees with ``rows``, ``bls`` and the key of their alignment, joined with its patterns.

    ``frequencies`` are those of the root's states; a site's rate is one of ``rates`` (factors of the lengths) with the
    probabilities ``weights``.

    Trees of one size in an Arrow batch are pruned at once, all their patterns together; ``log_likelihood`` is the same
    for one row as an expression.
    """
    # patterns are many a row of their source, which Spark's estimate takes for few enough to be broadcast
    each = trees.select("tree_id", "rows", "bls", key).join(columns.hint("merge"), key).select("tree_id", "rows", "bls", "states", "weight")
    root = np.asarray(frequencies, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 4096):
                batch = whole.slice(a, 4096)
                sizes = batch.column(1).value_lengths().to_numpy()
                for k in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == k))
                    flat = lambda c, f: part.column(c).flatten().field(f).to_numpy(zero_copy_only=False).reshape(len(part), k)  # noqa: B023, E731
                    states = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(part), k + 1)
                    rows, lengths = [flat(1, f) for f in ("c1", "c2", "p")], [flat(2, f) for f in ("b1", "b2")]
                    found = np.logaddexp.reduce([np.log(w) + _pruned(*rows, *(r * x for x in lengths), states, root) for r, w in zip(rates, weights, strict=True)], axis=0)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found * part.column(4).to_numpy(), pa.float64())], ["tree_id", "l"])

    scored = each.mapInArrow(run, f"tree_id {trees.schema['tree_id'].dataType.simpleString()}, l double")
    return scored.groupBy("tree_id").agg(F.sum("l").alias("loglik"))
