"""Near-duplicate vectors by product quantisation over inverted lists.

Vectors of a label are compared by cosine. Equal vectors are one class. A label of n classes has about n / LIST inverted
lists, so lists grow with it: coarse centroids, from WIDE lists on with more levels of centroids on the residuals, so
that a sample of fixed size serves any number of lists. Centroids, and codebooks of PARTS subspaces on the last
residuals, are fitted on that sample on the driver, for each class of label sizes (powers of four); every class is
indexed. A class probes each list whose bisector with its own is near enough that a vector within the link's distance
could lie beyond it (DEVIATIONS of a random direction's share of that distance), level by level.
In a list, asymmetric distances are sums of table lookups; candidates within the same number of deviations of the
quantisation error are ranked by exact cosine in double precision, so no link below the threshold is returned.
Hot lists are dealt to blocks of members and of queries; a block pair returns counts and a spanning forest of
its links, never the links themselves. Vectors of a length that is rare, or not among the LENGTHS most common, have
no index: those of a label are one list, compared exactly.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those of a null
label, link with nothing; vectors of unequal length don't link; components of any finite size are compared; repeated
rows link with one another (n_links counts rows); a null id never names a component with other ids; an empty table
gives no rows. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import join_params, materialize, scratch

#: Classes (those of the lowest hashes) that centroids and codebooks are fitted on; rounds of k-means.
SAMPLE, ROUNDS = 16_384, 8
#: Members a list should have (up to four times as many), and the most centroids of a level.
LIST, WIDE = 512, 1024
#: Lengths of vectors that get an index.
LENGTHS = 8
PARTS, CODES = 8, 64
DEVIATIONS = 3.5
#: Members, and queries, of a block; queries that are compared at once.
BLOCK, AT_ONCE = 4096, 1024


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    order = np.random.default_rng(seed).permutation(len(x))
    c = x[order[:k]].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        size = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


class Index:
    """Coarse centroids, in levels, and codebooks for the last residuals, of unit vectors of one length.

    A list is numbered by its centroids, the first level's the highest digit.
    """

    def __init__(self, sample: np.ndarray, lists: int):
        d = sample.shape[1]
        self.levels: list[np.ndarray] = []
        rest = sample
        while lists > 1 or not self.levels:
            k = min(lists, WIDE, len(sample))
            self.levels.append(_kmeans(rest, k, 1 + len(self.levels)))
            rest = rest - self.levels[-1][_nearest(rest, self.levels[-1])]
            lists = -(-lists // k) if k > 1 else 1
        self.between = [np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1) - 2 * c @ c.T, 0)) for c in self.levels]
        self.cuts = np.linspace(0, d, min(PARTS, d) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], min(CODES, len(rest)), 2) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and its residual."""
        own, rest = np.zeros(len(x), np.int64), x
        for c in self.levels:
            at = _nearest(rest, c)
            own, rest = own * len(c) + at, rest - c[at]
        return own, rest

    def centroid(self, at: int) -> np.ndarray:
        out = 0.0
        for c in reversed(self.levels):
            out = out + c[at % len(c)]
            at //= len(c)
        return out

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the squared error of each."""
        codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)
        return codes, ((rest - back) ** 2).sum(1)

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) of all lists to probe: at each level those whose bisector with the nearest is no further than reach."""
        which, at, rest = np.arange(len(x)), np.zeros(len(x), np.int64), x
        for c, between in zip(self.levels, self.between, strict=True):
            far = (c**2).sum(1) - 2 * rest @ c.T
            own = far.argmin(1)
            near = far - far[np.arange(len(rest)), own][:, None] <= 2 * np.maximum(between[own], 1e-12) * reach
            near[np.arange(len(rest)), own] = True
            i, j = np.nonzero(near)
            which, at, rest = which[i], at[i] * len(c) + j, rest[i] - c[j]
        return which, at

    def distances(self, x: np.ndarray, codes: np.ndarray, at: int) -> np.ndarray:
        """Squared asymmetric distances of queries to the coded members of a list."""
        rest = x - self.centroid(at)
        out = np.zeros((len(x), len(codes)))
        for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            table = (rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ self.books[j].T + (self.books[j] ** 2).sum(1)
            out += table[:, codes[:, j]]
        return out


def _unit(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(q: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as (node, smallest node), of links q[i]-m[j]."""
    nodes, at = np.unique(np.concatenate([q[i], m[j]]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return list(zip(nodes[far].tolist(), nodes[root[far]].tolist(), strict=True))


def links_between(index: Index | None, at: int, x: np.ndarray, q: np.ndarray, y: np.ndarray, m: np.ndarray, codes: np.ndarray, error: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, member) of all links found between queries x and the members y of a list."""
    if len(x) > AT_ONCE:
        parts = [links_between(index, at, x[a : a + AT_ONCE], q[a : a + AT_ONCE], y, m, codes, error, cosine) for a in range(0, len(x), AT_ONCE)]
        return np.concatenate([i + a * AT_ONCE for a, (i, _) in enumerate(parts)]), np.concatenate([j for _, j in parts])
    if index is None:
        i, j = np.nonzero(x @ y.T >= cosine - 1e-9)
        keep = q[i] != m[j]
        i, j = i[keep], j[keep]
        hit = np.einsum("nd,nd->n", x[i], y[j]) >= cosine
        return i[hit], j[hit]
    limit = 2 - 2 * cosine
    # the distance is the asymmetric one less the member's error, but for their product in a random direction
    slack = 2 * DEVIATIONS * np.sqrt(limit * error / x.shape[1])
    i, j = np.nonzero(index.distances(x, codes, at) <= limit + error + slack)
    keep = q[i] != m[j]
    i, j = i[keep], j[keep]
    hit = np.zeros(len(i), bool)
    for a in range(0, len(i), 32_768):
        b = a + 32_768
        hit[a:b] = np.einsum("nd,nd->n", x[i[a:b]], y[j[a:b]]) >= cosine
    return i[hit], j[hit]


def _classes(vectors: DataFrame) -> DataFrame:
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    fine = "label IS NOT NULL AND x IS NOT NULL AND size(x) > 0 AND forall(x, e -> e IS NOT NULL AND abs(e) < double('Infinity')) AND exists(x, e -> e <> 0)"
    return v.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    with scratch(vectors.sparkSession) as keep:
        return _linked(vectors, cosine, keep)


def _linked(vectors: DataFrame, cosine: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = vectors.sparkSession
    rows = _classes(vectors)
    grouped = rows.where("fine").groupBy("label", "x").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("first_id"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()).withColumn("d", F.size("x")), "classes")
    held = classes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n"))
    held = materialize(held.select(F.xxhash64("label", "d").alias("g"), "d", "n"), "labels")
    common = held.groupBy("d").agg(F.sum("n").alias("all")).where(F.col("all") >= LIST).orderBy(F.desc("all"), "d").limit(LENGTHS)
    models: dict[tuple[int, int], Index] = {}
    power = F.floor(F.log(4.0, F.greatest(F.col("n") / F.lit(float(LIST)), F.lit(1.0))) + 1e-9).cast("int")
    for d in [r["d"] for r in common.collect()]:
        chosen = classes.where(F.col("d") == d).select(F.xxhash64("x").alias("h"), "x").orderBy("h").limit(SAMPLE).select("x").toArrow()
        sample = _unit(chosen["x"], d)
        for r in held.where(F.col("d") == d).select(power.alias("k")).distinct().collect():
            models[d, r["k"]] = Index(sample, 4 ** r["k"])
    shared = spark.sparkContext.broadcast(models)
    sized = join_params(classes.withColumn("g", F.xxhash64("label", "d")), held.select("g", power.alias("k")), "g", F.col("cid"))
    linked, forest = _links(sized, shared, cosine)
    found = materialize(components(forest), "roots")
    counted = linked.groupBy("cid").agg(F.sum("n").alias("n")).withColumnRenamed("cid", "_cid")
    owned = classes.join(materialize(counted, "counts"), F.col("cid") == F.col("_cid"), "left").join(found, F.col("cid") == F.col("node"), "left")
    owned = materialize(owned.select("label", "x", "first_id", F.coalesce("root", "cid").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links")), "owned")
    names = materialize(owned.groupBy("comp").agg(F.min("first_id").alias("component_id")).withColumnRenamed("comp", "_comp"), "names")
    named = owned.join(names, F.col("comp") == F.col("_comp")).select(F.col("label").alias("_label"), F.col("x").alias("_x"), "n_links", "component_id")
    named = keep(materialize(named, "named"))
    fine = rows.where("fine").join(named, (F.col("label") == F.col("_label")) & (F.col("x") == F.col("_x"))).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine.union(rest).select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, shared, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(cid, n): rows linked with each class, in parts; and a forest (u, v) of the links."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for whole in batches:
            for a in range(0, len(whole), 4096):
                batch = whole.slice(a, 4096)
                kind = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("d", "k")], 1)
                for d, k in np.unique(kind, axis=0).tolist():
                    part = batch.filter(pa.array((kind == (d, k)).all(1)))
                    cid, label, times, xs = (part.column(part.schema.get_field_index(c)) for c in ("cid", "label", "times", "x"))
                    x, index = _unit(xs, d), models.get((d, k))
                    if index is None:
                        own, codes, error, which, at = np.zeros(len(x), np.int64), np.zeros((len(x), 0), np.uint8), np.zeros(len(x)), np.arange(len(x)), np.zeros(len(x), np.int64)
                    else:
                        own, rest = index.assign(x)
                        codes, error = index.code(rest)
                        which, at = index.probes(x, DEVIATIONS * np.sqrt((2 - 2 * cosine) / d))
                    order = np.argsort(which, kind="stable")
                    cuts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(x)))])
                    probes = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at[order], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [cid, label, times, pa.array([d] * len(x), pa.int32()), pa.array([k] * len(x), pa.int32()), pa.array(own, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), probes, pa.array([v.tobytes() for v in x], pa.binary())],
                        ["cid", "label", "times", "d", "k", "list", "codes", "error", "probes", "unit"],
                    )

    kind = classes.schema["label"].dataType.simpleString()
    indexed = classes.select("cid", "label", "times", "d", "k", "x").mapInArrow(assign, f"cid long, label {kind}, times long, d int, k int, list long, codes binary, error double, probes array<long>, unit binary")
    indexed = materialize(indexed, "indexed")
    group = ["label", "d", "list"]
    probed = indexed.select("cid", "label", "d", F.explode("probes").alias("list"))
    counted = lambda df, n: df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias(n))
    renamed = {c: f"_{c}" for c in group}
    blocks = materialize(counted(indexed, "mb").join(counted(probed, "qb"), group).withColumnsRenamed(renamed), "blocks")
    on = (F.col("label") == F.col("_label")) & (F.col("d") == F.col("_d")) & (F.col("list") == F.col("_list"))
    deal = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = indexed.join(blocks, on).withColumn("m", deal("mb", 1)).withColumn("q", every("qb"))
    members = members.select(*group, "m", "q", "k", "cid", "times", "codes", "error", "unit")
    queries = indexed.select("cid", "label", "d", "k", F.explode("probes").alias("list"), "unit").join(blocks, on).withColumn("q", deal("qb", 2)).withColumn("m", every("mb"))
    queries = queries.select(*group, "m", "q", "k", "cid", F.lit(None).cast("long").alias("times"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), "unit")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        d, at = key[1].as_py(), key[2].as_py()
        index = shared.value.get((d, table["k"][0].as_py()))
        cid = table["cid"].to_numpy()
        unit = np.frombuffer(b"".join(v.as_py() for v in table["unit"]), np.float64).reshape(-1, d)
        mine = np.flatnonzero(~np.isnan(table["error"].to_numpy()))
        asks = np.setdiff1d(np.arange(len(cid)), mine)
        out_n: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        if len(mine) and len(asks):
            some = table.take(pa.array(mine))
            codes = np.frombuffer(b"".join(v.as_py() for v in some["codes"]), np.uint8).reshape(len(mine), -1) if index else np.zeros((len(mine), 0), np.uint8)
            i, j = links_between(index, at, unit[asks], cid[asks], unit[mine], cid[mine], codes, some["error"].to_numpy(), cosine)
            if len(i):
                n = np.zeros(len(asks), np.int64)
                np.add.at(n, i, some["times"].to_numpy()[j])
                hit = np.flatnonzero(n)
                out_n = dict(zip(cid[asks][hit].tolist(), n[hit].tolist(), strict=True))
                edges = _forest(cid[asks], cid[mine], i, j)
        k = len(out_n)
        return pa.table({
            "u": pa.array([*out_n, *(a for a, _ in edges)], pa.int64()),
            "v": pa.array([None] * k + [b for _, b in edges], pa.int64()),
            "n": pa.array([*out_n.values(), *[None] * len(edges)], pa.int64()),
        })

    compared = members.union(queries).groupBy(*group, "m", "q").applyInArrow(compare, "u long, v long, n long")
    compared = materialize(compared, "compared")
    return compared.where("n IS NOT NULL").select(F.col("u").alias("cid"), "n"), compared.where("v IS NOT NULL").select("u", "v")


def vector_report(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)
