"""Searching for good trees of an alignment: hill climbing over vectors, and descent on balanced minimum evolution.

Search loops run on the driver; what they score is a table of candidate trees, one job a step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stages
from . import kernels, likelihood

_METHODS: dict[str, type] = {}


def register_method(name: str) -> Callable[[type], type]:
    """Class decorator that lists a method by name; a name is taken once."""

    def add(cls: type) -> type:
        if name in _METHODS:
            raise ValueError(f"{name} is registered already")
        _METHODS[name] = cls
        return cls

    return add


def list_methods() -> list[str]:
    return sorted(_METHODS)


def method(name: str) -> type:
    return _METHODS[name]


@dataclass
class Result:
    """The best vector, taxa by leaf, its score, and the scores on the way."""

    best: list[int]
    label_mapping: dict[int, str]
    best_score: float
    scores: list[float] = field(default_factory=list)
    best_w: np.ndarray | None = None


def _leaves(alignment: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """The alignment with taxa numbered in order of their names (blanks in names become points); a search holds one alignment's taxa on the driver."""
    names = sorted(r["taxon"] for r in alignment.select("taxon").distinct().collect())
    table = alignment.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "taxon string, leaf int")
    return alignment.join(F.broadcast(table), "taxon"), {i: n.replace(" ", ".") for i, n in enumerate(names)}


def jc69_scorer(alignment: DataFrame, lengths: tuple[float, ...] = (0.02, 0.05, 0.1, 0.2, 0.4)) -> Callable[[DataFrame], DataFrame]:
    """(tree_id, v) -> (tree_id, score): minus the log likelihood at the best common branch length of ``lengths``; ``score.done()`` frees the patterns."""
    columns = likelihood.patterns(alignment.withColumn("alignment_id", F.lit(0))).cache()

    def score(trees: DataFrame) -> DataFrame:
        tried = trees.withColumn("_length", F.explode(F.array(*[F.lit(x) for x in lengths]))).withColumn("_tree", F.col("tree_id")).withColumn("tree_id", F.struct("tree_id", "_length"))
        t = stages.ancestry(tried).withColumn("bls", F.transform("v", lambda x: F.struct(F.col("_length").alias("b1"), F.col("_length").alias("b2")))).withColumn("alignment_id", F.lit(0))
        # the trees of a step are a few for each leaf, made on the driver; the patterns stay where they are
        found = likelihood.jc69(F.broadcast(t), columns)
        return found.groupBy(F.col("tree_id.tree_id").alias("tree_id")).agg((-F.max("loglik")).alias("score"))

    score.done = columns.unpersist
    return score


class BaseOptimizer:
    """A random tree over an alignment's taxa, of the method's ``mode`` ("vector", or "matrix" with lengths), and its search from there."""

    mode = "vector"

    def start(self, k: int, seed: int) -> tuple[list[int], list[tuple[float, float]] | None]:
        if self.mode not in ("vector", "matrix"):
            raise ValueError(f"unknown mode: {self.mode}")
        draw = np.random.default_rng(seed)
        v = [int(draw.integers(0, 2 * i + 1)) for i in range(k)]
        return v, None if self.mode == "vector" else [tuple(x) for x in draw.random((k, 2)).tolist()]

    def fit(self, alignment: DataFrame) -> Result:
        raise NotImplementedError


@register_method("HillClimbing")
class HillClimbing(BaseOptimizer):
    """Change one place of v at a time: all other values are scored in one job, and the best is taken if it is better.

    A step reshuffles the tree, so that places mean other branches, and goes ``rounds`` times over all places; steps
    end after ``patience`` of them without an improvement of more than ``tol``, or after ``steps``. Only improvements
    are accepted.
    """

    def __init__(self, scorer: Callable[[DataFrame], Callable] = jc69_scorer, tol: float = 1e-3, patience: int = 3, rounds: int = 1, steps: int | None = None, seed: int = 0):
        self.scorer, self.tol, self.patience, self.rounds, self.steps, self.seed = scorer, tol, patience, rounds, steps, seed

    def fit(self, alignment: DataFrame) -> Result:
        spark = alignment.sparkSession
        numbered, names = _leaves(alignment)
        k = len(names) - 1
        v, _ = self.start(k, self.seed)
        leaf_of = list(range(k + 1))
        still, scores = 0, []
        while still < self.patience and (self.steps is None or len(scores) <= self.steps):
            v, mapping = kernels.shuffle(v)
            leaf_of = [leaf_of[m] for m in mapping]
            back = spark.createDataFrame([(old, new) for new, old in enumerate(leaf_of)], "old int, new int")
            score = self.scorer(numbered.join(F.broadcast(back), F.col("leaf") == F.col("old")).drop("leaf", "old").withColumnRenamed("new", "leaf"))
            now = self._scores(spark, score, [v])[0]
            scores = scores or [now]
            for _ in range(self.rounds):
                for i in range(1, k):
                    tried = [v[:i] + [x] + v[i + 1 :] for x in range(2 * i + 1) if x != v[i]]
                    found = self._scores(spark, score, tried)
                    at = int(np.argmin(found))
                    if found[at] < now - 1e-12:
                        v, now = tried[at], found[at]
            still = 0 if now < scores[-1] - self.tol else still + 1
            scores.append(min(now, scores[-1]))
            getattr(score, "done", lambda: None)()
        return Result(v, {new: names[old] for new, old in enumerate(leaf_of)}, scores[-1], scores)

    @staticmethod
    def _scores(spark, score, vectors: list[list[int]]) -> list[float]:
        trees = spark.createDataFrame(list(enumerate(vectors)), "tree_id int, v array<int>")
        found = {r["tree_id"]: r["score"] for r in score(trees).collect()}
        return [found[i] for i in range(len(vectors))]


def expected_paths(w: np.ndarray, rooted: bool = False) -> np.ndarray:
    """E with E[i, j] the expectation of 2 ** -(path length) between leaves, places of an ordered vector drawn by the rows of w.

    Leaf i hangs on the branch of one of the leaves before it: its path to r goes by the half-way node, and the
    branch it was hung on gets longer by one for the others.
    """
    n = len(w) + 1
    e = np.zeros((n, n))
    e[1, 0] = e[0, 1] = 0.25 * (2 - rooted) * w[0, 0]
    for i in range(2, n):
        p = w[i - 1, :i]
        new = e[:i, :i] @ p * 0.5 + 0.25 * p  # diagonal of e is 0, so a leaf's own draw counts a cherry
        e[:i, :i] *= 1 - 0.5 * (p[:, None] + p[None])
        np.fill_diagonal(e, 0)
        e[i, :i] = e[:i, i] = new
    return e


def bme_loss(w: np.ndarray, distances: np.ndarray, rooted: bool = False) -> float:
    """ln of the expected balanced length: distances weighted by 2 ** -(path length)."""
    return float(np.log((expected_paths(w, rooted) * distances).sum()))


def bme_gradient(params: np.ndarray, distances: np.ndarray, rooted: bool = False) -> tuple[float, np.ndarray]:
    """The loss at ``row_weights(params)`` and its gradient, by going back through the recurrence of ``expected_paths``."""
    w, n = row_weights(params), len(params) + 1
    steps = [np.zeros((2, 2))]
    steps[0][0, 1] = steps[0][1, 0] = 0.25 * (2 - rooted) * w[0, 0]
    for i in range(2, n):
        e, p = steps[-1], w[i - 1, :i]
        grown = np.zeros((i + 1, i + 1))
        grown[:i, :i] = e * (1 - 0.5 * (p[:, None] + p[None]))
        grown[i, :i] = grown[:i, i] = e @ p * 0.5 + 0.25 * p
        steps.append(grown)
    total = float((steps[-1] * distances).sum())
    back, dw = distances.astype(float).copy(), np.zeros_like(w)
    np.fill_diagonal(back, 0)
    for i in range(n - 1, 1, -1):
        e, p = steps[i - 2], w[i - 1, :i]
        new, old = back[i, :i] + back[:i, i], back[:i, :i]
        dw[i - 1, :i] = 0.5 * e @ new + 0.25 * new - 0.5 * ((old * e).sum(1) + (old * e).sum(0))
        back = old * (1 - 0.5 * (p[:, None] + p[None])) + 0.5 * np.outer(new, p)
        np.fill_diagonal(back, 0)
    dw[0, 0] = 0.25 * (2 - rooted) * (back[0, 1] + back[1, 0])
    soft = np.tril(np.logaddexp(0, params)) + np.tril(np.full_like(params, 1e-12))
    dsoft = (dw - (dw * w).sum(1, keepdims=True)) / soft.sum(1, keepdims=True)
    return float(np.log(total)), np.tril(dsoft / (1 + np.exp(-params))) / total


class _Sgd:
    """Steps along the gradient, scaled by its largest entry."""

    def __init__(self, lr: float):
        self.lr = lr

    def __call__(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return x - self.lr * g / (np.abs(g).max() + 1e-12)


class _Adam:
    def __init__(self, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.lr, self.b1, self.b2, self.eps, self.t, self.m, self.v = lr, b1, b2, eps, 0, 0.0, 0.0

    def __call__(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = self.b1 * self.m + (1 - self.b1) * g, self.b2 * self.v + (1 - self.b2) * g * g
        return x - self.lr * (self.m / (1 - self.b1**self.t)) / (np.sqrt(self.v / (1 - self.b2**self.t)) + self.eps)


class _Adafactor:
    """Adafactor without factors: second moments of growing memory, updates of a clipped mean size, in units of the parameters."""

    def __init__(self, lr: float, decay: float = 0.8, clip: float = 1.0, least: float = 1e-3):
        self.lr, self.decay, self.clip, self.least, self.t, self.v = lr, decay, clip, least, 0, 0.0

    def __call__(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        keep = 1 - self.t**-self.decay
        self.v = keep * self.v + (1 - keep) * (g * g + 1e-30)
        u = g / np.sqrt(self.v)
        size = lambda a: np.sqrt((a[np.tril_indices(len(a))] ** 2).mean())
        return x - self.lr * max(size(x), self.least) * u / max(1.0, size(u) / self.clip)


SOLVERS = {"sgd": _Sgd, "adam": _Adam, "adafactor": _Adafactor}


def row_weights(params: np.ndarray) -> np.ndarray:
    """Lower-triangular weights that sum to one a row, from free parameters by softplus."""
    soft = np.tril(np.logaddexp(0, params)) + np.tril(np.full_like(params, 1e-12))
    return soft / soft.sum(1, keepdims=True)


def one_hot(v: list[int]) -> np.ndarray:
    w = np.zeros((len(v), len(v)))
    w[np.arange(len(v)), v] = 1
    return w


@register_method("GradME")
class GradME(BaseOptimizer):
    """Descent on the expected balanced length over ordered vectors, from several orders of the taxa.

    Gradients are exact. Starts are seeded each by itself and are independent of one another, so they run as tasks, one
    a row; a start ends when its loss changed by less than ``tol`` for ``patience`` iterations.
    """

    def __init__(self, model: str = "JC69", gamma: float | bool = False, solver: str = "adafactor", learning_rate: float = 1.5, rooted: bool = False, n_shuffles: int = 100, n_iter_per_step: int = 5000, patience: int = 10, tol: float = 1e-8, seed: int = 0, **solver_arguments):
        if solver not in SOLVERS:
            raise ValueError(f"unknown solver: {solver}; one of {sorted(SOLVERS)}")
        self.model, self.gamma, self.solver, self.lr, self.rooted, self.shuffles, self.iterations = model, gamma, solver, learning_rate, rooted, n_shuffles, n_iter_per_step
        self.patience, self.tol, self.seed, self.arguments = patience, tol, seed, solver_arguments

    def fit(self, alignment: DataFrame) -> Result:
        names = sorted(r["taxon"] for r in alignment.select("taxon").distinct().collect())
        at = {n: i for i, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        for r in likelihood.distances(alignment, self.model, self.gamma).collect():
            d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["distance"]
        return self.search(alignment.sparkSession, d, names)

    def search(self, spark, d: np.ndarray, names: list[str]) -> Result:
        """From a matrix of distances between the named taxa."""
        rows = spark.range(self.shuffles, numPartitions=self.shuffles).withColumnRenamed("id", "tree_id")
        rooted, iterations, patience, tol, seed = self.rooted, self.iterations, self.patience, self.tol, self.seed
        solver, lr, arguments = SOLVERS[self.solver], self.lr, self.arguments

        def start(row):
            rng = np.random.default_rng([seed, row["tree_id"]])
            order = rng.permutation(len(d))
            own = d[np.ix_(order, order)]
            params = 0.5 + rng.normal(size=(len(d) - 1, len(d) - 1)) / len(d)
            move, losses, still = solver(lr, **arguments), [], 0
            for _ in range(iterations):
                loss, gradient = bme_gradient(params, own, rooted)
                still = still + 1 if losses and abs(losses[-1] - loss) < tol else 0
                losses.append(loss)
                if still >= patience:
                    break
                params = move(params, gradient)
            v = row_weights(params).argmax(1)
            return {"tree_id": row["tree_id"], "v": v.tolist(), "order": order.tolist(), "score": bme_loss(one_hot(v.tolist()), own, rooted), "losses": losses, "w": row_weights(params).tolist()}

        found = kernels.mapped(rows, "tree_id long, v array<int>, order array<int>, score double, losses array<double>, w array<array<double>>", start)
        best = found.orderBy("score", "tree_id").first()
        return Result(list(best["v"]), {i: names[o] for i, o in enumerate(best["order"])}, best["score"], list(best["losses"]), np.array(best["w"]))


HillClimbingOptimizer, GradMEOptimizer = HillClimbing, GradME
