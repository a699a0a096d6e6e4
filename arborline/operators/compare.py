"""Comparing trees by their splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trees as tr
from ..plans import stages
from . import blocks


def splits(trees: DataFrame) -> DataFrame:
    """(tree_id, split): the non-trivial splits of every tree, as the sorted leaves of the canonical side, joined by commas."""
    return stages.exploded(stages.splits(trees), F.transform("splits", lambda s: F.array_join(s, ",")), "tree_id", row="_", item="split").drop("_")


def robinson_foulds(trees: DataFrame, a: str = "v", b: str = "w", normalize: bool = False) -> DataFrame:
    """``rf`` of two vectors a row; unequal numbers of leaves are an error, three leaves or fewer give 0."""
    same = F.when(F.size(a) == F.size(b), F.col(a)).otherwise(F.raise_error(F.lit("Trees must have the same number of leaves")).cast("array<int>"))
    keep = trees.columns
    one = stages.splits(trees.withColumn("v", same)).withColumn("_a", F.col("splits")).drop("pairs", "rows", "splits")
    two = stages.splits(one.withColumn("v", F.col(b)))
    return two.withColumn("rf", tr.robinson_foulds(F.col("_a"), F.col("splits"), normalize)).select(*[c for c in keep if c != a], "rf")


#: Cells of a matrix of trees by splits that are held at once, and the share of a block's pairs from which on a split takes a column of it.
CELLS, COMMON = 1 << 22, 1 / 64


def _holders(splits: pa.ListArray, ids: np.ndarray, common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trees, splits, counts): the places of trees that hold a split, ordered by split, and how many hold each."""
    trees = np.repeat(np.arange(len(splits)), splits.value_lengths().to_numpy())
    order = np.argsort(ids, kind="stable")
    return trees[order], ids[order], np.bincount(ids, minlength=common)


def _shared(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """How many splits each tree of one list has in common with each of another.

    Splits of many pairs are counted by products of matrices of 0 and 1, exact in single precision, a few thousand
    splits at a time; rare ones pair by pair, so their cost is that of what is shared.
    """
    words = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    ids, size = words.indices.to_numpy(), len(words.dictionary)
    n, m, cut = len(left), len(right), len(left.flatten())
    sides = [_holders(left, ids[:cut], size), _holders(right, ids[cut:], size)]
    (t1, s1, n1), (t2, s2, n2) = sides
    many = n1.astype(np.int64) * n2
    out = np.zeros((n, m), np.float32)
    common = np.flatnonzero(many >= max(1, COMMON * n * m))
    column = np.full(size, -1)
    column[common] = np.arange(len(common))
    step = max(1, CELLS // max(n, m))
    for at in range(0, len(common), step):
        one, two = (np.zeros((rows, min(step, len(common) - at)), np.float32) for rows in (n, m))
        for held, (trees, of, _) in ((one, sides[0]), (two, sides[1])):
            c = column[of] - at
            here = (c >= 0) & (c < held.shape[1]) & (column[of] >= 0)
            held[trees[here], c[here]] = 1
        out += one @ two.T
    # a rare split's holders on the left, each with all its holders on the right
    rare = (column[s1] < 0) & (many[s1] > 0)
    t1, s1 = t1[rare], s1[rare]
    starts, each = np.cumsum(n2) - n2, n2[s1]
    ends = np.cumsum(each)
    for a in range(0, int(ends[-1]) if len(ends) else 0, CELLS):
        nth = np.arange(a, min(a + CELLS, int(ends[-1])))
        held = np.searchsorted(ends, nth, side="right")
        other = t2[starts[s1[held]] + nth - (ends - each)[held]]
        np.add.at(out.reshape(-1), t1[held] * m + other, np.float32(1))
    return out


def rf_all_pairs(trees: DataFrame) -> DataFrame:
    """(a, b, rf) for all a < b of trees of equal size; that output is quadratic by definition.

    Trees of a size are dealt to bounded blocks, and an Arrow kernel counts what the trees of two blocks share.
    """
    t = stages.splits(trees).select("tree_id", F.size("v").alias("k"), F.transform("splits", lambda s: F.array_join(s, ",")).alias("splits"))

    def compare(left: pa.Table, right: pa.Table) -> list[tuple[np.ndarray, None]]:
        one, two = (x.column("splits").combine_chunks() for x in (left, right))
        sizes = [x.value_lengths().to_numpy().astype(float) for x in (one, two)]
        return [(sizes[0][:, None] + sizes[1][None] - 2 * _shared(one, two), None)]

    weight = F.aggregate("splits", F.lit(0), lambda n, s: n + F.length(s) + 4)
    pairs = blocks.all_pairs(t, "k", "tree_id", ["splits"], weight, "rf double", compare, keyed=False)
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "rf")


def split_support(trees: DataFrame) -> DataFrame:
    """(n_leaves, split, trees, support): how many trees of a size hold each split; the sums are partial before the shuffle."""
    t = stages.exploded(stages.splits(trees), F.transform("splits", lambda s: F.array_join(s, ",")), (F.size("v") + 1).alias("n_leaves"), row="_", item="split")
    counts = t.groupBy("n_leaves", "split").agg(F.count(F.lit(1)).alias("trees"))
    totals = trees.groupBy((F.size("v") + 1).alias("n")).agg(F.count(F.lit(1)).alias("all"))
    return counts.join(totals, F.col("n_leaves") == F.col("n")).select("n_leaves", "split", "trees", (F.col("trees") / F.col("all")).alias("support"))


def trees_with_split(trees: DataFrame, wanted: DataFrame) -> DataFrame:
    """The trees that hold any of the splits in ``wanted`` (split)."""
    return trees.join(splits(trees).join(wanted, "split", "left_semi").select("tree_id").distinct(), "tree_id", "left_semi")
