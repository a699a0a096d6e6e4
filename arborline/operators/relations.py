"""Long tables of trees: rows, edges, nodes, and pairs of leaves; one row of the input makes its rows in place, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trees as tr
from ..plans import stages

TREE = "tree_id"


def pairs(trees: DataFrame) -> DataFrame:
    return stages.exploded(stages.pairs(trees), "pairs", TREE).select(TREE, "row", "e.c1", "e.c2")


def ancestry(trees: DataFrame) -> DataFrame:
    return stages.exploded(stages.ancestry(trees), "rows", TREE).select(TREE, "row", "e.c1", "e.c2", "e.p")


def edges(trees: DataFrame) -> DataFrame:
    e = stages.exploded(stages.edges(trees), "edges", TREE, row="at")
    return e.select(TREE, F.floor(F.col("at") / 2).cast("int").alias("row"), (F.col("at") % 2).alias("side"), "e.child", "e.parent")


def node_depths(trees: DataFrame, lengths: bool = False) -> DataFrame:
    return stages.exploded(stages.depths(trees, lengths), "depths", TREE, row="node", item="depth")


def node_depth(trees: DataFrame, node: Column, lengths: bool = False) -> DataFrame:
    """The depth of one node a tree; a label beyond the root is an error."""
    n = node.cast("int")
    fits = (n >= 0) & (n <= 2 * F.size("v"))
    found = F.when(fits, F.get(F.col("depths"), n)).otherwise(F.raise_error(F.concat(F.lit("no node "), n.cast("string"))).cast("double"))
    return stages.depths(trees, lengths).select(TREE, n.alias("node"), found.alias("depth"))


def common_ancestors(trees: DataFrame, a: Column, b: Column) -> DataFrame:
    """The lowest common ancestor of two nodes a tree."""
    t = stages.parents(trees).withColumn("_a", a.cast("int")).withColumn("_b", b.cast("int"))
    fits = (F.least("_a", "_b") >= 0) & (F.greatest("_a", "_b") <= 2 * F.size("v"))
    checked = F.when(fits, tr.common_ancestor(F.col("up"), F.col("_a"), F.col("_b"), 2 * F.size("v"))).otherwise(F.raise_error(F.lit("no such node")).cast("int"))
    return t.select(TREE, F.col("_a").alias("a"), F.col("_b").alias("b"), checked.alias("ancestor"))


def _leaf_pairs(trees: DataFrame, lengths: bool) -> DataFrame:
    """(l, r, m) for l <= r with their common ancestor and depths."""
    t = stages.depths(stages.parents(trees)).withColumn("tops", F.col("depths"))
    t = stages.lengths_above(stages.depths(t, lengths) if lengths else t, lengths)
    leaves = F.sequence(F.lit(0), F.size("v"))
    t = t.select(TREE, "up", "depths", "tops", "above", F.size("v").alias("k"), F.explode(leaves).alias("l"))
    t = t.withColumn("r", F.explode(F.sequence(F.col("l"), F.col("k"))))
    # they meet within as many steps as both have branches above them
    return t.withColumn("m", tr.common_ancestor(F.col("up"), F.col("l"), F.col("r"), F.get("tops", F.col("l")) + F.get("tops", F.col("r"))))


def _mirrored(half: DataFrame) -> DataFrame:
    """Both halves of a symmetric matrix from (row <= col, value), in the same rows."""
    both = F.when(F.col("row") == F.col("col"), F.array(F.struct("row", "col", "value"))).otherwise(F.array(F.struct("row", "col", "value"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"), "value")))
    return stages.exploded(half, both, TREE, row="_").select(TREE, "e.row", "e.col", "e.value")


def cophenetic(trees: DataFrame, unrooted: bool = False, lengths: bool = False) -> DataFrame:
    """(tree_id, row, col, value): path lengths between leaves.

    Unrooted, a path over the root lacks the branch above node 2k - 1 (for two branches or fewer it makes no difference).
    """
    p = _leaf_pairs(trees, lengths)
    depth = lambda c: F.get(F.col("depths"), F.col(c))
    length = depth("l") + depth("r") - 2 * depth("m")
    if unrooted:
        over = (F.col("k") >= 2) & (F.col("m") == 2 * F.col("k")) & (F.col("l") != F.col("r"))
        length = length - F.when(over, F.get(F.col("above"), 2 * F.col("k") - 1)).otherwise(0.0)
    value = F.when(F.col("l") == F.col("r"), 0.0).otherwise(length)
    return _mirrored(p.select(TREE, F.col("l").alias("row"), F.col("r").alias("col"), value.alias("value")))


def pairwise_distances(trees: DataFrame, metric: str = "cophenetic", unrooted: bool = False, lengths: bool = False) -> DataFrame:
    return {"cophenetic": cophenetic}[metric](trees, unrooted, lengths)


def vcv(trees: DataFrame, lengths: bool = False) -> DataFrame:
    """(tree_id, row, col, value): the depth of the leaves' common ancestor, on the diagonal the leaf's own."""
    p = _leaf_pairs(trees.where(F.size("v") > 0), lengths)
    return _mirrored(p.select(TREE, F.col("l").alias("row"), F.col("r").alias("col"), F.get(F.col("depths"), F.col("m")).alias("value")))


def incidence(trees: DataFrame) -> DataFrame:
    """(tree_id, edge, row, col, value): -1 at a branch's parent, 1 at its child; the column is the child's label."""
    e = stages.exploded(stages.edges(trees), "edges", TREE, row="edge")
    cells = F.array(F.struct(F.col("e.parent").alias("row"), F.lit(-1).alias("value")), F.struct(F.col("e.child").alias("row"), F.lit(1).alias("value")))
    return stages.exploded(e, cells, TREE, "edge", F.col("e.child").alias("col"), row="_", item="c").select(TREE, "edge", "c.row", "col", "c.value")


def _compressed(trees: DataFrame, by: str, other: str, pointers: Column) -> DataFrame:
    """indptr, indices and data of every tree, in the tree's own row: cells sorted by one axis, then the other."""
    cells = F.flatten(F.transform("edges", lambda e: F.array(F.struct(e["parent"].alias("row"), e["child"].alias("col"), F.lit(-1).alias("value")), F.struct(e["child"].alias("row"), e["child"].alias("col"), F.lit(1).alias("value")))))
    sorted_ = F.sort_array(F.transform(cells, lambda c: F.struct(c[by], c[other], c["value"])))
    t = stages.edges(trees).withColumn("cells", sorted_)
    return t.select(TREE, pointers.alias("indptr"), F.col(f"cells.{other}").alias("indices"), F.col("cells.value").alias("data"))


def incidence_csr(trees: DataFrame) -> DataFrame:
    """A leaf's row has one cell, an inner node's three, the root's two."""
    k = F.size("v")
    pointer = lambda n: F.when(n <= k + 1, n).when(n <= 2 * k, 3 * n - 2 * (k + 1)).otherwise(4 * k)
    return _compressed(trees, "row", "col", F.transform(F.sequence(F.lit(0), 2 * k + 1), pointer))


def incidence_csc(trees: DataFrame) -> DataFrame:
    """Every column has two cells."""
    return _compressed(trees, "col", "row", F.transform(F.sequence(F.lit(0), 2 * F.size("v")), lambda n: 2 * n))


def incidence_dense(trees: DataFrame) -> DataFrame:
    """(tree_id, row, cells): each row of the matrix as an array."""
    t = stages.edges(trees).withColumn("parents", F.transform(F.array_sort(F.transform("edges", lambda e: F.struct(e["child"], e["parent"]))), lambda e: e["parent"]))
    t = t.select(TREE, "parents", F.explode(F.sequence(F.lit(0), 2 * F.size("v"))).alias("row"))
    return t.select(TREE, "row", F.transform("parents", lambda p, child: F.when(p == F.col("row"), -1).when(child == F.col("row"), 1).otherwise(0)).alias("cells"))


def incidence_as(trees: DataFrame, kind: str = "coo") -> DataFrame:
    """One of coo, dok (one row a cell either way), csr, csc, dense."""
    made = {"coo": incidence, "dok": lambda t: incidence(t).select(TREE, "row", "col", "value"), "csr": incidence_csr, "csc": incidence_csc, "dense": incidence_dense}
    if kind not in made:
        raise ValueError(f"unknown format: {kind}")
    return made[kind](trees)


def pre_precision(trees: DataFrame, lengths: bool = False) -> DataFrame:
    """(tree_id, row, col, value): the Laplacian of branches weighted by 1 / length, without the root.

    A node's diagonal sums the branch above it and those below it, which its own row of the ancestry holds, so cells need no aggregation.
    """
    t = stages.lengths_above(trees.where(F.size("v") > 0), lengths)
    weight = lambda n: F.lit(1.0) / F.get(F.col("above"), n)
    k = F.size("v")
    below = lambda n: F.when(n > k, weight(F.get(F.col("rows"), n - k - 1)["c1"]) + weight(F.get(F.col("rows"), n - k - 1)["c2"])).otherwise(0.0)
    own = F.transform(F.sequence(F.lit(0), 2 * k - 1), lambda n: F.struct(n.alias("row"), n.alias("col"), (weight(n) + below(n)).alias("value")))
    inner = F.filter("edges", lambda e: e["parent"] < 2 * k)
    off = F.flatten(F.transform(inner, lambda e: F.array(F.struct(e["parent"].alias("row"), e["child"].alias("col"), (-weight(e["child"])).alias("value")), F.struct(e["child"].alias("row"), e["parent"].alias("col"), (-weight(e["child"])).alias("value")))))
    return stages.exploded(stages.edges(t), F.concat(own, off), TREE, row="_").select(TREE, "e.row", "e.col", "e.value")


def balance(trees: DataFrame) -> DataFrame:
    """(tree_id, n_leaves, sackin, variance, b2) of every tree."""
    d = F.col("depths")
    return stages.depths(trees).select(TREE, tr.n_leaves(F.col("v")).alias("n_leaves"), tr.sackin(d).alias("sackin"), tr.leaf_depth_variance(d).alias("variance"), tr.b2(d).alias("b2"))
