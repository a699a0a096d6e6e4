"""Stages of a plan over a table of trees: each adds columns, row by row, without a shuffle.

A stage names its results by fixed columns (pairs, rows, depths, ...), so that later stages and the optimiser
see plain columns; Catalyst prunes what nothing reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import newick as nw
from ..functions import trees as tr


def exploded(df: DataFrame, column: str | Column, *keep: str | Column, row: str = "row", item: str = "e") -> DataFrame:
    """A row for each item of an array, with its place.

    An inner explode lets the optimiser infer a filter on the array and push it below all stages, where it would
    compute each of them again, nested; an outer one, and a filter on its place, don't.
    """
    return df.select(*keep, F.posexplode_outer(column).alias(row, item)).where(F.col(row).isNotNull())


def pairs(trees: DataFrame) -> DataFrame:
    return trees if "pairs" in trees.columns else trees.withColumn("pairs", tr.to_pairs(F.col("v")))


def ancestry(trees: DataFrame) -> DataFrame:
    return trees if "rows" in trees.columns else pairs(trees).withColumn("rows", tr.ancestry_of_pairs(F.col("pairs")))


def edges(trees: DataFrame) -> DataFrame:
    return ancestry(trees).withColumn("edges", tr.edges_of_ancestry(F.col("rows")))


def newick(trees: DataFrame, lengths: bool = False) -> DataFrame:
    """``newick`` from v, with the lengths of ``bls`` on request."""
    return pairs(trees).withColumn("newick", tr.newick_of_pairs(F.col("pairs"), F.col("bls") if lengths else None))


def depths(trees: DataFrame, lengths: bool = False) -> DataFrame:
    return ancestry(trees).withColumn("depths", tr.node_depths(F.col("rows"), F.col("bls") if lengths else None))


def lengths_above(trees: DataFrame, lengths: bool = False) -> DataFrame:
    return ancestry(trees).withColumn("above", tr.node_lengths(F.col("rows"), F.col("bls") if lengths else None))


def parents(trees: DataFrame) -> DataFrame:
    return ancestry(trees).withColumn("up", tr.parents(F.col("rows")))


def splits(trees: DataFrame) -> DataFrame:
    return ancestry(trees).withColumn("splits", tr.splits(F.col("rows")))


def sackin_with_leaf(trees: DataFrame) -> DataFrame:
    """``sackins``: the Sackin index of each tree with one leaf more on the branch above each of its nodes, by their labels."""
    t = depths(trees).withColumn("below", tr.leaves_below(F.col("rows")))
    return t.withColumn("sackins", tr.sackin_with_leaf(F.col("depths"), F.col("below")))


def vector_of_pairs(trees: DataFrame, column: str = "pairs", to: str = "v") -> DataFrame:
    return trees.withColumn(to, tr.from_pairs(F.col(column)))


def vector_of_rows(trees: DataFrame, column: str = "rows", to: str = "v") -> DataFrame:
    """v from ancestry rows in merge order."""
    return trees.withColumn("_least", tr.least_leaves(F.col(column))).withColumn(to, tr.from_pairs(F.col("_least"))).drop("_least")


def vector_of_edges(trees: DataFrame, column: str = "edges", to: str = "v") -> DataFrame:
    return vector_of_rows(trees.withColumn("_rows", tr.rows_of_edges(F.col(column))), "_rows", to).drop("_rows")


def vector_of_newick(trees: DataFrame, lengths: bool = False, column: str = "newick") -> DataFrame:
    """v (and bls) from integer Newick strings, with or without parents' labels; what isn't binary is an error."""
    text = F.col(column)
    checked = F.when(nw.is_binary(text) | (F.length(text) == 0), text).otherwise(F.raise_error(F.concat(F.lit("not a binary tree: "), text)).cast("string"))
    t = trees.withColumn("_tokens", nw.tokens(checked)).withColumn("_parsed", nw.parse(F.col("_tokens"), lengths)).withColumn("_named", nw.has_parents(text))
    t = t.withColumn("_sorted", nw.by_parent(F.col("_parsed"))).withColumn("_least", tr.least_leaves(F.col("_sorted")))
    t = t.withColumn("_order", tr.order_by_sister(F.col("_parsed"), lengths))
    unnamed = F.transform(F.col("_order"), lambda e: F.struct(e["c1"], e["c2"]))
    t = t.withColumn("_pairs", F.when(F.col("_named"), F.col("_least")).otherwise(unnamed)).withColumn("v", tr.from_pairs(F.col("_pairs")))
    if lengths:
        bare = F.transform(F.col("_order"), lambda e: F.struct(e["b1"], e["b2"]))
        t = t.withColumn("bls", F.when(F.col("_named"), nw.oriented(F.col("_sorted"), F.col("_least"))).otherwise(bare))
    return t.drop("_tokens", "_parsed", "_named", "_sorted", "_least", "_order", "_pairs")


def from_newick(trees: DataFrame, column: str = "newick") -> DataFrame:
    """v, and bls where a tree's string has branch lengths (else null): each row takes the parser that fits it."""
    text = F.col(column)
    has = nw.has_branch_lengths(text)
    # the other kind's rows are emptied, wherever the optimiser puts the filter
    kind = lambda keep, lengths: vector_of_newick(trees.where(keep).withColumn("_text", F.when(keep, text)), lengths, "_text").drop("_text")
    return kind(has, True).unionByName(kind(~has, False).withColumn("bls", F.lit(None).cast("array<struct<b1:double,b2:double>>")))


def without_leaf(trees: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``v`` without the leaf in column ``leaf``, and ``sister``."""
    t = ancestry(trees).withColumn("_cut", tr.without_leaf(F.col("rows"), F.col(leaf)))
    t = t.withColumn("_l", tr.least_leaves(F.col("_cut.rows"))).withColumn("sister", F.col("_cut.sister")).withColumn("_o", tr.order_by_sister(F.col("_l")))
    t = t.withColumn("v", tr.from_pairs(F.transform(F.col("_o"), lambda e: F.struct(e["c1"], e["c2"]))))
    return t.drop("_cut", "_l", "_o", "rows", "pairs")


def with_leaf(trees: DataFrame, leaf: str = "leaf", branch: str = "branch") -> DataFrame:
    """``v`` with a leaf labelled by column ``leaf`` on the branch in column ``branch``."""
    t = trees.withColumn("_v", F.array_append("v", F.col(branch))).withColumn("_p", tr.to_pairs(F.col("_v"))).withColumn("_r", tr.ancestry_of_pairs(F.col("_p")))
    t = t.withColumn("_n", tr.relabelled(F.col("_r"), F.col(leaf))).withColumn("_l", tr.least_leaves(F.col("_n"))).withColumn("_o", tr.order_by_sister(F.col("_l")))
    t = t.withColumn("v", tr.from_pairs(F.transform(F.col("_o"), lambda e: F.struct(e["c1"], e["c2"]))))
    return t.drop("_v", "_p", "_r", "_n", "_l", "_o", "rows", "pairs")
