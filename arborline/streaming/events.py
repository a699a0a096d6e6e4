"""Trees on streams: per-row functions run unchanged, sets of a window's keys become trees, and splits meet a static tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trees as tr
from ..operators.collection import vector_from
from ..plans import stages


def window_trees(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(user_id, window, tree_id, v): a tree for each user and window of events, from their ids; works on batches and streams.

    State is held until the watermark passes a window's end.
    """
    held = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("window")).agg(F.sort_array(F.collect_list("event_id")).alias("keys"))
    return held.select("user_id", "window", F.col("user_id").alias("tree_id"), vector_from(F.col("keys")).alias("v"))


def balance(trees: DataFrame, *keep: str) -> DataFrame:
    """Balance of a stream of trees, a stateless projection."""
    d = F.col("depths")
    return stages.depths(trees).select(*keep, tr.n_leaves(F.col("v")).alias("n_leaves"), tr.sackin(d).alias("sackin"), tr.b2(d).alias("b2"))


def distance_to(trees: DataFrame, reference: DataFrame) -> DataFrame:
    """Robinson-Foulds distance of each tree of a stream to the static tree of its size in ``reference`` (v): a stream-static join."""
    fixed = stages.splits(reference).select(F.size("v").alias("_k"), F.col("splits").alias("_splits"))
    own = stages.splits(trees).withColumn("k", F.size("v"))
    return own.join(fixed, F.col("k") == F.col("_k")).select("tree_id", "k", tr.robinson_foulds(F.col("splits"), F.col("_splits")).alias("rf"))
