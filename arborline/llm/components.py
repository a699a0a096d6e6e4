"""Connected components of a table of links by alternating stars.

Large star: every node links its larger neighbours to the smallest node it sees; small star: its smaller ones.
Each round is two joins, whose sides adaptive execution may split at a hot node, and writes what it made; the
rounds end when the links no longer change, which takes a few for links that are stars already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, materialize, scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    moved = e.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("w", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) longs -> (node, root): the smallest node of each linked node's component."""
    spark = links.sparkSession
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    with scratch(spark) as keep:
        e = keep(materialize(e, "links"))
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, before = now, e
        with scratch(spark) as keep:
            e = keep(materialize(_small(materialize(_large(e), "stars")), "links"))
        forget(before)
