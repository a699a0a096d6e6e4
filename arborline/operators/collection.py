"""Tables of trees made from the driver's star schema; there are no trees in it, so vectors are derived from keys by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vector_from(keys: Column, a: int = 7919, b: int = 104729, c: int = 17) -> Column:
    """A valid vector from an array of keys: v[i] = (a * key + b * i + c) mod (2i + 1)."""
    return F.transform(keys, lambda x, i: ((x * a + i * b + c) % (2 * i + 1)).cast("int"))


def customer_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id (the customer), keys (the customer's orders), v and bls: a tree for each customer with orders.

    The only shuffle is by customer, and moves one key an order.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    keys = orders.groupBy(F.col("o_custkey").alias("tree_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    length = lambda x, a, c, m: ((x * a + c) % m + 1) / F.lit(100.0)
    bls = F.transform("keys", lambda x: F.struct(length(x, 31, 7, 97).alias("b1"), length(x, 17, 3, 89).alias("b2")))
    return keys.select("tree_id", "keys", vector_from(F.col("keys")).alias("v"), bls.alias("bls"))


def sampled_trees(ids: DataFrame, n: int, ordered: bool = False) -> DataFrame:
    """A tree of ``n`` leaves for each tree_id, the same in every run."""
    if n < 2:
        raise ValueError("a tree has two leaves or more")
    places = F.sequence(F.lit(0), F.lit(n - 2))
    v = F.transform(places, lambda i: (((F.col("tree_id") + 1) * (i * 7919 + 31) % 1000003 * 613 + i * 104729) % (i + 1 if ordered else 2 * i + 1)).cast("int"))
    return ids.withColumn("v", v)


def sample_vectors(spark: SparkSession, count: int, n: int, ordered: bool = False, seed: int = 0) -> DataFrame:
    """``count`` random trees of ``n`` leaves: v[i] uniform on 0..2i, or on 0..i for ordered ones."""
    if n < 2:
        raise ValueError("a tree has two leaves or more")
    draws = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: F.floor(F.rand(seed) * (i + 1 if ordered else 2 * i + 1)).cast("int"))
    return spark.range(count).select(F.col("id").alias("tree_id"), draws.alias("v"))


def sample_matrices(spark: SparkSession, count: int, n: int, ordered: bool = False, seed: int = 0) -> DataFrame:
    """The same with branch lengths uniform on (0, 1)."""
    bls = F.transform("v", lambda x: F.struct(F.rand(seed + 1).alias("b1"), F.rand(seed + 2).alias("b2")))
    return sample_vectors(spark, count, n, ordered, seed).withColumn("bls", bls)


def sample_trees(spark: SparkSession, count: int, n: int, topology_only: bool = False, ordered: bool = False, seed: int = 0) -> DataFrame:
    return sample_vectors(spark, count, n, ordered, seed) if topology_only else sample_matrices(spark, count, n, ordered, seed)
