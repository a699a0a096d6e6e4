"""The queries of the corpus operators and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, licenses, mixing, nearset, quality, repeats, sharding, urls, vectors
from .sql import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(table: str, f):
    return lambda spark, sf_dir: f(_table(spark, sf_dir, table))


QUERIES = {
    "op1_mixing": _on("documents", mixing.mix_plan),
    "op2_chat": _on("conversations", chat.rotate),
    "op3_licenses": _on("documents", licenses.license_report),
    "op4_repeats": _on("documents", repeats.repeat_report),
    "op5_nearset": _on("documents", nearset.component_report),
    "op6_sharding": _on("documents", sharding.shard),
    "op7_quality": _on("documents", quality.quality_report),
    "op8_urls": _on("pages", urls.filter_report),
    "op9_vectors": _on("embeddings", vectors.vector_report),
    "op10_bpe": _on("documents", bpe.encode_digest),
}

__all__ = ["QUERIES", "SQL"]
