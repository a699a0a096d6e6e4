"""Corpus preparation in five stages, each written as Parquet and read again as the next one's documents.

Defined results, for each stage, besides those its operator states: an empty table stays empty; columns of other names
go along; repeated rows go with their documents, but for near-dedup, which leaves one. Null and empty texts are rejected
by the quality rules, as texts of fewer than ten words are; a text that is cut to nothing has no words, so the mix
doesn't take it; a null id or source is kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborline.llm import bpe, mixing, nearset, quality, repeats, store

#: Settings for plans with large literals.
SHORT = {"spark.sql.debug.maxToStringFields": "0", "spark.sql.maxPlanStringLength": str(1 << 16)}


def _stage(work):
    return lambda spark, docs, sf_dir: work(docs)


def _drop_near(docs: DataFrame) -> DataFrame:
    """Near copies go by sets of five words; op5's four are its own contract."""
    return nearset.drop_near_duplicates(docs, k=5)


def _cut(docs: DataFrame) -> DataFrame:
    """Repeated passages go; n_chars follows the text."""
    out = repeats.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def _short_plans(docs: DataFrame) -> DataFrame:
    """``docs`` in a copy of its session where the texts of plans, which the driver keeps, have no fields (and no literals) and are cut."""
    spark = docs.sparkSession
    copy = spark._jsparkSession.cloneSession()
    for name, value in SHORT.items():
        copy.conf().set(name, value)
    plan = docs._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, plan), SparkSession(spark.sparkContext, copy))


def _tokens(docs: DataFrame) -> DataFrame:
    """Ranked merges are folded by higher-order functions, as in op10, with a smaller dictionary for the driver's memory.

    A plan's text is 11 MB with the ranks, made anew at each change of the plan and kept for each run, so it is kept short.
    """
    return bpe.encode_digest(_short_plans(docs), size=1 << 16)


STAGES = [
    ("quality rules", _stage(quality.keep_good)),
    ("minhash near-dedup", _stage(_drop_near)),
    ("suffix-array dedup", _stage(_cut)),
    ("mixing", _stage(mixing.mix_documents)),
    ("bpe", _stage(_tokens)),
]

#: Signatures, suffix arrays and ranked merges have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{store.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, work) in enumerate(STAGES):
        with store.recording() as tables:
            made = work(spark, docs, sf_dir)
            made.write.parquet(f"{top}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{top}/{k}")
        # what the stage read and wrote on the way goes, once its result is there
        store.forget_all(spark, [*tables, *([f"{top}/{k - 1}"] if k else [])])
    return docs
