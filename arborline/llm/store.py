"""Tables shared between the driver and all executors, and joins against tables of a checked size."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many rows and bytes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20
#: Copies of each row of a larger parameter table, so that a hot key meets many tasks.
SALTS = 64

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset, and in one local process (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="arborline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arborline-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """Collects the paths of the tables that are written inside and still there."""
    first, paths = len(_written), []
    yield paths
    paths += _written[first:]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the function it gives was called with: what the result reads."""
    first, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._table)
        return df

    yield keep
    done = [path for path in _written[first:] if path not in kept]
    _written[first:] = [path for path in _written[first:] if path in kept]
    delete(spark, done)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables once no result that reads them is needed."""
    conf = spark._jsc.hadoopConfiguration()
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def forget_all(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables by their paths."""
    _written[:] = [path for path in _written if path not in paths]
    delete(spark, list(paths))


def forget(df: DataFrame) -> None:
    """Delete a materialised table."""
    forget_all(df.sparkSession, [df._table])


def is_small(df: DataFrame) -> bool:
    """Whether a written table is within the broadcast bounds; it is counted, not estimated."""
    widths = [F.octet_length(F.col(f"`{c}`").cast("string")) for c in df.columns]
    width = sum((F.coalesce(w, F.lit(0)) for w in widths), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def join_params(left: DataFrame, params: DataFrame, key: str, salt: Column) -> DataFrame:
    """Inner join of ``left`` with one row of ``params`` a key (null equals null), where a key may hold a third of ``left``.

    ``params`` is broadcast if its counted size allows; else each of its rows is repeated SALTS times
    and ``left`` is dealt out by key and ``salt`` (a long column of ``left``).
    """
    if is_small(params):
        other = params.withColumnRenamed(key, "_key")
        return left.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    other = params.withColumnRenamed(key, "_key").withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = left.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    return salted.join(other, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_other"))).drop("_key", "_salt", "_other")
