"""All pairs of the rows of a key, compared block by block in Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes a block holds at most (one row at least), and blocks that a key of many rows is cut into at least.
ROWS, BYTES, SPREAD = 2048, 1 << 23, 16

#: Pairs an Arrow batch on its way out holds at most.
BATCH = 1 << 16

#: Tasks at most.
TASKS = 2048


def all_pairs(rows: DataFrame, key: str, name: str, payload: list[str], weight: Column, columns: str, compare: Callable[[pa.Table, pa.Table], list[tuple[np.ndarray, np.ndarray | None]]], keyed: bool = True) -> DataFrame:
    """([key,] x, y, ...) for x < y of the names of a key, with the ``columns`` (a schema of doubles) that ``compare`` finds.

    ``compare`` takes two blocks (``name`` and ``payload``) and returns for each column a matrix of values, with one of
    what is null in it, or None. Rows are dealt to blocks by a hash of the name, as many as their number and ``weight``
    (bytes) ask for, so a block is bounded, and so is a task's memory; a row travels once for each block of its key.
    Rows without a key or a name have no pairs.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(name).isNotNull())
    n = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(n / ROWS), F.least(F.lit(SPREAD), F.ceil(n / 256)), F.ceil(F.sum(weight) / BYTES)).cast("int")
    counted = rows.groupBy(F.col(key).alias("_key")).agg(blocks.alias("_n"))
    groups = counted.agg(F.sum(F.col("_n").cast("long") * (F.col("_n") + 1) / 2)).first()[0] or 1
    dealt = rows.join(counted, F.col(key) == F.col("_key")).withColumn("_own", F.pmod(F.xxhash64(name), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # a repartition by number isn't coalesced, as few bytes here are many pairs
    group = [key, "_i", "_j"]
    dealt = dealt.select(key, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", name, *payload).repartition(int(min(2 * groups, TASKS)), *group)
    kind, id_ = rows.schema[key].dataType.simpleString(), rows.schema[name].dataType.simpleString()
    names = [*([key] if keyed else []), "x", "y", *(c.strip().split(" ")[0] for c in columns.split(","))]

    def run(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(whole)).combine_chunks()
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        left = table.filter(pc.equal(table.column("_own"), i))
        right = left if i == j else table.filter(pc.equal(table.column("_own"), j))
        if not (len(left) and len(right)):
            return
        of = table.column(key).combine_chunks()
        both = pa.concat_arrays([t.column(name).combine_chunks() for t in (left, right)])
        rank = pc.rank(both, tiebreaker="dense").to_numpy().astype(np.int64)
        here, there = np.arange(len(left), dtype=np.int32)[:, None], np.arange(len(left), len(both), dtype=np.int32)[None]
        found = compare(left, right)
        step = max(1, BATCH // len(right))
        for at in range(0, len(left), step):
            part = slice(at, at + step)
            up = rank[: len(left)][part, None] < rank[None, len(left) :]
            # names of two blocks differ; inside a block each pair stands twice, and equal names are no pair
            cut = np.ravel if i != j else lambda m: m[up]  # noqa: B023
            pairs = [both.take(pa.array(cut(np.where(up, x, y)))) for x, y in ((here[part], there), (there, here[part]))]
            values = [pa.array(cut(m[part]), pa.float64(), mask=None if null is None else cut(null[part])) for m, null in found]
            keys = [of.take(pa.array(np.zeros(len(pairs[0]), np.int32)))] if keyed else []
            yield pa.RecordBatch.from_arrays([*keys, *pairs, *values], names)

    return dealt.groupBy(*group).applyInArrow(run, (f"`{key}` {kind}, " if keyed else "") + f"x {id_}, y {id_}, {columns}")
