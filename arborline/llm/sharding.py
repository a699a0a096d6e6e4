"""Sharding by a hierarchical weighted hash tree, in DataFrame functions.

A topology has regions, racks in them and shards in racks; a node weighs what its shards weigh. At each
level a row draws ln(u) / weight for every child, u in (0, 1) from a hash of the row's key and the child's
name, and goes to the largest. A draw depends on its own child alone: if a subtree's weight changes, rows
move only into it or out of it, never between others. A grown cluster gets a region of its own, so that
the new shard takes rows only into itself.

Defined results: a null id hashes as null (all such rows meet in one shard); a null text has size 1 and the
CRC-32 of no bytes; repeated rows share a shard and have slots of their own; an empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import is_small, materialize

#: (region, rack, shard, weight): eight equal shards in two regions of two racks each.
TOPOLOGY = [(s // 4, s // 2, s, 1.0) for s in range(8)]
GROWN = [*TOPOLOGY, (2, 4, 8, 1.0)]


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}{child}")), 11)
    return F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _best(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the largest draw (of equal draws the largest name)."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_max(F.array(*[F.struct(_draw(key, level, c, w).alias("d"), F.lit(c).alias("c")) for c, w in sorted(children.items())]))["c"]


def place(key: Column, topology: list[tuple[int, int, int, float]]) -> Column:
    """The shard of a key: region, then rack, then shard."""

    def sums(rows, at):
        out: dict[int, float] = {}
        for row in rows:
            out[row[at]] = out.get(row[at], 0.0) + row[3]
        return out

    def descend(rows, at):
        level = ("region", "rack", "shard")[at]
        children = sums(rows, at)
        best = _best(key, level, children)
        if at == 2:
            return best
        out = F.lit(None)
        for child in sorted(children):
            out = F.when(best == child, descend([r for r in rows if r[at] == child], at + 1)).otherwise(out)
        return out

    return descend([r for r in topology if r[3] > 0], 0).cast("int")


def shard(docs: DataFrame, topology=tuple(TOPOLOGY), grown=tuple(GROWN)) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Slots number the rows of a shard without gaps: the rows are written once with the number of the
    partition that held them, counted by partition and shard, and numbered from the sums of those before.
    """
    key = F.col("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        place(key, list(topology)).alias("shard"), place(key, list(grown)).alias("grown_shard"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth"),
    )
    rows = materialize(rows, "shards")
    counts = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "offsets")
    offsets = F.broadcast(offsets) if is_small(offsets) else offsets
    inside = Window.partitionBy("shard", "part").orderBy("nth")
    numbered = rows.withColumn("n", F.row_number().over(inside)).join(offsets, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")
