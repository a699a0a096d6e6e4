"""Mixing sources to target weights by nested hash thresholds.

Each document draws a 52-bit hash of its id and text. Sizes are summed by source and hash bucket; the budget of
a source falls into one bucket, which alone is refined (twelve bits, twelve more, then single hashes).
Documents below the threshold are taken once more than the others; nothing is sorted, and a larger
budget takes all that a smaller one takes. Rows that share the draw at the threshold (repeated rows) are numbered,
and as many of them are taken as the budget has room for.

Targets: sources are ranked in ranges, and the common level is found from histograms of size by weight, of which the
driver sees at most SLICES rows at a time, so any number of sources will do.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last
in order; a null id or text hashes as the empty string; which of several equal rows are taken makes no difference to
the rows of the mix; an empty table gives an empty mix. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import join_params, materialize, scratch

WORD = r"[^\x20\x09-\x0D]+"
DRAW_BITS, STEP_BITS = 52, 12
#: A target stops at so many times its source's size.
MOST = 3
#: Slices of a histogram of sources, and the most distinct ratios that are listed one by one.
SLICES = 1024


def draw(doc_id="doc_id", text="text"):
    """52 bits of the MD5 of the id and the text."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("long")


def size_of(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(rows: DataFrame, order: list[Column], *key: str) -> DataFrame:
    """``n``: the number of each row, from 0, by ``part`` and then ``order``, for each value of the key columns; no part has to fit a task with another."""
    rows = materialize(rows, "numbered")
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key, "part").count()
    offsets = counts.select(*[F.col(c).alias(f"_{c}") for c in (*key, "part")], F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key, "part").orderBy(*order)) - 1)
    on = F.lit(True)
    for c in (*key, "part"):
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return inside.join(offsets, on).withColumn("n", F.col("_first") + F.col("n")).drop("part", "_part", "_first", *[f"_{c}" for c in key])


def _level(ratios: DataFrame) -> float | None:
    """(ratio, s, w: sums of the sources with that size by weight) -> the level at which the first source doesn't overflow."""
    total, weight = ratios.agg(F.sum("s"), F.sum("w")).first()
    if not total:
        return None
    before, low, high, found = 0, None, None, None
    while True:
        # the first ratio that doesn't overflow is in [low, high), or it is high, whose level is found
        inside = ratios if low is None else ratios.where(F.col("ratio") >= low)
        inside = inside if high is None else inside.where(F.col("ratio") < high)
        n, a, b = inside.agg(F.count(F.lit(1)), F.min("ratio"), F.max("ratio")).first()
        if n > SLICES:
            inside = inside.groupBy(F.floor((F.col("ratio") - a) / (b - a) * SLICES)).agg(F.min("ratio").alias("ratio"), F.sum("s").alias("s"), F.sum("w").alias("w"))
        start, at, left = (before, weight, a), before, weight
        for r in inside.orderBy("ratio").collect():
            level = float(total - MOST * at) / left
            if MOST * r["ratio"] > level:
                high, found = r["ratio"], level
                break
            start = (at, left, r["ratio"])
            at, left = at + r["s"], left - r["w"]
        if n <= SLICES or high == a:
            return found
        before, weight, low = start


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> the same with target: weights 1, 2, 3 by rank, filled up to MOST times the size.

    In order of size by weight, sources that would overflow at the common level stop at their limit and
    leave the rest to the others; the first that doesn't overflow fixes the level of all after it.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_name = F.col("source").asc_nulls_last()
    dealt = sizes.select("source", "source_size").repartitionByRange(parts, by_name).withColumn("part", F.spark_partition_id())
    ranked = _numbered(dealt.withColumn("all", F.lit(0)), [by_name], "all").drop("all")
    w = materialize(ranked.select("source", "source_size", (F.col("n") % 3 + 1).alias("w")), "weights")
    ratios = w.groupBy((F.col("source_size") / F.col("w")).alias("ratio")).agg(F.sum("source_size").alias("s"), F.sum("w").alias("w"))
    level = _level(materialize(ratios, "ratios"))
    most = (F.col("source_size") * MOST).cast("double")
    common = F.lit(level) * F.col("w")
    target = most if level is None else F.when(F.col("source_size") * MOST <= common, most).otherwise(common)
    return w.select("source", "source_size", target.alias("target"))


def _refine(rows: DataFrame, params: DataFrame, shift: int) -> DataFrame:
    """One level: move each source's threshold to the bucket of 2**shift draws that its budget falls into.

    ``params`` has source, low (draws below it are taken) and room (the words still to take from low on).
    """
    inside = join_params(rows, params.select("source", "low", "high"), "source", F.col("draw"))
    inside = inside.where((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")))
    sums = inside.groupBy("source", F.shiftright("draw", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.max("size").alias("one"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).withColumnRenamed("source", "_s")
    # at the last level rows are taken while their middle is within the room, so the mix ends near the budget
    middle = F.col("before") + F.col("words") - (F.col("one") / 2 if shift == 0 else F.lit(0))
    joined = params.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
    over = F.when((middle > F.col("room")) & (F.col("words") > 0), F.struct(F.col("bucket"), F.col("before")))
    first = joined.groupBy("source", "source_size", "target", "copies", "low", "high", "room").agg(F.min(over).alias("first"))
    low = F.when(F.col("first").isNull(), F.col("high")).otherwise(F.greatest(F.col("low"), F.shiftleft(F.col("first.bucket"), shift)))
    high = F.when(F.col("first").isNull(), F.col("high")).otherwise(F.shiftleft(F.col("first.bucket") + 1, shift))
    room = F.col("room") - F.coalesce(F.col("first.before"), F.lit(0))
    return materialize(first.select("source", "source_size", "target", "copies", low.alias("low"), high.alias("high"), room.alias("room")), f"mix{shift}")


def mix_params(rows: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw) -> a row for each source: copies all its documents get, the draw below which they get one more, and the room left for those at it."""
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = source_targets(sizes)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    params = targets.withColumn("copies", copies).withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(1 << DRAW_BITS).cast("long"))
    params = materialize(params.withColumn("room", F.col("target") - F.col("copies") * F.col("source_size")), "targets")
    for shift in (DRAW_BITS - STEP_BITS, DRAW_BITS - 2 * STEP_BITS, 0):
        params = _refine(rows, params, shift)
    return materialize(params.select("source", "source_size", "target", "copies", F.col("low").alias("below"), "room"), "params")


def _place() -> list[Column]:
    """Where a row is read, to number repeated ones."""
    return [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")]


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "source", size_of().alias("size"), draw().alias("draw"), *_place())
    return materialize(rows, "sizes")


def _copies(joined: DataFrame) -> DataFrame:
    """``n``: how often each row (draw, size, part, nth, and its source's parameters) is taken."""
    base = F.col("copies")
    clear = joined.where(F.col("draw") != F.col("below")).withColumn("n", base + F.when(F.col("draw") < F.col("below"), 1).otherwise(0)).drop("part", "nth")
    edge = _numbered(joined.where(F.col("draw") == F.col("below")), [F.col("nth")], "source")
    more = F.when(F.col("n") * F.col("size") + F.col("size") / F.lit(2.0) <= F.col("room"), 1).otherwise(0)
    return clear.unionByName(edge.withColumn("n", base + more).drop("nth"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of every document."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(_rows(docs))
        params = keep(mix_params(rows))
    taken = _copies(join_params(rows, params, "source", F.col("draw")))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the documents' own columns, each document as many times as it is taken; wordless ones go."""
    with scratch(docs.sparkSession) as keep:
        params = keep(mix_params(_rows(docs)))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", size_of().alias("size"), draw().alias("draw"), *_place())
    taken = _copies(join_params(inner.where("size > 0"), params, "source", F.col("draw"))).where("n > 0")
    repeated = taken.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
