"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the
others as named users; the loss mask covers the assistant's own words. The rendering is returned in pieces,
a row for each turn with its place in characters: joined in order of seq, they are the dialogue. So no
conversation, however long, has to fit into one row or task: places are sums over ranges of turns.

Defined results: turns are ordered by (turn, role, text), nulls first; repeated rows are rendered as often
as they occur; a null text is empty; a null role is a participant without a name, unlike any that has one (speaker
and name are null); narrators ("system") are nobody's perspective and keep their role; a conversation of narrators only
gives no rows; a null conv_id is a conversation of its own; an empty table gives no rows. In texts and names a bracket
"<|" is written with one more backslash between its two characters than it has, so no text can pass for a header or an
end, and reading back takes one away. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

NARRATORS = ("system",)
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def rotate(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """conv_id, speaker, seq, turn, role, name, piece, start, end, loss_start, loss_end for every perspective and turn."""
    spark = turns.sparkSession
    order = ["conv_id", "turn", "author", "text"]
    said = turns.select("conv_id", "turn", F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.groupBy(*order).agg(F.count(F.lit(1)).alias("times"))
    # ranges of turns: a hot conversation spreads over many, a range holds many short ones
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    said = said.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id())
    said = materialize(said, "turns")
    narrator = F.coalesce(F.col("author").isin(*narrators), F.lit(False))
    speakers = said.where(~narrator).select(F.col("conv_id").alias("_conv"), F.col("author").alias("speaker")).distinct()
    # a hot conversation meets its speakers once a part
    held = said.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p")).distinct()
    speakers = held.join(speakers, F.col("_c").eqNullSafe(F.col("_conv"))).drop("_conv")
    seen = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).drop("_c", "_p")
    own = F.col("author").eqNullSafe(F.col("speaker"))
    role = F.when(narrator, F.col("author")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when((role == "user") & F.col("author").isNotNull(), F.concat(F.lit(" name="), escaped(F.col("author")))).otherwise(F.lit(""))
    head = F.concat(F.lit("<|"), role, name, F.lit("|>\n"))
    seen = seen.withColumns({"role": role, "head": head, "own": own, "said": escaped(F.col("text"))}).withColumn("piece", F.concat("head", "said", F.lit(END)))
    seen = seen.withColumn("chars", F.length("piece").cast("long"))
    group = ["conv_id", "speaker", "part"]
    sums = seen.groupBy(*group).agg(F.sum(F.col("times") * F.col("chars")).alias("c"), F.sum("times").alias("t"))
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in group], F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"))
    run = Window.partitionBy(*group).orderBy(F.col("turn").asc_nulls_first(), F.col("author").asc_nulls_first(), "text").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumns({"c1": F.coalesce(F.sum(F.col("times") * F.col("chars")).over(run), F.lit(0)), "t1": F.coalesce(F.sum("times").over(run), F.lit(0))})
    matched = F.lit(True)
    for c in group:
        matched &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = seen.join(sums, matched).withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    start = F.col("c0") + F.col("c1") + F.col("again") * F.col("chars")
    placed = placed.withColumn("start", start)
    said_at = F.col("start") + F.length("head")
    return placed.select(
        "conv_id", "speaker", (F.col("t0") + F.col("t1") + F.col("again")).alias("seq"), "turn", "role", F.col("author").alias("name"), "piece", "start",
        (F.col("start") + F.col("chars")).alias("end"), F.when(F.col("own"), said_at).alias("loss_start"), F.when(F.col("own"), said_at + F.length("said")).alias("loss_end"),
    )
