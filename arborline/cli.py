"""``python -m arborline.cli``: samplev, samplem, to_newick, from_newick."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import newick as nw
from .operators import collection, kernels
from .sources import files


def _spark() -> SparkSession:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _array_text(row) -> str:
    if row["bls"] is None:
        return ",".join(map(str, row["v"]))
    return "\n".join(f"{float(x)},{b['b1']},{b['b2']}" for x, b in zip(row["v"], row["bls"], strict=True))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="arborline", description="Sample and convert trees.")
    commands = parser.add_subparsers(dest="command")
    for name in ("samplev", "samplem"):
        p = commands.add_parser(name, help="sample a vector" if name == "samplev" else "sample a matrix")
        p.add_argument("n_leaves", type=int)
        p.add_argument("--ordered", action="store_true")
        p.add_argument("--count", type=int, default=1)
        p.add_argument("--seed", type=int, default=0)
    for name, what in (("to_newick", "numbers by commas, a row a line for a matrix"), ("from_newick", "a Newick string")):
        commands.add_parser(name, help=what).add_argument("tree", help=what)
    a = parser.parse_args(args)
    if a.command is None:
        parser.print_help()
        return 0
    spark = _spark()
    if a.command in ("samplev", "samplem"):
        made = (collection.sample_vectors if a.command == "samplev" else collection.sample_matrices)(spark, a.count, a.n_leaves, a.ordered, a.seed)
        made = made if "bls" in made.columns else made.withColumn("bls", F.lit(None).cast("array<struct<b1:double,b2:double>>"))
        for row in made.toLocalIterator():
            print(_array_text(row))
    elif a.command == "to_newick":
        text = a.tree.replace("\\n", "\n")
        t = files.read_array(spark.createDataFrame([(0, text)], "tree_id int, value string"))
        row = t.select("tree_id", "v", "bls").first()
        print(kernels.newick(row["v"], None if row["bls"] is None else [(b["b1"], b["b2"]) for b in row["bls"]]))
    else:
        lengths = spark.range(1).select(nw.has_branch_lengths(F.lit(a.tree))).first()[0]
        v, bls = kernels.from_newick(a.tree)
        print(_array_text({"v": v, "bls": [{"b1": x, "b2": y} for x, y in bls] if lengths else None}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
