"""A query for each tree operator over trees of the driver's tables, and the same as DuckDB SQL.

The queries evaluate trees in place, row by row; the SQL goes another way, by recursion, windows and self-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import newick as nw
from .functions import trees as tr
from .operators import compare, kernels, likelihood, relations
from .operators.collection import customer_trees, sampled_trees, vector_from
from .plans import stages
from .sources import files

C = F.col


def _joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    # adding zero makes -0.0 and 0.0 alike
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _suppliers(spark, sf_dir):
    return sampled_trees(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(C("s_suppkey").alias("tree_id")), 10)


def _alternative(spark, sf_dir):
    """Customer trees with a second vector w from the same keys."""
    return customer_trees(spark, sf_dir).withColumn("w", vector_from(C("keys"), 104729, 7919, 5))


def _candidates(spark, sf_dir):
    """Vectors of which some are out of bounds."""
    x = F.transform("keys", lambda x, i: ((x * 31 + i * 7) % (2 * i + 1 + F.when(x % 11 == 0, 1).otherwise(0))).cast("int"))
    return customer_trees(spark, sf_dir).withColumn("v", x)


def _named(spark, sf_dir):
    """Newick strings with names on the leaves and, for odd customers, no parents' labels."""
    t = stages.newick(customer_trees(spark, sf_dir), True)
    names = F.map_from_arrays(F.sequence(F.lit(0), F.size("v")), F.transform(F.sequence(F.lit(0), F.size("v")), lambda i: F.concat(F.lit("taxon_"), (C("tree_id") + i * 7).cast("string"))))
    t = t.withColumn("pieces", nw.label_pieces(C("newick"))).withColumn("names", names).withColumn("named", nw.named(C("pieces"), C("names")))
    return t


def _node(modulus):
    return (C("tree_id") * 7 + 3) % modulus


def q_balance(spark, sf_dir):
    return _rounded(relations.balance(customer_trees(spark, sf_dir)), "variance", "b2").select("tree_id", "n_leaves", "sackin", "variance", "b2")


def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of customers' trees by market segment and overall."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    b = relations.balance(customer_trees(spark, sf_dir)).join(customers, C("tree_id") == C("c_custkey"))
    out = b.rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("trees"), F.sum("sackin").alias("sackin"), F.round(F.avg("variance"), 6).alias("variance"), F.round(F.avg("b2"), 6).alias("b2"))
    return out.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "trees", "sackin", "variance", "b2")


def _vector(df: DataFrame) -> DataFrame:
    return df.select("tree_id", _joined(C("v")).alias("v"))


def _lengths(df: DataFrame) -> DataFrame:
    return stages.exploded(df, "bls", "tree_id").select("tree_id", "row", "e.b1", "e.b2")


def _compressed(df: DataFrame) -> DataFrame:
    return df.select("tree_id", *[_joined(C(c)).alias(c) for c in ("indptr", "indices", "data")])


def _on(f):
    return lambda spark, sf_dir: f(customer_trees(spark, sf_dir))


def _bare(t):
    return stages.newick(t, True).withColumn("newick", nw.remove_parent_labels(C("newick"))).drop("v", "bls", "pairs")


def _fasta(spark, sf_dir):
    """Names of parts as bases, through FASTA text."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    seq = F.translate(F.upper("p_name"), "BDEFHIJKLMNOPQRSUVWXYZ0123456789 #-_", "ACGTACGTACGTACGTACGTACACGTACGTACGTAC")
    record = F.concat(F.lit("part"), C("p_partkey").cast("string"), F.lit(" a part\n"), F.substring(seq, F.lit(1), F.lit(5)), F.lit("\n"), F.substring(seq, F.lit(6), F.length(seq)), F.lit("\n"))
    return files.fasta_records(part.select(record.alias("value")))


def _alignment(spark, sf_dir):
    """A sequence a supplier, all of one length, from its key."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    base = lambda i: F.substring(F.lit("acgt"), ((C("s_suppkey") * (i % 5 + 1) + (i * i) % 7 + F.floor(C("s_suppkey") / (i + 1))) % 4 + 1).cast("int"), F.lit(1))
    return s.select(F.concat(F.lit("s"), C("s_suppkey").cast("string")).alias("taxon"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), base), "").alias("seq"))


def q_jc69(spark, sf_dir):
    """Customers' trees scored on alignments of their own, made from their keys."""
    t = stages.ancestry(customer_trees(spark, sf_dir)).withColumn("alignment_id", C("tree_id"))
    site = lambda leaf: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda s: F.substring(F.lit("acgt-"), ((C("tree_id") * 3 + leaf * (s % 4 + 1) + s * s) % 5 + 1).cast("int"), F.lit(1)))
    leaves = t.select("alignment_id", "tree_id", F.explode(F.sequence(F.lit(0), F.size("v"))).alias("leaf"))
    alignment = leaves.select("alignment_id", "leaf", F.array_join(site(C("leaf")), "").alias("seq"))
    return likelihood.jc69(t, likelihood.patterns(alignment)).select("tree_id", F.round("loglik", 5).alias("loglik"))


def q_bme(spark, sf_dir):
    """Balanced minimum evolution score of each tree: ln of the sum of d_ij / 2^p_ij over ordered pairs, d from leaf numbers."""
    p = relations.cophenetic(customer_trees(spark, sf_dir), unrooted=True).where("row <> col")
    d = (F.pmod(C("row") * C("col") * 31 + C("row") + C("col"), F.lit(97)) + 1) / F.lit(10.0)
    return p.groupBy("tree_id").agg(F.round(F.ln(F.sum(d * F.pow(F.lit(2.0), -C("value")))), 6).alias("score"))


def q_nni(spark, sf_dir):
    """One step of hill climbing: of all other values of the last place of v, the one with the smallest Sackin index."""
    t = customer_trees(spark, sf_dir).where(F.size("v") > 1).select("tree_id", F.element_at("v", -1).alias("last"), F.slice("v", F.lit(1), F.size("v") - 1).alias("v"))
    tried = stages.sackin_with_leaf(t).withColumn("tried", F.filter(F.transform("sackins", lambda s, x: F.struct(s.alias("sackin"), x.alias("x"))), lambda e: e["x"] != C("last")))
    return tried.select("tree_id", F.array_min("tried").alias("m")).select("tree_id", "m.sackin", "m.x")


def q_rerooted(spark, sf_dir):
    t = customer_trees(spark, sf_dir).select("tree_id", "v", _node(2 * F.size("v")).cast("int").alias("node"))
    return _vector(kernels.rerooted(t))


def q_precision(spark, sf_dir):
    return _rounded(kernels.precisions(customer_trees(spark, sf_dir), True), "value")


def q_precision_identity(spark, sf_dir):
    """Precision times covariance of every tree, which is the identity."""
    return _rounded(kernels.precision_products(customer_trees(spark, sf_dir), True), "value")


def q_leaf_round_trip(spark, sf_dir):
    """A leaf taken from each tree and put back beside its sister, which gives the tree again."""
    t = customer_trees(spark, sf_dir).where(F.size("v") > 1).withColumn("leaf", _node(F.size("v") + 1).cast("int"))
    cut = stages.without_leaf(t).withColumn("branch", C("sister") - (C("sister") >= C("leaf")).cast("int"))
    return _vector(stages.with_leaf(cut))


def q_reroot_distance(spark, sf_dir):
    """Distance of each tree to itself rerooted, which is 0: splits don't know the root."""
    t = customer_trees(spark, sf_dir).select("tree_id", "v")
    moved = kernels.rerooted(t.withColumn("node", _node(2 * F.size("v")).cast("int"))).select(C("tree_id").alias("t"), C("v").alias("w"))
    return compare.robinson_foulds(t.join(moved.hint("merge"), C("tree_id") == C("t"))).select("tree_id", "rf")


QUERIES = {
    "segment_balance": q_segments,
    "to_pairs": _on(relations.pairs),
    "from_pairs": _on(lambda t: _vector(stages.vector_of_pairs(stages.pairs(t).drop("v")))),
    "to_ancestry": _on(relations.ancestry),
    "from_ancestry": _on(lambda t: _vector(stages.vector_of_rows(stages.ancestry(t).drop("v", "pairs")))),
    "to_edges": _on(relations.edges),
    "from_edges": _on(lambda t: _vector(stages.vector_of_edges(stages.edges(t).select("tree_id", "edges")))),
    "to_newick": _on(lambda t: stages.newick(t).select("tree_id", "newick")),
    "to_newick_bl": _on(lambda t: stages.newick(t, True).select("tree_id", "newick")),
    "to_newick_kernel": _on(lambda t: kernels.newicks(t, True, large=8)),
    "from_newick": _on(lambda t: _vector(stages.vector_of_newick(stages.newick(t).select("tree_id", "newick")))),
    "from_newick_noparents": _on(lambda t: _vector(stages.vector_of_newick(_bare(t).withColumn("newick", nw.remove_branch_lengths(C("newick")))))),
    "from_newick_kernel": _on(lambda t: _vector(kernels.vectors(stages.newick(t).select("tree_id", "newick"), large=8))),
    "from_newick_bl": _on(lambda t: _lengths(stages.vector_of_newick(stages.newick(t, True).select("tree_id", "newick"), True))),
    "from_newick_bl_noparents": _on(lambda t: _lengths(stages.vector_of_newick(_bare(t), True))),
    "check_v": lambda spark, sf_dir: _candidates(spark, sf_dir).select("tree_id", tr.is_valid(C("v")).alias("valid")),
    "check_m": lambda spark, sf_dir: _candidates(spark, sf_dir).select("tree_id", tr.is_valid_matrix(C("v"), F.transform("bls", lambda b: F.struct((b["b1"] - 0.02).alias("b1"), b["b2"]))).alias("valid")),
    "is_ordered": _on(lambda t: t.select("tree_id", tr.is_ordered(C("v")).alias("ordered"))),
    "sample_hash": lambda spark, sf_dir: _vector(_suppliers(spark, sf_dir)),
    "sample_hash_ordered": lambda spark, sf_dir: _vector(sampled_trees(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(C("s_suppkey").alias("tree_id")), 10, True)),
    "node_depths": _on(relations.node_depths),
    "node_depths_bl": _on(lambda t: _rounded(relations.node_depths(t, True), "depth")),
    "node_depth_at": _on(lambda t: _rounded(relations.node_depth(t, _node(2 * F.size("v") + 1), True), "depth")),
    "mrca": _on(lambda t: relations.common_ancestors(t, _node(2 * F.size("v") + 1), (C("tree_id") * 5 + 1) % (2 * F.size("v") + 1))),
    "cophenetic": _on(relations.cophenetic),
    "cophenetic_unrooted": _on(lambda t: relations.pairwise_distances(t, "cophenetic", True)),
    "cophenetic_bl": _on(lambda t: _rounded(relations.cophenetic(t, lengths=True), "value")),
    "cophenetic_unrooted_bl": _on(lambda t: _rounded(relations.cophenetic(t, True, True), "value")),
    "vcv": _on(relations.vcv),
    "vcv_bl": _on(lambda t: _rounded(relations.vcv(t, True), "value")),
    "incidence_coo": _on(lambda t: relations.incidence_as(t, "coo")),
    "incidence_dok": _on(lambda t: relations.incidence_as(t, "dok")),
    "incidence_csr": _on(lambda t: _compressed(relations.incidence_as(t, "csr"))),
    "incidence_csc": _on(lambda t: _compressed(relations.incidence_as(t, "csc"))),
    "incidence_dense": _on(lambda t: relations.incidence_as(t, "dense").select("tree_id", "row", _joined(C("cells")).alias("cells"))),
    "pre_precision": _on(relations.pre_precision),
    "pre_precision_bl": _on(lambda t: _rounded(relations.pre_precision(t, True), "value")),
    "precision": q_precision,
    "precision_identity": q_precision_identity,
    "sackin": _on(lambda t: relations.balance(t).select("tree_id", "sackin")),
    "leaf_depth_variance": _on(lambda t: _rounded(relations.balance(t).select("tree_id", "variance"), "variance")),
    "b2": _on(lambda t: _rounded(relations.balance(t).select("tree_id", "b2"), "b2")),
    "splits": _on(compare.splits),
    "rf_pair": lambda spark, sf_dir: compare.robinson_foulds(_alternative(spark, sf_dir)).select("tree_id", "rf"),
    "rf_normalized": lambda spark, sf_dir: _rounded(compare.robinson_foulds(_alternative(spark, sf_dir), normalize=True).select("tree_id", "rf"), "rf"),
    "rf_all_pairs": lambda spark, sf_dir: compare.rf_all_pairs(_suppliers(spark, sf_dir)),
    "split_support": lambda spark, sf_dir: _rounded(compare.split_support(_suppliers(spark, sf_dir)), "support"),
    "find_num_leaves": _on(lambda t: stages.newick(t).select("tree_id", nw.find_num_leaves(C("newick")).alias("n"))),
    "newick_predicates": lambda spark, sf_dir: _named(spark, sf_dir).select(
        "tree_id", nw.has_parents(C("newick")).alias("parents"), nw.has_parents(C("named")).alias("named_parents"), nw.has_branch_lengths(C("named")).alias("lengths"),
        nw.has_branch_lengths(nw.remove_branch_lengths(C("newick"))).alias("bare_lengths"), nw.has_integer_labels(C("newick")).alias("integers"), nw.has_integer_labels(C("named")).alias("named_integers"),
    ),
    "remove_parent_labels": _on(lambda t: stages.newick(t, True).select("tree_id", nw.remove_parent_labels(C("newick")).alias("newick"))),
    "remove_branch_lengths": _on(lambda t: stages.newick(t, True).select("tree_id", nw.remove_branch_lengths(C("newick")).alias("newick"))),
    "apply_label_mapping": lambda spark, sf_dir: _named(spark, sf_dir).select("tree_id", C("named").alias("newick")),
    "create_label_mapping": lambda spark, sf_dir: stages.exploded(_named(spark, sf_dir).withColumn("p", nw.label_pieces(C("named"))), nw.taxa(C("p")), "tree_id", row="leaf", item="taxon"),
    "label_mapping_newick": lambda spark, sf_dir: _named(spark, sf_dir).withColumn("p", nw.label_pieces(C("named"))).select("tree_id", nw.numbered(C("p")).alias("newick")),
    "add_leaf": _on(lambda t: _vector(stages.with_leaf(t.withColumn("leaf", _node(F.size("v") + 2).cast("int")).withColumn("branch", ((C("tree_id") * 5 + 2) % (2 * F.size("v") + 1)).cast("int"))))),
    "remove_leaf": _on(lambda t: stages.without_leaf(t.withColumn("leaf", _node(F.size("v") + 1).cast("int"))).select("tree_id", "leaf", _joined(C("v")).alias("v"), "sister")),
    "queue_shuffle": _on(lambda t: kernels.queue_shuffle(t).select("tree_id", _joined(C("v")).alias("v"), _joined(C("mapping")).alias("mapping"))),
    "reroot": q_rerooted,
    "leaf_round_trip": q_leaf_round_trip,
    "reroot_distance": q_reroot_distance,
    "read_fasta": _fasta,
    "save_text": _on(lambda t: files.written(t).select("tree_id", "value")),
    "load_text": _on(lambda t: _vector(files.read_array(files.written(t.drop("bls")).drop("v")))),
    "dnadist": lambda spark, sf_dir: likelihood.distances(_alignment(spark, sf_dir), "raw", digits=6),
    "list_datasets": lambda spark, sf_dir: files.datasets(spark).where("format = 'fasta'"),
    "jc69_loglik": q_jc69,
    "bme_score": q_bme,
    "hill_climb_step": q_nni,
}
