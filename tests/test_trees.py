"""Golden values, laws and brute force for the tree operators."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborline import cli, queries
from arborline.functions import catalog
from arborline.functions import newick as nw
from arborline.functions import trees as tr
from arborline.operators import blocks, collection, compare, facade, kernels, likelihood, optimize, relations
from arborline.plans import stages
from arborline.sources import files
from arborline.streaming import events

NEWICKS = {
    (0, 0, 0, 1, 3): "(((0,(3,5)6)8,2)9,(1,4)7)10;",
    (0, 1, 2, 3, 4): "(0,(1,(2,(3,(4,5)6)7)8)9)10;",
    (0, 0, 1): "((0,2)5,(1,3)4)6;",
    (0, 2, 2): "((0,1)5,(2,3)4)6;",
    (0, 0, 4, 3): "(((0,2)6,1)7,(3,4)5)8;",
}


def table(spark, vectors, bls=None):
    rows = [(i, list(v), None if bls is None else bls[i]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "tree_id int, v array<int>, bls array<struct<b1:double,b2:double>>")


def random_vectors(n, sizes, seed=1):
    r = random.Random(seed)
    return [[r.randint(0, 2 * i) for i in range(r.choice(sizes))] for _ in range(n)]


def matrix(df, tree=0):
    cells = df.where(F.col("tree_id") == tree).collect()
    n = max(r["row"] for r in cells) + 1
    m = max(r["col"] for r in cells) + 1
    out = np.zeros((n, m))
    for r in cells:
        out[r["row"], r["col"]] += r["value"]
    return out


def test_newick_goldens(spark):
    t = table(spark, NEWICKS)
    assert [r["newick"] for r in stages.newick(t).orderBy("tree_id").collect()] == list(NEWICKS.values())
    bare = stages.newick(t).withColumn("newick", nw.remove_parent_labels(F.col("newick"))).drop("v", "pairs")
    for named in (stages.newick(t).drop("v", "pairs"), bare):
        assert [tuple(r["v"]) for r in stages.vector_of_newick(named).orderBy("tree_id").collect()] == list(NEWICKS)


def test_folds_agree_with_kernels(spark):
    vectors = random_vectors(30, range(1, 25))
    t = table(spark, vectors)
    rows = stages.edges(stages.newick(stages.ancestry(t))).orderBy("tree_id").collect()
    for v, r in zip(vectors, rows, strict=True):
        assert [tuple(p) for p in r["pairs"]] == kernels.pairs(v)
        assert [tuple(p) for p in r["rows"]] == kernels.ancestry(v)
        assert r["newick"] == kernels.newick(v)
    back = stages.vector_of_edges(stages.edges(t).withColumnRenamed("v", "w")).select("v", "w").collect()
    assert all(r["v"] == r["w"] for r in back)


def test_branch_lengths(spark):
    cases = {
        "(1:0.2,0:0.1)2;": [(0, 0.1, 0.2)],
        "(((0:0.9,2:0.4)4:0.8,3:3.0)5:0.4,1:0.5)6;": [(0, 0.9, 0.4), (0, 0.8, 3.0), (3, 0.4, 0.5)],
        "((0:0.1,2:0.2):0.3,(1:0.5,3:0.7):0.4);": [(0, 0.5, 0.7), (0, 0.1, 0.2), (1, 0.3, 0.4)],
    }
    t = spark.createDataFrame(list(enumerate(cases)), "tree_id int, newick string")
    for r, want in zip(stages.vector_of_newick(t, True).orderBy("tree_id").collect(), cases.values(), strict=True):
        assert [(x, b["b1"], b["b2"]) for x, b in zip(r["v"], r["bls"], strict=True)] == want
    m = table(spark, [[0, 0, 1]], [[(1.0, 3.0), (0.1, 0.2), (0.5, 0.7)]])
    assert stages.newick(m, True).first()["newick"] == "((0:0.1,2:0.2)5:0.5,(1:1.0,3:3.0)4:0.7)6;"
    for bad in ("((1,2)4,3)5;", "((1:0.5,2)4,3:0.8)5;", "((1:,2:0.2)4:0.9,3:0.8)5;"):
        with pytest.raises(Exception, match="no branch length"):
            stages.vector_of_newick(spark.createDataFrame([(bad,)], "newick string"), True).collect()
    with pytest.raises(Exception, match="not a binary tree"):
        stages.vector_of_newick(spark.createDataFrame([("(0,1,2);",)], "newick string")).collect()


def test_editing(spark):
    v = [0, 1, 2, 5, 4, 2]
    t = table(spark, [v] * 3).withColumn("leaf", F.element_at(F.array(F.lit(5), F.lit(7), F.lit(7)), F.col("tree_id") + 1)).withColumn("branch", F.element_at(F.array(F.lit(3), F.lit(0), F.lit(2)), F.col("tree_id") + 1))
    assert [r["v"] for r in stages.with_leaf(t).orderBy("tree_id").collect()] == [[0, 1, 2, 5, 3, 4, 2], [0, 1, 2, 5, 4, 2, 0], [0, 1, 2, 5, 4, 2, 2]]
    t = t.withColumn("leaf", F.element_at(F.array(F.lit(5), F.lit(6), F.lit(0)), F.col("tree_id") + 1))
    assert [(r["v"], r["sister"]) for r in stages.without_leaf(t).orderBy("tree_id").collect()] == [([0, 1, 2, 5, 2], 4), ([0, 1, 2, 5, 4], 2), ([0, 1, 4, 3, 1], 11)]
    vectors = random_vectors(40, range(2, 15), 7)
    t = table(spark, vectors).withColumn("leaf", F.pmod(F.col("tree_id") * 7, F.size("v") + 1).cast("int"))
    cut = stages.without_leaf(t.withColumn("old", F.col("v")))
    again = stages.with_leaf(cut.withColumn("branch", F.col("sister") - (F.col("sister") >= F.col("leaf")).cast("int"))).collect()
    assert all(r["v"] == r["old"] for r in again)
    with pytest.raises(Exception, match="no leaf"):
        stages.without_leaf(t.withColumn("leaf", F.lit(99))).collect()


def test_shuffle_and_reroot(spark):
    assert kernels.shuffle([0, 0, 0, 2, 5, 3]) == ([0, 1, 1, 2, 3, 2], [1, 5, 6, 4, 0, 2, 3])
    assert kernels.shuffle([0, 2, 1, 3]) == ([0, 1, 1, 1], [2, 4, 0, 1, 3])
    vectors = random_vectors(30, range(3, 12), 9)
    t = table(spark, vectors)
    rooted = kernels.reroot_at_random(t.drop("bls")).select(F.col("tree_id").alias("t"), F.col("v").alias("w"))
    both = t.join(rooted, F.col("tree_id") == F.col("t"))
    assert {r["rf"] for r in compare.robinson_foulds(both).collect()} == {0.0}
    for v in vectors:
        for flip in (False, True):
            ordered, mapping = kernels.shuffle(v, flip, 3)
            assert all(x <= i for i, x in enumerate(ordered)) and sorted(mapping) == list(range(len(v) + 1))
            depths = lambda u: sorted(len(a) for a in _ups(u))
            assert depths(ordered) == depths(v)
    total = lambda b: sum(x + y for x, y in b)
    _, lengths = kernels.reroot([0, 2, 2], 1, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])
    assert math.isclose(total(lengths), 21.0)
    for node in (-1, 6, 7):
        with pytest.raises(ValueError):
            kernels.reroot([0, 2, 2], node)


def _ups(v):
    parent = {c: p for a, b, p in kernels.ancestry(v) for c in (a, b)}
    out = []
    for leaf in range(len(v) + 1):
        path = [leaf]
        while path[-1] in parent:
            path.append(parent[path[-1]])
        out.append(path)
    return out


def test_statistics(spark):
    vectors = [[0], [0, 2, 2, 3], [0, 0, 0], [0] * 49, [0, 2, 2, 6, 4, 6, 6], [0, 0]]
    got = {r["tree_id"]: r for r in relations.balance(table(spark, vectors)).collect()}
    assert [got[i]["sackin"] for i in range(5)] == [2, 12, 9, 1274, 24]
    assert math.isclose(got[1]["variance"], 0.24) and math.isclose(got[2]["variance"], 0.6875) and math.isclose(got[5]["variance"], 2 / 9) and math.isclose(got[3]["variance"], 207.2896)
    assert [got[i]["b2"] for i in (0, 1, 2, 4)] == [1.0, 2.25, 1.75, 3.0]
    one = table(spark, [[0, 1, 2]])
    assert [r["depth"] for r in relations.node_depths(one).orderBy("node").collect()] == [1, 2, 3, 3, 2, 1, 0]
    t = table(spark, [[0, 1, 2, 5, 4, 2]])
    for a, b, want in ((2, 6, 7), (4, 5, 8), (1, 3, 10), (1, 4, 11), (0, 2, 12), (7, 4, 11), (3, 3, 3)):
        assert relations.common_ancestors(t, F.lit(a), F.lit(b)).first()["ancestor"] == want
    m = table(spark, [[0, 1]], [[(0.5, 0.8), (0.7, 0.6)]])
    for node, want in ((4, 0), (3, 0.6), (0, 0.7), (1, 1.1), (2, 1.4)):
        assert math.isclose(relations.node_depth(m, F.lit(node), True).first()["depth"], want, abs_tol=1e-12)
    with pytest.raises(Exception, match="no node"):
        relations.node_depth(m, F.lit(5)).collect()


def test_sackin_with_a_leaf_more(spark):
    """Against the index of each tree with the leaf put on; and the step needs no row a candidate."""
    vectors = random_vectors(20, range(0, 9), 6)
    found = stages.sackin_with_leaf(table(spark, vectors)).orderBy("tree_id").collect()
    tried = [[*v, x] for v in vectors for x in range(2 * len(v) + 1)]
    want = [r["sackin"] for r in relations.balance(table(spark, tried)).orderBy("tree_id").collect()]
    assert [s for r in found for s in r["sackins"]] == want
    plan = queries.q_nni(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_matrices(spark):
    one = table(spark, [[0, 1, 2]])
    assert matrix(relations.cophenetic(one)).tolist() == [[0, 3, 4, 4], [3, 0, 3, 3], [4, 3, 0, 2], [4, 3, 2, 0]]
    assert matrix(relations.cophenetic(one, True)).tolist() == [[0, 2, 3, 3], [2, 0, 3, 3], [3, 3, 0, 2], [3, 3, 2, 0]]
    assert matrix(relations.vcv(one)).tolist() == [[1, 0, 0, 0], [0, 2, 1, 1], [0, 1, 3, 2], [0, 1, 2, 3]]
    m = table(spark, [[0, 0, 1]], [[(1.0, 3.0), (0.1, 2.0), (5.0, 4.0)]])
    assert np.allclose(matrix(relations.cophenetic(m, True, True)), [[0, 5.1, 2.1, 7.1], [5.1, 0, 7, 4], [2.1, 7, 0, 9], [7.1, 4, 9, 0]])
    m = table(spark, [[0, 2, 2]], [[(0.4, 0.5), (0.1, 0.2), (0.3, 0.6)]])
    assert np.allclose(matrix(relations.vcv(m, True)), [[0.4, 0.3, 0, 0], [0.3, 0.5, 0, 0], [0, 0, 1, 0.6], [0, 0, 0.6, 1.1]])
    m = table(spark, [[0, 0]], [[(1.0, 1.0), (1.0, 1.0)]])
    assert matrix(relations.pre_precision(m, True)).tolist() == [[1, 0, 0, -1], [0, 1, 0, 0], [0, 0, 1, -1], [-1, 0, -1, 3]]
    m = table(spark, [[0, 0, 0, 1]], [[(0.3, 0.7), (1.1, 0.2), (0.9, 0.4), (0.5, 0.6)]])
    assert np.allclose(matrix(kernels.precisions(m, True)) @ matrix(relations.vcv(m, True)), np.eye(5))
    one = table(spark, [[0, 1, 2]])
    csc = relations.incidence_as(one, "csc").first()
    assert csc["indices"] == [0, 6, 1, 5, 2, 4, 3, 4, 4, 5, 5, 6] and csc["indptr"] == [0, 2, 4, 6, 8, 10, 12]
    coo = relations.incidence_as(one, "coo").orderBy("edge", "value").collect()
    assert [r["row"] for r in coo] == [4, 2, 4, 3, 5, 1, 5, 4, 6, 0, 6, 5] and [r["col"] for r in coo] == [2, 2, 3, 3, 1, 1, 4, 4, 0, 0, 5, 5]
    dense = [r["cells"] for r in relations.incidence_as(one, "dense").orderBy("row").collect()]
    assert np.array_equal(dense, matrix(relations.incidence(one)))
    with pytest.raises(ValueError):
        relations.incidence_as(one, "ell")
    with pytest.raises(KeyError):
        relations.pairwise_distances(one, "other")


def test_products_without_a_join(spark):
    """Precision times covariance in the tree's row; what is many rows a tree is not broadcast."""
    vectors = random_vectors(20, range(1, 9), 3)
    r = random.Random(5)
    t = table(spark, vectors, [[(r.uniform(0.1, 2), r.uniform(0.1, 2)) for _ in v] for v in vectors])
    products, lengths = kernels.precision_products(t, True).cache(), relations.vcv(t, True).cache()
    for i, v in enumerate(vectors):
        assert np.allclose(matrix(products, i), np.eye(len(v) + 1))
    b = np.array([[(x["b1"], x["b2"]) for x in t.where("tree_id = 0").first()["bls"]]])
    c1, c2, p = (np.array([c]) for c in zip(*kernels.ancestry(vectors[0]), strict=True))
    assert np.allclose(kernels.covariance(c1, c2, p, b[..., 0], b[..., 1])[0], matrix(lengths))
    plan = lambda q: queries.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan("precision_identity")
    assert "Broadcast" not in plan("jc69_loglik") + plan("reroot_distance")


def test_comparison(spark):
    t = spark.createDataFrame([(0, [0, 1, 2, 3], [0, 0, 1, 2]), (1, [0, 1, 2, 3], [0, 1, 2, 3]), (2, [0, 0], [0, 1])], "tree_id int, v array<int>, w array<int>")
    assert [r["rf"] for r in compare.robinson_foulds(t).orderBy("tree_id").collect()] == [4.0, 0.0, 0.0]
    assert [r["rf"] for r in compare.robinson_foulds(t, normalize=True).orderBy("tree_id").collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="same number of leaves"):
        compare.robinson_foulds(t.withColumn("w", F.array(F.lit(0)))).collect()
    trees = table(spark, random_vectors(12, [6], 5))
    pairs = {(r["a"], r["b"]): r["rf"] for r in compare.rf_all_pairs(trees).collect()}
    other = trees.select(F.col("tree_id").alias("b"), F.col("v").alias("w"))
    each = compare.robinson_foulds(trees.join(other, F.col("tree_id") < F.col("b")))
    assert pairs == {(r["tree_id"], r["b"]): r["rf"] for r in each.collect()}
    wanted = compare.splits(trees).where("tree_id = 3").select("split")
    assert 3 in [r["tree_id"] for r in compare.trees_with_split(trees, wanted).collect()]


def test_all_pairs_over_blocks(spark, monkeypatch):
    """Trees of several sizes and blocks, common and rare splits, parts of matrices: each pair once, as by its own comparison."""
    monkeypatch.setattr(blocks, "ROWS", 7)
    vectors = random_vectors(40, [0, 1, 3, 6, 12], 8)
    found = compare.rf_all_pairs(table(spark, vectors))
    trees = table(spark, vectors)
    other = trees.select(F.col("tree_id").alias("b"), F.col("v").alias("w"))
    each = compare.robinson_foulds(trees.join(other, (F.col("tree_id") < F.col("b")) & (F.size("v") == F.size("w"))))
    assert sorted(map(tuple, found.collect())) == sorted((r["tree_id"], r["b"], r["rf"]) for r in each.collect())
    # pairs are compared in the blocks' kernel, not in a join of trees
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    r = random.Random(9)
    lists = [[list({str(int(300 * r.random() ** 3)) for _ in range(8)}) for _ in range(n)] for n in (60, 50)]
    want = [[len(set(x) & set(y)) for y in lists[1]] for x in lists[0]]
    for cells in (compare.CELLS, 64):
        monkeypatch.setattr(compare, "CELLS", cells)
        assert compare._shared(*(pa.array(x, pa.list_(pa.string())) for x in lists)).tolist() == want


def test_validation_and_strings(spark):
    t = table(spark, [[0, 0, 2, 1, 8], [0, 0, 9, 1], [1, 0, 0, 0], [0, 3, 5, 7], []])
    assert [r[0] for r in t.orderBy("tree_id").select(tr.is_valid(F.col("v"))).collect()] == [True, False, False, False, True]
    with pytest.raises(Exception, match=r"v\[2\] = 9 is out of bounds \(max = 4\)"):
        t.where("tree_id = 1").select(tr.check(F.col("v"))).collect()
    s = spark.createDataFrame([("((0:1.94831E-06,2:9.25e-1)5:1.8209481e-3,(1:1,3:3)4:4)6;",)], "newick string")
    assert s.select(nw.remove_branch_lengths(F.col("newick"))).first()[0] == "((0,2)5,(1,3)4)6;"
    named = "(((aaa,(bbb,ccc)),ddd),(eee,(f,g)));"
    p = spark.createDataFrame([(named,)], "newick string").withColumn("p", nw.label_pieces(F.col("newick"))).withColumn("t", nw.taxa(F.col("p"))).withColumn("i", nw.numbered(F.col("p")))
    row = p.first()
    assert row["i"] == "(((0,(1,2)),3),(4,(5,6)));" and row["t"][0] == "aaa"
    back = p.withColumn("q", nw.label_pieces(F.col("i"))).select(nw.named(F.col("q"), F.map_from_arrays(F.sequence(F.lit(0), F.size("t") - 1), F.col("t"))))
    assert back.first()[0] == named
    numbers = [1.0, 0.1, 1e-5, 1.5e-7, 12345678.0, 123456789.125, 3e15, 1.25e-4, 0.0]
    made = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", tr.number(F.col("x")).alias("s")).collect()
    assert all(float(r["s"]) == r["x"] for r in made) and [r["s"] for r in made][:2] == ["1.0", "0.1"]


def test_sql_functions(spark):
    assert "tree_pairs" in catalog.register(spark)
    row = spark.sql("SELECT tree_pairs(v) AS p, tree_is_ordered(v) AS o, newick_n_leaves('((0,1)5,(2,3)4)6;') AS n FROM VALUES (array(0, 0, 0, 1)) t(v)").first()
    assert [tuple(x) for x in row["p"]] == [(1, 4), (0, 3), (0, 2), (0, 1)] and row["o"] and row["n"] == 4
    row = spark.sql("SELECT tree_newick(v) AS s, tree_depths(v) AS d, tree_mrca(v, 2, 6) AS m, tree_sackin(v) AS k, tree_b2(array(0, 2, 2, 3)) AS b, tree_edges(array(0, 2, 2)) AS e, newick_has_integer_labels('(a,1)2;') AS i FROM VALUES (array(0, 1, 2, 5, 4, 2)) t(v)").first()
    assert row["s"] == kernels.newick([0, 1, 2, 5, 4, 2]) and row["m"] == 7 and row["b"] == 2.25 and not row["i"]
    assert [tuple(x) for x in row["e"]] == [(2, 4), (3, 4), (0, 5), (1, 5), (5, 6), (4, 6)]
    same = stages.depths(table(spark, [[0, 1, 2, 5, 4, 2]])).first()["depths"]
    assert row["d"] == same and row["k"] == sum(same[:7])


def test_sampling(spark):
    for ordered in (False, True):
        got = [r["v"] for r in collection.sample_vectors(spark, 50, 9, ordered, 3).collect()]
        assert all(0 <= x <= (i if ordered else 2 * i) for v in got for i, x in enumerate(v)) and len({tuple(v) for v in got}) > 40
    assert collection.sample_trees(spark, 3, 5).select(tr.is_valid_matrix(F.col("v"), F.col("bls"))).distinct().collect()[0][0]
    with pytest.raises(ValueError):
        collection.sample_vectors(spark, 1, 1)


def test_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("0\n0\n1\n")
    (tmp_path / "m.txt").write_text("0.0,1.0,2.0\n0.0,3.0,4.0\n")
    (tmp_path / "t.nwk").write_text("((0,2)5,(1,3)4)6;\n")
    (tmp_path / "a.fasta").write_text(">one first\nACG\nT\n>two\nAC-A\n")
    assert files.load(spark, f"{tmp_path}/v.csv").first()["v"] == [0, 0, 1]
    m = files.load(spark, f"{tmp_path}/m.txt").first()
    assert m["v"] == [0, 0] and [tuple(b) for b in m["bls"]] == [(1.0, 2.0), (3.0, 4.0)]
    assert files.load_newick(spark, f"{tmp_path}/t.nwk").first()["v"] == [0, 0, 1]
    assert files.load_newick(spark, "(0,1)2;").first()["v"] == [0]
    assert [tuple(r) for r in files.read_fasta(spark, f"{tmp_path}/a.fasta").orderBy("taxon").collect()] == [("one", "ACGT"), ("two", "AC-A")]
    for call in (lambda: files.load(spark, "x.nwk"), lambda: files.load_newick(spark, "x.csv"), lambda: files.load_alignment(spark, "x", "rdata"), lambda: files.load_alignment(spark, "yeast"), lambda: files.load_descr("x")):
        with pytest.raises(ValueError):
            call()
    bad = tmp_path / "bad.csv"
    bad.write_text("0,1\n0,2\n")
    with pytest.raises(Exception, match="neither a vector nor a matrix"):
        files.load(spark, str(bad)).collect()
    texts = {"0.5\n1.7": None, "0,1,2\n0,3,4": None, "0.0\n0.0": None, "0.5,1.0,2.0\n0.0,1.0,2.0": None, "": None, "0,0,1": [0, 0, 1], "0,1.0,2.0\n0,3.0,4.0": [0, 0]}
    for text, want in texts.items():
        call = lambda: files.read_array(spark.createDataFrame([(text,)], "value string")).first()["v"]  # noqa: B023, E731
        if want is None:
            with pytest.raises(Exception, match="neither a vector nor a matrix"):
                call()
        else:
            assert call() == want
    (tmp_path / "odd.fasta").write_text(">a x>y\nAC\nGT\n>b\nTT\n")
    assert [tuple(r) for r in files.load_fasta(spark, "odd.fasta", str(tmp_path)).orderBy("taxon").collect()] == [("a", "ACGT"), ("b", "TT")]
    (tmp_path / "zika.fa").write_text(">z\nACG\n")
    known, descr = files.load_alignment(spark, "zika", folder=str(tmp_path))
    assert known.first()["seq"] == "ACG" and descr["Number of Taxa"] == 86 and descr["Link"].endswith("zika.fasta")
    assert files.load_alignment(spark, f"{tmp_path}/odd.fasta", "fasta")[1] is None
    both = spark.createDataFrame([(0, "((0:0.1,2:0.2):0.3,(1:0.5,3:0.7):0.4);"), (1, "((0,2)5,(1,3)4)6;")], "tree_id int, newick string")
    got = {r["tree_id"]: r for r in stages.from_newick(both).collect()}
    assert got[0]["v"] == got[1]["v"] == [0, 0, 1] and got[1]["bls"] is None and [tuple(x) for x in got[0]["bls"]] == [(0.5, 0.7), (0.1, 0.2), (0.3, 0.4)]
    assert files.load_newick(spark, "(0:0.5,1:0.25);").first()["bls"][0]["b2"] == 0.25
    files.save_newick(table(spark, [[0, 0]]), f"{tmp_path}/named", labels={"0": "ann", "1": "bob", 2: "cy"})
    assert spark.read.text(f"{tmp_path}/named").first()[0] == "((ann,cy),bob);"
    t = table(spark, [[0, 2, 2]], [[(0.1, 0.2), (1.0, 2.0), (3.0, 4.5)]])
    files.save(t.coalesce(1), f"{tmp_path}/out")
    again = files.load(spark, f"{tmp_path}/out").first()
    assert again["v"] == [0, 2, 2] and again["bls"][2]["b2"] == 4.5
    files.save_newick(t.coalesce(1), f"{tmp_path}/nw", True)
    assert spark.read.text(f"{tmp_path}/nw").first()[0] == stages.newick(t, True).first()["newick"]
    assert files.list_datasets(spark) == ["fluA", "h3n2", "m501", "zika"]
    urls = spark.createDataFrame([("https://x.org/a",), ("file.txt",), (None,)], "u string").select(files.is_url(F.col("u"))).collect()
    assert [r[0] for r in urls] == [True, False, False]


def _likelihood(v, bls, columns):
    out = 0.0
    for states in columns:
        part = {}
        for leaf, s in enumerate(states):
            part[leaf] = np.ones(4) if s == 4 else np.eye(4)[s]
        for (a, b, p), (x, y) in zip(kernels.ancestry(v), bls, strict=True):
            step = lambda t: 0.25 + np.exp(-4 / 3 * t) * (np.eye(4) - 0.25)
            part[p] = (step(x) @ part[a]) * (step(y) @ part[b])
        out += math.log(part[2 * len(v)].mean())
    return out


def test_likelihood_and_search(spark):
    v, bls = [0, 1, 2, 2], [(0.1, 0.3), (0.2, 0.2), (0.4, 0.05), (0.15, 0.6)]
    seqs = ["acgt-acg", "acgaaacg", "aagt-ccg", "ccgtttcg", "acgtrykm"]
    alignment = spark.createDataFrame([(0, i, f"t {i}", s) for i, s in enumerate(seqs)], "alignment_id int, leaf int, taxon string, seq string")
    t = stages.ancestry(table(spark, [v], [bls])).withColumn("alignment_id", F.lit(0))
    got = likelihood.jc69(t, likelihood.patterns(alignment)).first()["loglik"]
    states = [[likelihood.STATES[s[c]] for s in seqs] for c in range(8)]
    assert math.isclose(got, _likelihood(v, bls, states), rel_tol=1e-9)
    fast = [(3 * x, 3 * y) for x, y in bls]
    mixed = likelihood.jc69(t, likelihood.patterns(alignment), rates=(1.0, 3.0), weights=(0.25, 0.75)).first()["loglik"]
    each = [[_likelihood(v, b, [c]) for c in states] for b in (bls, fast)]
    assert math.isclose(mixed, sum(math.log(0.25 * math.exp(x) + 0.75 * math.exp(y)) for x, y in zip(*each, strict=True)), rel_tol=1e-9)
    half = stages.ancestry(table(spark, [[0]], [[(0.0, 0.5)]])).withColumn("alignment_id", F.lit(0))
    tips = likelihood.patterns(alignment.where("leaf < 2").withColumn("seq", F.lit("a")))
    chance = 0.25 + 0.75 * math.exp(-4 / 3 * 0.5)
    assert math.isclose(likelihood.jc69(half, tips, frequencies=(0.7, 0.1, 0.1, 0.1)).first()["loglik"], math.log(0.7 * chance), rel_tol=1e-9)
    with pytest.raises(Exception, match="unknown base"):
        likelihood.patterns(alignment.withColumn("seq", F.lit("acgx"))).collect()
    d = {(r["a"], r["b"]): r["distance"] for r in likelihood.distances(alignment.where("leaf < 2"), "raw").collect()}
    assert math.isclose(d["t 0", "t 1"], 1 / 7)
    assert optimize.list_methods() == ["GradME", "HillClimbing"]
    with pytest.raises(ValueError):
        optimize.register_method("GradME")(object)
    found = optimize.HillClimbing(patience=1, steps=1).fit(alignment.where("leaf < 4").select("taxon", "seq"))
    assert found.scores == sorted(found.scores, reverse=True) and sorted(found.label_mapping.values()) == ["t.0", "t.1", "t.2", "t.3"]


def test_balanced_evolution(spark):
    r = random.Random(8)
    for rooted in (False, True):
        for _ in range(20):
            v = [r.randint(0, i) for i in range(r.randint(2, 8))]
            paths = matrix(relations.cophenetic(table(spark, [v]), not rooted)) if _ == 0 else None
            e = optimize.expected_paths(optimize.one_hot(v), rooted)
            ups = _ups(v)
            for i in range(len(v) + 1):
                for j in range(i):
                    m = min(set(ups[i]) & set(ups[j]))
                    p = ups[i].index(m) + ups[j].index(m) - (1 if not rooted and len(v) >= 2 and m == 2 * len(v) else 0)
                    assert math.isclose(e[i, j], 2.0**-p)
                    assert paths is None or paths[i, j] == p
    true = [0, 1, 1, 0, 2]
    ups = _ups(true)
    d = np.array([[0.0 if i == j else ups[i].index(min(set(ups[i]) & set(ups[j]))) + ups[j].index(min(set(ups[i]) & set(ups[j]))) for j in range(6)] for i in range(6)])
    params = np.random.default_rng(1).normal(size=(5, 5))
    for rooted in (False, True):
        loss, gradient = optimize.bme_gradient(params, d, rooted)
        assert math.isclose(loss, optimize.bme_loss(optimize.row_weights(params), d, rooted))
        for i, j in zip(*np.tril_indices(5), strict=True):
            up, down = params.copy(), params.copy()
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            slope = (optimize.bme_loss(optimize.row_weights(up), d, rooted) - optimize.bme_loss(optimize.row_weights(down), d, rooted)) / 2e-5
            assert math.isclose(gradient[i, j], slope, abs_tol=1e-7)
    for solver in ("adam", "sgd"):
        assert optimize.GradME(solver=solver, learning_rate=0.3, n_shuffles=2, n_iter_per_step=20).search(spark, d, list("abcdef")).best
    with pytest.raises(ValueError):
        optimize.GradME(solver="other")
    got = optimize.GradME(n_shuffles=8, n_iter_per_step=200).search(spark, d, list("abcdef"))
    assert got.best_score <= np.log(d.sum() * 0.2) and len(got.label_mapping) == 6


def test_streaming(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 10:00:00", i % 4) for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.to_timestamp("ts"))
    want = {(r["user_id"], r["window"]["start"]): r["sackin"] for r in events.balance(events.window_trees(e), "user_id", "window").collect()}
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    query = events.balance(events.window_trees(stream), "user_id", "window").writeStream.format("memory").queryName("balance").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["user_id"], r["window"]["start"]): r["sackin"] for r in spark.table("balance").collect()}
    assert got == want
    trees = events.window_trees(e)
    fixed = trees.limit(1).select("v")
    assert events.distance_to(trees, fixed).count() == trees.count()


def test_cli(capsys):
    assert cli.main([]) == 0
    cli.main(["to_newick", "0,0,4,3"])
    cli.main(["to_newick", "0.0,1.0,2.0\\n0.0,3.0,4.0"])
    cli.main(["from_newick", "(((0,2)6,1)7,(3,4)5)8;"])
    cli.main(["samplev", "5"])
    out = capsys.readouterr().out.splitlines()[-4:]
    assert out[:3] == ["(((0,2)6,1)7,(3,4)5)8;", "((0:1.0,2:2.0)3:3.0,1:4.0)4;", "0,0,4,3"] and len(out[3].split(",")) == 4


def test_large_kernels(spark):
    v = random_vectors(1, [3000], 11)[0]
    t = table(spark, [v, [0, 0, 1]])
    made = kernels.newicks(t)
    back = {r["tree_id"]: r["v"] for r in kernels.vectors(made).collect()}
    assert back == {0: v, 1: [0, 0, 1]}
    with pytest.raises(ValueError, match="out of bounds"):
        kernels.pairs([0, 3])


def test_distance_models(spark):
    """The models against plain arithmetic; two alignments in one table; sites with gaps go everywhere, or for the pair."""
    r = random.Random(12)
    base = [r.choice("acgt") for _ in range(300)]
    change = {"a": "ggct", "g": "aact", "c": "ttag", "t": "ccag"}
    seqs = {n: "".join(r.choice(change[b]) if r.random() < 0.15 else b for b in base) for n in "wxyz"}
    seqs["w"] = "-" * 10 + seqs["w"][10:]
    rows = [(k, n, s) for k in (1, 2) for n, s in seqs.items()]
    t = spark.createDataFrame(rows, "k int, taxon string, seq string")
    clean = {n: s[10:] for n, s in seqs.items()}
    f = {b: sum(s.count(b) for s in clean.values()) / sum(map(len, clean.values())) for b in "acgt"}

    def want(model, a, b, al):
        n = len(a)
        p, pr, py = (sum(test(x, y) for x, y in zip(a, b, strict=True)) / n for test in (lambda x, y: x != y, lambda x, y: {x, y} == {"a", "g"}, lambda x, y: {x, y} == {"c", "t"}))
        q = p - pr - py
        g = (lambda k, w: -k * math.log(w)) if al is None else (lambda k, w: k * al * (w ** (-1 / al) - 1))
        R, Y = f["a"] + f["g"], f["c"] + f["t"]
        e = 1 - sum(x * x for x in f.values())
        kr, ky = 2 * f["a"] * f["g"] / R, 2 * f["c"] * f["t"] / Y
        kv = 2 * (R * Y - f["a"] * f["g"] * Y / R - f["c"] * f["t"] * R / Y)
        return {"raw": p, "JC69": g(0.75, 1 - 4 * p / 3), "K80": g(0.5, 1 - 2 * (pr + py) - q) + g(0.25, 1 - 2 * q), "F81": g(e, 1 - p / e), "TN93": g(kr, 1 - pr / kr - q / (2 * R)) + g(ky, 1 - py / ky - q / (2 * Y)) + g(kv, 1 - q / (2 * R * Y))}[model]

    for model in likelihood.MODELS:
        for gamma in (False, 0.7):
            got = {(x["k"], x["a"], x["b"]): x["distance"] for x in likelihood.distances(t, model, gamma, key="k").collect()}
            assert len(got) == 12
            for (_, a, b), d in got.items():
                assert math.isclose(d, want(model, clean[a], clean[b], gamma or None), rel_tol=1e-9), (model, gamma)
    pairwise = {(x["a"], x["b"]): x["distance"] for x in likelihood.distances(t.where("k = 1"), "raw", pairwise_deletion=True).collect()}
    assert math.isclose(pairwise["x", "y"], sum(a != b for a, b in zip(seqs["x"], seqs["y"], strict=True)) / 300)
    with pytest.raises(ValueError):
        likelihood.distances(t, "other")


def test_distances_over_blocks(spark, monkeypatch):
    """Taxa of several blocks, with texts of unequal lengths, without a base or null, and a taxon twice; and tasks that aren't coalesced."""
    monkeypatch.setattr(blocks, "ROWS", 3)
    r = random.Random(4)
    rows = [(r.choice("kl"), f"t{i:02}", "".join(r.choice("ACGT-n") for _ in range(r.choice((9, 12))))) for i in range(24)]
    rows += [("k", "t00", "acgtacgt"), ("k", "none", None), ("k", "gaps", "---"), ("l", None, "acgt"), (None, "lost", "acgt"), (None, "last", "acgt")]
    t = spark.createDataFrame(rows, "k string, taxon string, seq string")
    want = []
    for k, a, s in rows:
        for k2, b, u in rows:
            if None not in (k, a, b) and k == k2 and a < b:
                known = [(x, y) for x, y in zip((s or "").lower(), (u or "").lower()) if x in "acgt" and y in "acgt"]
                want.append((k, a, b, sum(x != y for x, y in known) / len(known) if known else None))
    found = likelihood.distances(t, "raw", key="k", pairwise_deletion=True)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    # pairs are compared in the blocks' kernel, not in a join of taxa
    assert "x < y" not in (plan := found._jdf.queryExecution().toString()) and "FlatMapGroupsInArrow" in plan


def test_facade(spark):
    tree = facade.TreeVec([0, 1, 2, 5, 4, 2], taxa=list("abcdefg"))
    assert tree.n_leaf == 6 and tree.is_rooted and tree.get_ancestry()[-1][2] == 12 and len(tree.get_edges()) == 12
    tree.add_leaf(spark, 5, 3)
    assert tree.data == [0, 1, 2, 5, 3, 4, 2]
    tree = facade.TreeVec([0, 1, 2, 5, 4, 2])
    assert tree.remove_leaf(spark, 5) == 4 and tree.data == [0, 1, 2, 5, 2]
    assert facade.TreeVec([0, 0, 1]).to_newick() == "((0,2)5,(1,3)4)6;"
    assert all(x <= i for i, x in enumerate(facade.TreeVec.from_sample(9, True, 3).data))
    assert facade.reorder_v("birth_death", [0, 2, 1, 3], dict(enumerate("abcde"))) == ([0, 1, 1, 1], dict(enumerate("ceabd")))
    for method in ("bfs", "other"):
        with pytest.raises(ValueError):
            facade.reorder_v(method, [0], {0: "a", 1: "b"})


def test_large_trees(spark):
    """Depths, ancestors, incidence and balance of a tree of thousands of leaves, against walks over its kernel's ancestry."""
    v = random_vectors(1, [4000], 3)[0]
    t = table(spark, [v])
    rows = kernels.ancestry(v)
    depth, parent = {2 * len(v): 0}, {}
    for a, b, p in reversed(rows):
        depth[a] = depth[b] = depth[p] + 1
        parent[a] = parent[b] = p
    assert stages.depths(t).first()["depths"] == [depth[i] for i in range(2 * len(v) + 1)]
    ups = lambda n: {n, *ups(parent[n])} if n in parent else {n}
    assert relations.common_ancestors(t, F.lit(17), F.lit(3001)).first()["ancestor"] == min(ups(17) & ups(3001))
    csr = relations.incidence_csr(t).first()
    counts = np.bincount([n for a, b, p in rows for n in (a, b, p, p)], minlength=2 * len(v) + 1)
    assert csr["indptr"] == [0, *np.cumsum(counts).tolist()] and len(csr["indices"]) == 4 * len(v)
    assert relations.balance(t).first()["sackin"] == sum(depth[i] for i in range(len(v) + 1))
    both = kernels.with_rows(table(spark, [v, [0, 0, 1]], [[(1.0, 2.0)] * len(v), [(1.0, 2.0)] * 3]).withColumn("own", F.lit("x")))
    got = {r["tree_id"]: r for r in relations.balance(both).collect()}
    assert got[0]["sackin"] == sum(depth[i] for i in range(len(v) + 1)) and got[1]["sackin"] == 8
    assert {r["tree_id"]: [tuple(x) for x in r["rows"]] for r in both.where("own = 'x'").collect()} == {0: rows, 1: kernels.ancestry([0, 0, 1])}
    assert kernels.pairs(list(range(0, 40_000, 2))) == [(0, 1), *[(0, i) for i in range(2, 20_001)]]
