"""The pipeline's stages, each on its own input, against the operators' reports; and the guard of the entry points."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from arborline.llm import nearset, quality, repeats

from .test_operators import SCHEMA, _near_truth, _quality_truth, _rows, _words, tokenizer


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(_rows(), SCHEMA).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, read, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, read, out))
        if k < 4:
            assert out.columns == docs.columns, name
        read = out
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    assert b.count() == quality.quality_report(a).where("kept").count()
    groups = nearset.component_report(b).where("n_shingles > 0").select("component_id").distinct().count()
    assert c.count() == groups
    removed = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in repeats.repeat_report(c).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in d.collect())
    assert all(abs(len(r["text"].encode()) - removed[r["doc_id"]]) <= 60 for r in d.collect())
    assert Counter(r["doc_id"] for r in e.collect()).most_common(1)[0][1] <= 3 and all(_words(r["text"]) for r in e.collect())
    assert f.count() == e.count() and set(f.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == f.count()


def test_entry_lists_all():
    names = [x for x in __spark_entry__.queries() if x.startswith("op") or x == "pipeline"]
    assert sorted({int(x[2:].split("_")[0]) for x in names if x != "pipeline"}) == list(range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _pipeline_truth(rows):
    """All stages in plain Python, over rows (doc_id, text, source) with distinct ids."""
    rows = [r for r in rows if _quality_truth(r[1])[-1]]
    component = {d: c for d, _, c, _ in _near_truth([(r[0], r[1]) for r in rows], 5)}
    rows = [r for r in rows if component[r[0]] == r[0]]
    windows = Counter(r[1][p : p + 200] for r in rows for p in range(len(r[1]) - 199))
    cut = []
    for d, text, source in rows:
        gone = {q for p in range(len(text) - 199) if windows[text[p : p + 200]] > 1 for q in range(p, p + 200)}
        cut.append((d, "".join(c for i, c in enumerate(text) if i not in gone), source))
    size, by = {d: len(_words(t)) for d, t, _ in cut}, defaultdict(list)
    for r in cut:
        by[r[2]].append(r)
    names = sorted(by, key=lambda s: (s is None, s))
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: sum(size[r[0]] for r in by[s]) for s in names}
    full = {}
    while True:
        left = [s for s in names if s not in full]
        level = (sum(total.values()) - sum(full.values())) / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if level * weight[s] >= 3 * total[s]]
        if not over:
            break
        full |= {s: 3 * total[s] for s in over}
    own = tokenizer()
    out = Counter()
    for s in names:
        target = full.get(s, level * weight[s])
        copies = int(target // total[s]) if total[s] else 0
        room, seen = target - copies * total[s], 0
        for _, (d, text, _) in sorted((hashlib.md5(f"{r[0]}\n{r[1]}".encode()).hexdigest()[:13], r) for r in by[s]):
            n = copies + (seen + size[d] / 2 <= room)
            seen += size[d]
            ids = own.encode_ordinary(text)
            if size[d] and n:
                out[d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += n
    return out


def test_run_against_plain_python(spark, tmp_path):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(600)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base, texts = prose(60), prose(150).split(), ["too short", "junk junk junk junk " * 20]
    texts += [prose(r.randint(20, 120)) for _ in range(25)] + [f"{prose(30)} {passage} {prose(20)}" for _ in range(5)]
    texts += [" ".join(f"edit{i}" if i in at else w for i, w in enumerate(base)) for at in ([], [3], [70], [5, 140])] + [texts[5], texts[5].upper()]
    rows = [(i, t, ["a", "b", "c", None, "a", "a", "b"][i % 7]) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == _pipeline_truth(rows) and len(got) > 15


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_its_result_alone(spark, tmp_path):
    """Tables on the way are deleted, so are stages that were read; a second run doesn't touch the first one's result."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 400}x{i}" for j in range(30)), "en", "a", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from arborline.llm import store

    before = list(store._written)
    one = corpus_pipeline.run(spark, str(tmp_path))
    two = corpus_pipeline.run(spark, str(tmp_path))
    assert one.count() == two.count() > 0 and store._written == before


def test_last_stage_folds(spark):
    """The tokens come from the folds of higher-order functions, without Python on executors."""
    docs = spark.createDataFrame([(1, "the quick brown fox", "en", "a", 19)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = dict(corpus_pipeline.STAGES)["bpe"](spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "MapInArrow" not in plan


def test_last_stage_keeps_no_large_plan_texts(spark, tmp_path):
    """The driver keeps the texts of plans; the last stage's had megabytes of ranks. The caller's session stays as it is."""
    docs = spark.createDataFrame([(1, "the quick brown fox", "en", "a", 19)], "doc_id long, text string, lang string, source string, n_chars long")
    before = dict(spark.conf.getAll)
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList().size()
    # as the check tool runs a stage: the result is written outside of it
    dict(corpus_pipeline.STAGES)["bpe"](spark, docs, "").write.parquet(f"{tmp_path}/out")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = store.executionsList()
    late = [made.apply(i) for i in range(min(seen, made.size() - 1), made.size())]
    assert late and all(len(x.physicalPlanDescription()) < 100_000 for x in late)
    nodes = [store.planGraph(x.executionId()).allNodes() for x in late]
    assert sum(len(n.apply(i).desc()) for n in nodes for i in range(n.size())) < 100_000
    assert dict(spark.conf.getAll) == before and spark.getActiveSession()._jsparkSession.equals(spark._jsparkSession)
