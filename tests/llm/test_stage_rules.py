"""Stages of the pipeline against brute force by the stage's own rule."""

import random
from collections import defaultdict

import corpus_pipeline

from .test_operators import _near_truth


def _edited(words, at):
    return [f"edit{i}" if i in at else w for i, w in enumerate(words)]


def test_near_stage_takes_five_words(spark, tmp_path):
    r = random.Random(6)
    texts = []
    for n, edits in ((400, 10), (400, 4), (360, 9), (300, 20), (200, 0), (3, 0)):
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        step = n // (edits + 1)
        texts += [words, _edited(words, {step * (j + 1) for j in range(edits)})]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    ids = defaultdict(set)
    for d, _, component, _ in _near_truth(rows, 5):
        ids[component].add(d)
    want = sorted(ids)
    assert len(want) > len({c for _, _, c, _ in _near_truth(rows, 4)})
    stage = dict(corpus_pipeline.STAGES)["minhash near-dedup"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in stage(spark, docs, str(tmp_path)).collect()) == want
