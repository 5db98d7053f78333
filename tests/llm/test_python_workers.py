"""Python workers that one task needs at a time: each holds some 70 to 130 MB
beside the executor's heap."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from traitlab.llm import suffix_dedup as S
from traitlab.llm.labelled import training_rows


def python_steps(df) -> int:
    """Most Python operators between two exchanges of the plan: so many
    workers run side by side in a task."""
    def walk(node):
        name, kids = node.nodeName(), node.children()
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        found = [walk(kids.apply(i)) for i in range(kids.size())]
        own, most = sum(f[0] for f in found), max((f[1] for f in found), default=0)
        if "Exchange" in name:
            return 0, most
        own += any(x in name for x in ("Arrow", "Python", "Pandas"))
        return own, max(own, most)

    return walk(df._jdf.queryExecution().executedPlan())[1]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    a = word(400)
    rows = [(i, word(300) + a[i % 7:] + word(50)) for i in range(30)] + [(100, None), (None, a), (101, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_a_task_of_the_suffix_dedup_needs_one_worker(docs):
    assert python_steps(S.drop_repeats(docs)) == 1
    assert python_steps(S.suffix_dedup(docs)) == 1


def test_dropped_text_is_the_kept_bytes(docs):
    kept = sorted((str(r.doc_id), bytes(r.kept_bytes).decode("utf-8", "ignore")) for r in S.suffix_dedup(docs).collect())
    assert sorted((str(r.doc_id), r.text) for r in S.drop_repeats(docs).collect()) == kept
    assert sum(len(t) for _, t in kept) < 30 * 360


def test_sampled_training_texts_need_no_worker_of_their_own(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(100, 1)], "doc_id long, quality int")
    rows, sampled = training_rows(docs, labels, "doc_id", "text", "quality", 4, 2, 100)
    assert python_steps(sampled) == 0 and python_steps(rows) == 1
    texts = {(r.doc_id or 0): r.text for r in docs.collect() if r.doc_id is not None}
    got = sampled.join(labels.selectExpr("doc_id", "xxhash64(11, doc_id) AS h"), "h").collect()
    assert got and all(bytes(r.raw) == (texts[r.doc_id] or "").encode() and r.y == (r.doc_id % 2 if r.doc_id < 100 else 1) for r in got)


def test_merged_spans():
    assert S.merged(None, None) == [] and S.merged(np.zeros(0, int), np.zeros(0, int)) == []
    assert S.merged(np.array([30, 0, 5, 20]), np.array([40, 10, 8, 30])) == [(0, 10), (20, 40)]


def test_hashing_a_long_text_takes_bounded_memory():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 3 << 20, np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([{"id": 1, "h": 2}], S._DOC_ARROW), pa.array([text])], names=["doc", "text"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in S._occurrences(200)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 30_000 and peak < 40 << 20
