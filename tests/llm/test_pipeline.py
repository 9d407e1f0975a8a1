from collections import Counter

import corpus_pipeline
from sojourn.llm import queries, scratch
from tests.llm import frames
from tests.llm.test_near_copies_stage import plain as one_of_each
from tests.llm.test_repeats import plain as repeated


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_stages(spark):
    """Each stage on what the one before kept, against plain versions where there is one."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_copies", "repeats", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = scratch.written(stage(spark, docs, sf), f"test-{name}")
        if name == "packing":
            assert set(before) == {r["doc_id"] for r in after.collect()}
            break
        assert after.columns == docs.columns
        rows = after.collect()
        assert max(Counter(r["doc_id"] for r in rows).values()) == 1
        left = {r["doc_id"]: r["text"] for r in rows}
        if name in ("quality", "toxicity"):
            label, good = ("quality", 1) if name == "quality" else ("toxic", 0)
            known = [(labels[d][label] == good, d in left) for d in before if d in labels]
            assert sum(a == b for a, b in known) >= 0.97 * len(known)
            assert all(left[d] == before[d] for d in left)
        elif name == "near_copies":
            assert set(left) == one_of_each(list(before.items())) and all(left[d] == before[d] for d in left)
        else:
            ids = list(before)
            for d, (_, removed, _, _) in zip(ids, repeated([before[d] for d in ids], 400), strict=True):
                assert removed or left[d] == before[d]
                assert not removed or d not in left or len(left[d].encode()) <= len(before[d].encode()) - removed
        docs = after


def test_edge_cases(spark):
    docs = frames.edge(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.written(stage(spark, docs, "/root/testdata/sf0.001"), f"edge-{name}")
        assert name == "packing" or out.columns == docs.columns
        docs = out
