from itertools import combinations

import corpus_pipeline
from tests.llm.test_jaccard import LOWER, WORD


def shingles(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows):
    """Ids that stay: the smallest of each component of texts that share 80 % of their five-word shingles."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            part[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d for i, (d, _) in enumerate(rows) if not sets[i] or least[root(i)] == d}


def test_near_copies_stage(spark):
    """The stage takes five words and 0.8, where the query of one operator has three words and 0.9."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = corpus_pipeline.no_near_copies(spark, docs, sf)
    left = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and len(left) == len(set(left))
    assert set(left) == plain(rows)
    assert not {255, 770, 875, 944} & set(left)
