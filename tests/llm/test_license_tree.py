import re
from collections import Counter

from sojourn.llm import licenses, queries


def above(path):
    parts = path.split("/")[:-1]
    return ["/".join(parts[:n]) for n in range(len(parts), -1, -1)]


def test_query_inherits_from_all_depths(spark):
    """The query's own tree has licences at several depths, and each file gets the nearest one."""
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op6_licenses"](spark, sf).collect()
    docs = queries.table(spark, sf, "documents")
    paths = {r["doc_id"]: r["path"] for r in licenses.as_files(docs).collect()}
    assert len(rows) == len(paths) == len(set(paths.values()))
    given = {}
    for r in rows:
        assert r["path"] == paths[r["doc_id"]]
        if r["score"] is not None and re.match(licenses.LICENSE_NAMES, r["path"].split("/")[-1]):
            folder = r["path"].rsplit("/", 1)[0]
            given[folder] = min(given.get(folder, (0, "", "")), (-r["score"], r["path"], r["license"]))
    for r in rows:
        near = next(((d, f, given[f][2]) for d, f in enumerate(above(r["path"])) if f in given), (None, None, None))
        want = (None, None, r["license"]) if r["score"] is not None else near
        assert (r["distance"], r["inherited_from"], r["license"]) == want
    far = Counter(r["distance"] for r in rows if r["distance"] is not None)
    print(sorted(far.items()), len(given), sum(r["license"] is None for r in rows), sum(r["score"] is not None for r in rows))
    assert all(far[d] for d in range(4))


def test_tree_keeps_rows_apart(spark):
    rows = [(10, "en", "s"), (10, "de", "s"), (-10, "en", "s"), (None, None, None), (7, "en", "a/b")]
    files = licenses.as_files(spark.createDataFrame([(d, "x", la, so) for d, la, so in rows], "doc_id long, text string, lang string, source string"))
    paths = [r["path"] for r in files.collect()]
    assert len(set(paths)) == len(rows) and paths[-1].startswith("a_b/")
