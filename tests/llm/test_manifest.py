import hashlib
import zlib
from collections import defaultdict

from sojourn.llm import manifest, ordering, queries
from tests.llm import frames

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [text if c == "text" else row.get(c) for c in FIELDS]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The top, and for each leaf the digests before and after it on each level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            run, slot = nodes[i // 3 * 3 :][:3], i % 3
            steps[j].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at = [i // 3 for i in at]
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], steps


def plain(rows):
    rows = [r.asDict() for r in rows]
    sources = defaultdict(list)
    for r in rows:
        sources[r.get("source")].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in sources[s]])
    if not names:
        return []
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for s, more in zip(names, upper, strict=True):
        for r, steps in zip(sources[s], trees[s][1], strict=True):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            text = r["text"].replace("\n", "") if tampered and r["text"] is not None else r["text"]
            node = leaf(r, text)
            for before, after in steps + more:
                node = digest(before, node, after)
            proof = digest(*[a + b for a, b in steps + more])
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][0], root, proof, node, node == root))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark, con, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.QUERIES["op13_manifest"](spark, sf_dir)
    want = sorted(plain(docs.collect()), key=repr)
    assert rows_of(got) == want and {r[-1] for r in want} == {True, False}
    assert sorted(con.execute(queries.ORACLES["op13_manifest"]).fetchall(), key=repr) == want


def test_edge_cases(spark):
    # The frame's n_chars is one of its clashing names, so it is hashed as it is.
    docs = frames.edge(spark).selectExpr("*", "1 as node", "2 as steps", "3 as at", "4 as nodes", "5 as source__", "6 as _row")
    assert rows_of(manifest.without_newlines(docs)) == sorted(plain(docs.collect()), key=repr)
    assert manifest.without_newlines(frames.nothing(spark)).count() == 0
    bare = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert rows_of(manifest.without_newlines(bare)) == plain(bare.collect())


def test_small_trees_and_sources(spark):
    """Runs of one and two, lone leaves, many sources, empty and null ones, and texts that look like other encodings."""
    rows = []
    for k, n in enumerate((1, 2, 3, 4, 7, 9, 10, 28, 30)):
        rows += [(100 * k + i, f"t\n{i}", "é" * k, f"s{k}") for i in range(n)]
    rows += [(1, "-", "-", ""), (2, None, None, ""), (3, "1:-", None, None), (4, "", "", None), (5, "x", "z", "Z"), (6, "x", "z", "é"), (7, "x", "z", "ｚ🙂")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars")
    assert rows_of(manifest.without_newlines(docs)) == sorted(plain(docs.collect()), key=repr)


def test_blocks_cut_no_run(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    rows = [(i, f"a\n{i}", "en", "s" if i % 20 else "t") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    assert rows_of(manifest.without_newlines(docs)) == sorted(plain(docs.collect()), key=repr)


def test_steps_prove_other_changes(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(11)], "doc_id long, text string, lang string, source string")
    found = manifest.checked(docs, docs["doc_id"] == 4, manifest.F.lit(None).cast("string"))
    assert {r["doc_id"]: r["verified"] for r in found.collect()} == {i: i != 4 for i in range(11)}


def test_positions(spark):
    rows = [(k, i) for k in (None, 1, 2) for i in range(1000 if k == 1 else 5)] + [(3, None)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    got = [(r["k"], r["v"], r["at"], r["n"]) for r in ordering.placed(df, ["k"], ["v"], "at", "n").collect()]
    assert sorted(got, key=repr) == sorted([(k, v, v or 0, 1 if k == 3 else 1000 if k == 1 else 5) for k, v in rows], key=repr)
