import random
import re
from itertools import combinations

from sojourn.llm import components, jaccard, scratch
from tests.llm import frames

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain(rows):
    """Number of shingles and smallest id of the component of each row."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            part[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        old = least.get(root(i))
        least[root(i)] = d if old is None else old if d is None else min(old, d)
    return [(d, len(s), d if not s else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(spark, rows):
    got = [tuple(r) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_links_of_near_copies(spark, monkeypatch):
    """Clusters around bases of many lengths, chains, and a passage in many texts; groups of few members."""
    monkeypatch.setattr(jaccard, "GROUP_SIZE", 4)
    monkeypatch.setattr(jaccard, "QUESTIONS", 3)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 11, 12, 13, 30, 60, 120]))]
        rows += [(len(rows) + j, edited(rng, base, rng.randint(0, 3))) for j in range(rng.randint(1, 8))]
    rows += [(1000 + i, passage + " " + edited(rng, vocabulary[:12], 9)) for i in range(30)]
    # A chain: each text has one more edit than the one before.
    words = [rng.choice(vocabulary) for _ in range(80)]
    for i in range(8):
        words[10 * i] = f"chain{i}"
        rows.append((2000 + i, " ".join(words)))
    check(spark, rows)


def test_edge_cases(spark):
    rows = [r for r in frames.EDGE]
    got = [tuple(r) for r in jaccard.components(frames.edge(spark)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))
    assert jaccard.components(frames.nothing(spark)).count() == 0


def test_one_of_each(spark):
    df = frames.edge(spark)
    left = jaccard.one_of_each(df)
    assert left.columns == df.columns
    got = sorted(repr((r["doc_id"], r["text"])) for r in left.collect())
    keep = [(1, frames.EDGE[0][1]), (2, ""), (3, None), (None, None), (4, frames.LONG), (6, "x" * 5000), (7, "\n\n \t\n")]
    keep += [(frames.BIG, frames.EDGE[10][1]), (8, "a"), (8, "b c")]
    assert got == sorted(map(repr, keep))
    assert jaccard.one_of_each(frames.nothing(spark)).count() == 0


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_copies_of_one_text_link_to_it_and_not_to_each_other(spark, monkeypatch):
    """The text that many copies were edited from is their centre, wherever it is; few questions are left."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(200):
        a, b = 5 + k % 40, 50 + k // 5
        rows.append((k, " ".join(f"x{k}y{i}" if i in (a, b) else w for i, w in enumerate(words))))
    rows.append((500, " ".join(words)))
    made = {}

    def written(df, name):
        made[name] = real(df, name)
        return made[name]

    real = jaccard.written
    monkeypatch.setattr(jaccard, "written", written)
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r["component_id"] for r in found} == {0} and len(found) == 201
    assert made["star-links"].filter("a <> b").count() >= 200
    assert made["questions"].count() <= 20


def test_sets_between_the_tests_are_deleted(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(scratch.shared, "deleted", lambda spark, paths: gone.extend(paths))
    rows = [(i, "one two three four five six seven eight nine ten eleven twelve") for i in range(3)]
    check(spark, rows)
    assert sum("full-sets" in path for path in gone) == 2 and sum("token-counts" in path for path in gone) == 1
    assert not any("kept-sets" in path or "prefixes" in path for path in gone)
