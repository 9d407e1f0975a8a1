import hashlib
import random
from collections import Counter

import pandas as pd
import pytest

from sojourn.llm import repeats, suffixes
from tests.llm import frames


def plain(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            if seen[raw[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_interval_expansion_finds_all_repeats():
    rng = random.Random(1)
    for _ in range(500):
        strings = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]
        least = rng.randint(1, 6)
        seen = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        want = [[seen[s[i : i + least]] > 1 for i in range(len(s) - least + 1)] for s in strings]
        assert [x.tolist() for x in suffixes.repeated_starts(strings, least)] == want


def check(df, least, anchor):
    rows = df.select("doc_id", "text").collect()
    want = [(r["doc_id"], *x, x[1] > 0) for r, x in zip(rows, plain([r["text"] for r in rows], least), strict=True)]
    got = [tuple(r) for r in repeats.remove_repeats(df, least, anchor).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("hot", [500, 2, 0])
def test_removed_bytes(spark, monkeypatch, hot):
    """Passages in many contexts, runs of one letter, and groups beyond the limit for one block."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "STEP_STARTS", 50)
    rng = random.Random(4)
    passages = ["".join(rng.choice("abé") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    rows = [(k, "".join(rng.choice([rng.choice("abcé") * rng.randint(1, 5), rng.choice(passages)]) for _ in range(rng.randint(0, 6)))) for k in range(80)]
    rows += [(500, "abab" * 30), (501, "abab" * 30), (502, ""), (503, None), (504, "x" * 200), (505, "x" * 39)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 40, 8)


def test_edge_cases(spark):
    # Very long texts among them.
    check(frames.edge(spark), 400, 64)
    check(frames.nothing(spark), 400, 64)


def test_kept_documents(spark):
    df = frames.edge(spark)
    left = repeats.kept_documents(df)
    assert left.columns == df.columns
    texts = [r["text"] for r in left.collect()]
    # Long near copies lose what they share, a run of one letter all of it; short texts stay as they are.
    assert "x" * 5000 not in texts and frames.LONG not in texts
    assert texts.count("One two three, four five six seven.") == 3 and texts.count(None) == 2 and "" in texts
    assert repeats.kept_documents(frames.nothing(spark)).count() == 0


def test_columns_of_any_name_keep_their_values(spark):
    names = ("key", "of", "left", "_key", "_of", "_left", "c0", "c1", "t", "marks", "copies", "n_removed")
    rows = [(i, text, len(text)) for i, text in enumerate(["ab" * 300 + "tail", "ab" * 300 + "end", "short"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").selectExpr("*", *[f"concat('{n}', doc_id) `{n}`" for n in names])
    got = {r["doc_id"]: r for r in repeats.kept_documents(df).collect()}
    assert set(got) == {0, 1, 2} and got[0]["text"] == "tail" and got[0]["n_chars"] == 4 and got[2]["n_chars"] == 5
    assert all(r[n] == f"{n}{i}" for i, r in got.items() for n in names)


def test_characters_are_kept_whole(spark):
    rows = [(1, "é" * 30 + "1"), (2, "é" * 30 + "2"), (3, "ü")]
    left = repeats.kept_documents(spark.createDataFrame(rows, "doc_id long, text string"), 41, 8)
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: "1", 2: "2", 3: "ü"}


def test_places_are_gathered_before_they_meet_their_text(spark, monkeypatch, capsys):
    """The places that go are folded by text before the join, so its rows do not grow with what is removed."""
    monkeypatch.setattr(repeats, "HOT", 0)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(120))
    rows = [(k, f"{k:05d}" * 8 + passage + f"{k + 500:05d}" * 8) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    repeats.cleaned_texts(df.select("text"), 40, 8).explain()
    assert "ObjectHashAggregate(keys=[t#" in capsys.readouterr().out
    check(df, 40, 8)


def test_rows_of_a_text_with_equal_bytes_are_one(spark):
    """A text that repeats one line asks once for it, however often it does."""
    texts = ["ab" * 1000, "x" * 900 + "end", "line of one text. " * 200]
    found = next(repeats.anchor_rows(40, 8)(iter([pd.DataFrame({"key": texts, "text": texts})])))["rows"]
    assert all(len({r[:2] for r in rows}) == len(rows) < 60 for rows in found)
    for text, rows in zip(texts, found, strict=True):
        places = [place for r in rows for place in [r[3:5], *r[5]]]
        assert len(places) > len(rows) and sorted(i for a, b in places for i in range(a, b + 1)) == list(range(len(text) - 39))
    check(spark.createDataFrame([*enumerate(texts), (7, "ab" * 30 + "z" + "x" * 50), (8, "x" * 39)], "doc_id long, text string"), 40, 8)
