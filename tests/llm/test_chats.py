import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from sojourn.llm import chats, queries

SCHEMA = "tree long, message long, parent long, role string, text string, score double"
TURNS = "conv_id long, turn long, role string, text string"
MARKS = ["<|im_end|>", "<|im_start|>", "\\", "\\s", "<\\p", "<|", "|", "<", "\n", "p", "s", "n", "é", "🙂", "﻿", "", "ok "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def escaped(text, codes):
    for plain, code in codes:
        text = text.replace(plain, code)
    return text


def turn_text(role, text):
    return f"<|im_start|>{escaped(role or '', chats.ROLE_CODES)}\n{escaped(text or '', chats.CODES)}<|im_end|>\n"


def plain_turns(rows):
    """What the query returns for rows of conv_id, turn, role, text."""
    found = defaultdict(list)
    for r in rows:
        found[r[0]].append(r[1:])
    out = {}
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, (t[1] or "").encode(), t[2] is not None, hashlib.md5((t[2] or "").encode()).hexdigest()))
        loss = "".join(t[2] or "" for t in turns if t[1] == "assistant")
        said = "".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in turns)
        out[conv] = (len(turns), sha(said), len(loss), sha(loss), sum(len(turn_text(*t[1:])) for t in turns))
    return out


def by_conversation(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_whole_table(spark, con, sf_dir):
    got = by_conversation(queries.QUERIES["op12_chats"](spark, sf_dir))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", chats.TRICKY), (-1, 1, "assistant", chats.TRICKY)]
    assert got == plain_turns(rows)
    assert got == {r[0]: r[1:] for r in con.execute(queries.ORACLES["op12_chats"]).fetchall()}


def edge_turns():
    draws = random.Random(8)
    rows = [(c, t, draws.choice(["user", "assistant", "assistant", "a\nb\\<|", None]), "".join(draws.choices(MARKS, k=6))) for c in range(40) for t in range(7)]
    rows += [(100, 0, "user", None), (100, 1, "assistant", None), (101, 0, "assistant", ""), (None, 0, "user", "x"), (None, None, "assistant", "y"), (102, None, None, None)]
    # Repeated rows and ties.
    rows += [(103, 1, "assistant", "same")] * 3 + [(103, 0, "assistant", "other"), (103, 0, "user", "other"), (103, 0, "assistant", "another")]
    rows += [(104, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)] + [(105, 0, "assistant", "<|im_end|>\n\\ é" * 60_000)]
    return rows


def test_edge_turns(spark):
    rows = edge_turns()
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as tree", "2 as message", "3 as said", "4 as loss", "5 as tree__", "6 as score").repartition(5)
    assert by_conversation(chats.checked_conversations(df)) == plain_turns(rows)
    assert chats.checked_conversations(spark.createDataFrame([], TURNS)).count() == 0
    assert set(by_conversation(chats.checked_conversations(chats.with_tricky(spark.createDataFrame([], TURNS))))) == {-1}


def test_large_trees_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(chats, "TREE_ROWS", 5)
    rows = edge_turns()
    assert by_conversation(chats.checked_conversations(spark.createDataFrame(rows, TURNS))) == plain_turns(rows)


def forest():
    draws = random.Random(3)
    rows = []
    for tree in [None, *range(12)]:
        for m in range(draws.randrange(1, 60)):
            parent = draws.randrange(m) if m and draws.random() < 0.95 else draws.choice([None, 999])
            rows.append((tree, m, parent, draws.choice(["user", "assistant"]), f"{tree}/{m} " + draws.choice(MARKS), draws.choice([None, 0.0, 0.5, 1.0, 0.25])))
    # A ring with a tail, one with itself, and an id twice: the larger row holds.
    rows += [(50, 1, 2, "user", "a", 1.0), (50, 2, 1, "user", "b", 1.0), (50, 3, 1, "user", "c", 1.0), (51, 1, 1, "user", "a", 1.0)]
    rows += [(52, 1, None, "user", "a", 1.0), (52, 1, None, "user", "b", 0.5), (52, 2, 1, "assistant", "c", None), (52, None, 1, "assistant", "d", 2.0)]
    return rows


def plain_paths(rows, branches):
    trees = defaultdict(dict)
    for tree, m, parent, role, text, score in rows:
        have = trees[tree].get(m)
        key = lambda x: (x is not None, x or 0)
        link, said = (key(parent), score or 0.0, parent), (role, text)
        trees[tree][m] = (max(link, have[0]), max(said, have[1])) if have else (link, said)
    out = set()
    for tree, messages in trees.items():
        parents = {link[2] for link, _ in messages.values()}
        found = []
        for leaf in messages:
            if leaf is not None and leaf in parents:
                continue
            path, at = [leaf], messages[leaf][0][2]
            while at is not None and at in messages and len(path) <= len(messages):
                path.append(at)
                at = messages[at][0][2]
            if len(path) <= len(messages):
                scores = [messages[m][0][1] for m in path]
                found.append((-sum(scores) / len(scores), -len(path), leaf is not None, leaf, path[::-1]))
        for rank, (mean, _, _, leaf, path) in enumerate(sorted(found, key=lambda x: (*x[:3], x[3] or 0))[:branches], 1):
            out.add((tree, leaf, rank, round(-mean, 9), len(path), "".join(turn_text(*messages[m][1]) for m in path)))
    return out


def test_branches_of_trees(spark, monkeypatch):
    rows = forest()
    messages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for branches, most in ((1, 100_000), (3, 100_000), (3, 10)):
        monkeypatch.setattr(chats, "TREE_ROWS", most)
        got = chats.formatted(*chats.as_tables(messages), branches).collect()
        assert {(r["tree"], r["leaf"], r["branch"], round(r["mean"], 9), r["n_turns"], r["formatted"]) for r in got} == plain_paths(rows, branches)
        for r in got:
            raw, spans = r["formatted"].encode(), [(s["start"], s["length"]) for s in r["loss"]]
            parts = r["formatted"].split("<|im_end|>\n")[:-1]
            want = [p.split("\n", 1)[1] for p in parts if p.startswith("<|im_start|>assistant\n")]
            assert [raw[a : a + n].decode() for a, n in spans] == want and spans == sorted(spans)


def test_learned_roles(spark):
    messages = spark.createDataFrame([(1, 1, None, "tool", "t", 0.0), (1, 2, 1, "assistant", "a", 0.0)], SCHEMA)
    row = chats.formatted(*chats.as_tables(messages), learned=("tool", "assistant")).select(*[c.alias(n) for c, n in zip(chats.read_back(F.col("formatted"), F.col("loss")), "tm", strict=True)]).first()
    assert row["m"] == ["t", "a"] and [tuple(t) for t in row["t"]] == [("tool", "t"), ("assistant", "a")]
