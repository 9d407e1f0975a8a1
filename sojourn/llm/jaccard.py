"""Documents whose sets of word shingles are alike, by a matrix of tokens and document groups.

The join is exact: two documents link when the shared part of their shingle sets is at least ``percent`` of the union. Pairs
are never listed within groups of copies; what comes out are the connected components.

1. Equal sets are one class from here on. A class is its size, its digest and a document that has it.
2. Classes that cannot link go early. Two linked sets share all but a tenth of their shingles in any order of all shingles, so most of
   a class's shingles of the lowest hashes must be in other classes, too. Texts of their own fail this on few shingles.
3. For the classes left all shingles are taken and counted, and the test is repeated on them.
4. Each class's prefix holds so many of its rarest shingles that linked classes share one of them. Each of these names the class that
   has it and whose shingles are in most other classes. The one named most often becomes the centre, and links to centres are tested first.
5. Classes of one centre form groups of bounded size. The matrix of tokens and centres has a row for every shingle in a prefix of
   a class of the centre. A class is asked against the groups of each centre that shares a prefix shingle, fits in size, is not already
   known to be linked to it and has more classes than its own, and the group's union of shingles bounds the overlap. Only groups that
   pass are opened, and all members compared.
6. Links become components. A group is opened with its members joined up, so a class adds one link per joined-up part.

Nulls and empty texts have no shingles, size 0 and themselves as component (a null ``doc_id`` gives a null one). Repeated rows are
documents with equal sets. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm import ragged, shingles
from sojourn.llm.components import connected_components
from sojourn.llm.scratch import small_batches, staged, written

# Members of a group, and questions put to a group in one task.
GROUP_SIZE = 64
QUESTIONS = 256

SETS = "row long, doc_id long, key binary, n long, s1 long, s2 long, head array<long>"
FULL = "s1 long, s2 long, tokens array<long>"


def needed(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n shingles with any set that it links to."""
    return -(-percent * n // 100)


def head_size(n: int, percent: int) -> tuple[int, int]:
    """How many of the lowest hashes to look at, and how many of them a linked set must share.

    With prefixes of length n - needed + k, linked sets share k. The partner may be smaller by ``percent``, which lowers k a little.
    """

    def shares(m: int) -> tuple[int, int]:
        shortest = m - needed(m, percent) + 1
        taken = min(m, -(-3 * shortest // 2))
        return taken, taken - shortest + 1

    return shares(n)[0], min(shares(n)[1], shares(needed(n, percent))[1])


def set_rows(size: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for frame in frames:
            out = []
            for doc_id, key, found in zip(frame["doc_id"], frame["key"], shingles.shingle_sets(list(frame["text"]), size), strict=True):
                n = len(found)
                s1 = int(np.bitwise_xor.reduce(found * np.uint64(0x9FB21C651E98DF25))) if n else 0
                s2 = int(np.add.reduce(ragged.splitmix(found))) if n else 0
                head = found[: head_size(n, percent)[0]].view(np.int64) if n else found.view(np.int64)
                out.append((row, None if doc_id is None else int(doc_id), key, n, _signed(s1), _signed(s2 & (2**64 - 1)), head))
                row += 1
            rows = pd.DataFrame(out, columns=["row", "doc_id", "key", "n", "s1", "s2", "head"])
            rows["doc_id"] = rows["doc_id"].astype("Int64")
            yield rows

    return run


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def full_rows(size: int):
    """All shingles of a text, if it still has the digest that was asked for."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for s1, s2, found in zip(frame["s1"], frame["s2"], shingles.shingle_sets(list(frame["text"]), size), strict=True):
                mine = _signed(int(np.bitwise_xor.reduce(found * np.uint64(0x9FB21C651E98DF25)))) if len(found) else 0
                other = _signed(int(np.add.reduce(ragged.splitmix(found))) & (2**64 - 1)) if len(found) else 0
                if (mine, other) == (s1, s2):
                    out.append((s1, s2, found.view(np.int64)))
            yield pd.DataFrame(out, columns=["s1", "s2", "tokens"])

    return run


def exact_at_least(n: Column, percent: int) -> Column:
    """``needed`` as a column."""
    return F.floor((F.lit(percent) * n + 99) / 100).cast("long")


def without_own(full: DataFrame, percent: int) -> DataFrame:
    """Classes of which at least ``percent`` of all shingles are in another of these classes, too."""
    tokens = full.select("c", F.explode("tokens").alias("t"))
    single = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c")).filter("k = 1")
    own = single.groupBy("c").agg(F.count(F.lit(1)).alias("own"))
    kept = full.join(own, "c", "left").filter(F.col("n") - F.coalesce("own", F.lit(0)) >= exact_at_least(F.col("n"), percent))
    return kept.drop("own")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def test_pairs(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [linked(a, b, percent) for a, b in zip(frame["tokens"], frame["others"], strict=True)]
            yield frame.loc[np.array(keep, bool), ["a", "b"]]

    return run


def joined_up(link: np.ndarray) -> np.ndarray:
    """The smallest member of each member's part, of a small symmetric matrix of links."""
    part = np.arange(len(link))
    while True:
        new = np.where(link, part[None, :], len(link)).min(axis=1)
        new = np.minimum(new, part)
        new = new[new]
        if (new == part).all():
            return part
        part = new


def open_groups(percent: int):
    """Compares the members of one group with each other and with the classes that ask."""

    def run(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("c")
        ids = members["c"].to_numpy(np.int64)
        sizes = members["n"].to_numpy(np.int64)
        flat = np.concatenate(list(members["tokens"])) if len(members) else np.zeros(0, np.int64)
        union, column = np.unique(flat, return_inverse=True)
        matrix = np.zeros((len(ids), len(union)), np.float32)
        matrix[np.repeat(np.arange(len(ids)), sizes), column] = 1
        out = []
        inner = matrix @ matrix.T
        link = 100 * inner >= percent * (sizes[:, None] + sizes[None, :] - inner)
        np.fill_diagonal(link, True)
        part = joined_up(link)
        if len(members) and members["_share"].iloc[0] == 0:
            out += [(int(ids[i]), int(ids[j])) for i, j in enumerate(part) if i != j]
        for c, tokens in zip(asking["q"], asking["asked"], strict=True):
            if not len(union):
                break
            at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            at = at[union[at] == tokens]
            # The bound: what the group has of these shingles at all.
            if len(at) < needed(len(tokens), percent):
                continue
            shared = matrix[:, at].sum(axis=1)
            hit = np.flatnonzero(100 * shared >= percent * (sizes + len(tokens) - shared))
            out += [(int(c), int(ids[j])) for j in np.unique(part[hit])]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def links_of_classes(full: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join up exactly the classes that linked pairs join up."""
    sets = full.select("c", "n", "tokens")
    tokens = sets.select("c", "n", F.explode("tokens").alias("t"))

    def rare_shingles() -> DataFrame:
        counted = written(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "token-counts")
        ranked = F.sort_array(F.collect_list(F.struct("df", "t")))
        prefix = tokens.join(counted, "t").groupBy("c", "n").agg(ranked.alias("ranked"), F.sum("df").alias("seen"))
        length = (F.col("n") - exact_at_least(F.col("n"), percent) + 1).cast("int")
        central = (F.col("seen") / F.col("n")).alias("central")
        rare = prefix.select("c", "n", central, F.inline(F.slice("ranked", F.lit(1), length))).filter("df > 1")
        return rare.select("c", "n", "central", "t")

    postings = staged(full.sparkSession, rare_shingles, "prefixes")
    fits = (F.col("n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n") * percent)

    # The centre of a class: the most central class of the most of its prefix shingles. The text that edited copies were made from has
    # no shingles of its own, so others have its shingles more often than those of any copy.
    first = postings.groupBy("t").agg(F.max(F.struct("central", -F.col("c"))).alias("top")).select("t", (-F.col("top.col2")).alias("b"))
    seen = postings.join(first, "t").filter("c <> b").groupBy("c", "b").agg(F.count(F.lit(1)).alias("k"))
    best = seen.groupBy("c").agg(F.max(F.struct("k", -F.col("b"))).alias("best"))
    centres = written(best.select(F.col("c").alias("a"), (-F.col("best.col2")).alias("b")), "centres")
    mine = centres.join(sets.select(F.col("c").alias("a"), "tokens"), "a")
    pairs = mine.join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("others")), "b")
    stars = written(pairs.mapInPandas(test_pairs(percent), "a long, b long"), "star-links")

    # Groups: the classes linked to one centre, or those of one centre that are not.
    to = stars.select(F.col("a").alias("c"), F.col("b").alias("known"))
    near = centres.select(F.col("a").alias("c"), F.col("b").alias("centre"))
    keyed = postings.select("c", "n").distinct().join(to, "c", "left").join(near, "c", "left")
    keyed = keyed.select("c", "n", F.coalesce("known", "c").alias("known"), F.col("known").isNotNull().alias("tied"),
                         F.coalesce("known", "centre", "c").alias("key"))
    sizes = keyed.groupBy("tied", "key").agg(F.count(F.lit(1)).alias("members"))
    # The classes of one key are a kind, which is dealt out over groups of bounded size.
    kind = F.struct("members", "tied", "key").alias("kind")
    part = F.pmod(F.xxhash64("c"), F.ceil(F.col("members") / GROUP_SIZE)).alias("part")
    placed = keyed.join(sizes, ["tied", "key"]).select("c", "n", "known", kind, part)
    groups = written(placed.withColumn("g", F.struct("kind.tied", "kind.key", "part")), "groups")
    # Members of a tied kind are all linked to its key, others may have any known links. Of two kinds the one with fewer members asks.
    matrix = postings.join(groups.select("c", "kind"), "c").groupBy("t", "kind").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    asked = postings.join(groups.select("c", "known", "part", F.col("kind").alias("own")), "c").join(matrix, "t")
    foreign = ~(F.col("kind.tied") & (F.col("kind.key") == F.col("known")))
    larger = (F.col("own") < F.col("kind")) | ((F.col("own") == F.col("kind")) & (F.col("own.members") > GROUP_SIZE))
    # A shingle that a kind's groups share counts once; the groups follow when the shingles are folded.
    kinds = asked.filter(foreign & larger & fits).select("c", "part", "own", "kind").distinct()
    every = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("kind.members") / GROUP_SIZE) - 1)
    opened = kinds.withColumn("other", F.explode(every)).filter((F.col("own") != F.col("kind")) | (F.col("other") > F.col("part")))
    questions = written(opened.select("c", F.struct("kind.tied", "kind.key", F.col("other").alias("part")).alias("g")), "questions")

    per_group = questions.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUESTIONS).alias("shares"))
    dealt = questions.join(per_group, "g").select("c", "g", F.pmod(F.xxhash64("c"), F.col("shares")).alias("_share"))
    asking = dealt.join(sets.select("c", F.col("tokens").alias("asked")), "c")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1)).alias("_share")
    opened = groups.select("c", "n", "g").join(per_group, "g", "left").select("c", "n", "g", every).join(sets.select("c", "tokens"), "c")
    flat = [F.col("g.tied").alias("tied"), F.col("g.key").alias("key"), F.col("g.part").alias("part"), "_share"]
    left = opened.select(*flat, "c", "n", "tokens").groupBy("tied", "key", "part", "_share")
    names = ["q_tied", "q_key", "q_part", "q_share"]
    right = asking.select(*[x.alias(y) for x, y in zip([*flat[:3], F.col("_share")], names, strict=True)], F.col("c").alias("q"), "asked").groupBy(*names)
    found = left.cogroup(right).applyInPandas(open_groups(percent), "a long, b long")
    return stars.unionByName(found)


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))


def joined_sets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """A row for each document with its digest, and the component of each digest: its number and its smallest ``doc_id``."""
    small_batches(docs.sparkSession)
    texts = keyed_texts(docs)
    # Ids go through Python as text, since pandas has no whole numbers with nulls.
    as_text = texts.withColumn("doc_id", F.col("doc_id").cast("string"))
    sets = written(as_text.mapInPandas(set_rows(size, percent), SETS), "shingle-sets")
    classes = written(
        sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("c"), F.first("n").alias("n"), F.min("doc_id").alias("doc_id")),
        "classes",
    )
    # A shingle of one class only has one digest.
    heads = sets.filter("n > 0").select("s1", F.explode("head").alias("t"))
    single = heads.groupBy("t").agg(F.min("s1").alias("s1"), F.max("s1").alias("last")).filter("s1 = last")
    own = single.groupBy("s1").agg(F.count(F.lit(1)).alias("own"))
    n = F.col("n")
    shortest = lambda m: m - exact_at_least(m, percent) + 1
    taken = lambda m: F.least(m, F.floor((3 * shortest(m) + 1) / 2).cast("long"))
    least = exact_at_least(n, percent)
    shared = F.least(taken(n) - shortest(n) + 1, taken(least) - shortest(least) + 1)
    alive = classes.join(own, "s1", "left").filter(taken(n) - F.coalesce("own", F.lit(0)) >= shared)
    # A set needs room for another one that differs and still links.
    alive = alive.filter(100 * n >= percent * (n + 1)).drop("own")
    texts = texts.join(alive.select(F.col("doc_id").alias("rep"), "s1", "s2"), F.col("doc_id").eqNullSafe(F.col("rep")))
    found = texts.select("s1", "s2", "text").mapInPandas(full_rows(size), FULL).dropDuplicates(["s1", "s2"])
    found = found.join(alive.select("s1", "s2", "c", "n"), ["s1", "s2"]).select("c", "n", "tokens")

    def narrowed() -> DataFrame:
        once = written(without_own(written(found, "full-sets"), percent), "full-sets")
        return without_own(once, percent)

    # The sets before and between the tests are deleted when those that are left are written.
    full = staged(docs.sparkSession, narrowed, "kept-sets")
    labels = connected_components(links_of_classes(full, percent))
    joined = classes.join(labels, F.col("c") == F.col("node"), "left").withColumn("k", F.coalesce("component", "c"))
    smallest = joined.groupBy("k").agg(F.min("doc_id").alias("component_id"))
    return sets, written(joined.join(smallest, "k").select("s1", "s2", "k", "component_id"), "components")


def components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the smallest ``doc_id`` that links reach)."""
    sets, answer = joined_sets(docs, size, percent)
    empty = sets.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    filled = sets.filter("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(answer, ["s1", "s2"])
    return filled.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def one_of_each(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """The documents without copies: of each component the one with the smallest ``doc_id`` stays (any of them if several rows have
    it), with all its columns. Documents without words link to nothing and all stay."""
    sets, answer = joined_sets(docs, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "row")).alias("one")
    one = sets.filter("n > 0").join(answer, ["s1", "s2"]).groupBy("k").agg(first)
    chosen = written(one.select(F.col("one.doc_id").alias("_id"), F.col("one.key").alias("_of")), "chosen")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): names[i] for i, c in enumerate(docs.columns)}
    whole = docs.toDF(*names).withColumn("_key", F.unhex(F.md5(F.coalesce(at["text"], F.lit("")))))
    worded = F.coalesce(at["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    mine = (F.col("_key") == F.col("_of")) & F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_id"))
    found = whole.filter(worded).join(chosen, mine).groupBy("_of", "_id").agg(*[F.first(c).alias(c) for c in names])
    return found.select(*names).unionByName(whole.filter(~worded).select(*names)).toDF(*docs.columns)
