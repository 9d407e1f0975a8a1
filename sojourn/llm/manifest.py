"""A Merkle manifest of a dataset: one root for all documents, and for each document a proof that it is in it.

Each document is a leaf: the hash of its columns, each as its length and its bytes. The leaves of a source ascend by ``doc_id``; while more than one
node remains, every three that follow each other become the hash of their digests, the last ones being fewer, even one. What remains is the source's
subroot, and the subroots in order of their sources likewise give the root.

A level is a few window columns: lags and leads at the fixed offsets of one and two nodes, masked by a node's slot in its run and the run's length, are
its siblings, and the row of a run's first child hashes the parent and carries it on. A row's ancestor of any level is the last such row
before it, which gives each leaf its siblings. A window holds a block of ``BLOCK`` leaves, a power of three, so no run is cut, a source that holds most documents is many
tasks, and one shuffle serves ``LEVELS`` levels. The blocks' tops are the leaves of the next round, and each block then gets its
top's steps. Positions come from one range sort.

Nulls: a null value is hashed as ``-``, which no other value gives; rows without ``doc_id`` come first, and a null source is a source of its own,
before all others. A column that the table lacks counts as null. Rows with one ``doc_id`` are ordered by their digests, and repeated rows are leaves
of their own. Empty texts are values, very long texts are hashed whole, an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.ordering import marked, placed, same
from sojourn.llm.scratch import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Children of a node, and levels and leaves of a window.
FAN = 3
LEVELS = 7
BLOCK = FAN**LEVELS
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf of a document, if need be with another text."""
    have = {c: docs[c] for c in FIELDS if c in docs.columns}
    if text is not None:
        have["text"] = text
    return digest(*[field(have[c]) if c in have else F.lit("-") for c in FIELDS])


def _in_blocks(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``steps``, the siblings on each level of the block, and ``top``, on the block's first row the digest of the whole block."""
    window = Window.partitionBy(*keys, F.floor(F.col("at") / BLOCK)).orderBy("at")
    rows, node = nodes, F.col("node")
    for level in range(LEVELS):
        width = FAN**level
        # Of each node of this level the first leaf's row is in use.
        place, count = F.floor(F.col("at") / width), F.ceil(F.col("nodes") / width)
        slot = place % FAN
        run = F.least(F.lit(FAN), count - (place - slot))
        before = [F.when(slot >= k, F.lag(node, k * width).over(window)) for k in range(FAN - 1, 0, -1)]
        after = [F.when(slot + k < run, F.lead(node, k * width).over(window)) for k in range(1, FAN)]
        rows = rows.withColumns({f"before{level}": F.concat_ws("", *before), f"after{level}": F.concat_ws("", *after)})
        # A tree that is one node by now has no more steps.
        step = F.struct(F.col(f"before{level}").alias("before"), F.col(f"after{level}").alias("after"))
        parent = F.when(count > 1, digest(node, F.col(f"after{level}"))).otherwise(node)
        rows = rows.withColumns(
            {
                f"step{level}": F.when((F.col("at") % width == 0) & (count > 1), step),
                f"node{level}": F.when(F.col("at") % (width * FAN) == 0, parent),
            }
        )
        node = F.col(f"node{level}")
    before_or_here = window.rowsBetween(Window.unboundedPreceding, 0)
    steps = [F.last(f"step{level}", ignorenulls=True).over(before_or_here) for level in range(LEVELS)]
    return rows.select(*nodes.columns, F.array_compact(F.array(*steps)).alias("steps"), node.alias("top"))


def _rounds(nodes: DataFrame, keys: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all trees, from those of the leaves up, and the trees' tops. ``nodes``: keys, ``at``, ``nodes`` (how many the tree has),
    ``node``, and for leaves what else they carry."""
    rounds, tops = [], []
    while True:
        blocks = written(_in_blocks(nodes, keys), "merkle-blocks")
        rounds.append(blocks)
        heads = blocks.filter(F.col("at") % BLOCK == 0)
        tops.append(heads.filter(F.col("nodes") <= BLOCK).select(*keys, F.col("top").alias("node")))
        heads = heads.filter(F.col("nodes") > BLOCK)
        if heads.isEmpty():
            return rounds, reduce(DataFrame.unionByName, tops)
        nodes = heads.select(*keys, F.floor(F.col("at") / BLOCK).alias("at"), F.ceil(F.col("nodes") / BLOCK).alias("nodes"), F.col("top").alias("node"))


def _with_steps(rounds: list[DataFrame], keys: list[str], above: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves with ``steps`` up to the root. ``above``: for each tree the steps that follow its top, and what else its leaves get."""
    further = F.concat("steps", "steps__").alias("steps")
    paths = None
    for blocks in reversed(rounds):
        own = [c for c in blocks.columns if c not in ("nodes", "steps", "top")]
        single = blocks.filter(F.col("nodes") <= BLOCK)
        rows = single.join(marked(above, [*keys, "steps"]), same(keys)).select(*own, further, *carried)
        if paths is not None:
            inner = blocks.filter(F.col("nodes") > BLOCK).withColumn("up", F.floor(F.col("at") / BLOCK))
            up = paths.select(*keys, F.col("at").alias("up"), "steps", *carried)
            met = inner.join(marked(up, [*keys, "up", "steps"]), same([*keys, "up"]))
            rows = rows.unionByName(met.select(*own, further, *carried))
        paths = rows
    return paths


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def manifest(leaves: DataFrame) -> DataFrame:
    """``subroot``, ``root`` and ``steps`` (the siblings ``before`` and ``after`` on each level, from the leaf to the root) added to a table of
    ``source``, ``doc_id``, ``node`` (the leaf) and other columns."""
    nodes = placed(leaves, ["source"], ["doc_id", "node"], "at", "nodes")
    rounds, subroots = _rounds(nodes, ["source"])
    # All subroots are leaves of one tree.
    upper, roots = _rounds(placed(subroots.withColumn("all", F.lit(0)), ["all"], ["source"], "at", "nodes"), ["all"])
    top = roots.select("all", F.col("node").alias("root"), F.array().cast(STEPS).alias("steps"))
    sources = _with_steps(upper, ["all"], top, ["root"])
    above = written(sources.select("source", F.col("node").alias("subroot"), "root", "steps"), "merkle-sources")
    return _with_steps(rounds, ["source"], above, ["subroot", "root"])


def checked(docs: DataFrame, tampered: Column, text: Column) -> DataFrame:
    """The manifest of ``docs``, and whether each document still verifies where those for which ``tampered`` holds have another ``text``.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    altered = F.when(tampered, leaf(docs, text))
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    leaves = docs.select(docs["doc_id"].cast("long").alias("doc_id"), source.alias("source"), leaf(docs).alias("node"), altered.alias("altered"))
    found = manifest(leaves).select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
        folded(F.coalesce("altered", "node"), F.col("steps")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines(docs: DataFrame) -> DataFrame:
    """``checked`` where every other document (by the CRC-32 of its id) lost the newlines of its text."""
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    return checked(docs, tampered, F.replace(docs["text"], F.lit("\n"), F.lit("")))


def _sql_field(name: str) -> str:
    return f"coalesce(strlen(cast({name} as varchar)) || ':' || {name}, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS) + ")"


# CRC-32 of a decimal number in SQL without its last inversion: each character is followed by seven empty steps, one for each of its other bits.
_SQL_STEPS = "list_prepend(4294967295::ubigint, flatten([[ascii(c)::ubigint, 0, 0, 0, 0, 0, 0, 0] for c in string_split(cast(doc_id as varchar), '')]))"
_SQL_CRC = f"list_reduce({_SQL_STEPS}, lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)))"

# The same rows by recursion: all levels of the sources' trees and of the tree of subroots, and each leaf's way up through both.
MANIFEST_SQL = f"""
with recursive leaves as (
  select doc_id, source, {_sql_leaf('text')} as leaf,
    case when {_SQL_CRC} & 1 = 1 then {_sql_leaf("replace(text, chr(10), '')")} else {_sql_leaf('text')} end as start from documents),
placed as (
  select *, row_number() over (order by source nulls first, doc_id nulls first, leaf) as id,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from leaves),
nodes as (
  select source, 0 as level, pos, n, leaf as node from placed
  union all
  select source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' order by pos)) from nodes where n > 1 group by source, level, pos // 3, n),
subs as (
  select source, node as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, pos, n, subroot as node from subs
  union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' order by pos)) from tops where n > 1 group by level, pos // 3, n),
low as (
  select id, source, 0 as level, pos, n, start as folded, '' as proof from placed
  union all
  select w.id, w.source, w.level + 1, w.pos // 3, (w.n + 2) // 3, sha256(string_agg(case when s.pos = w.pos then w.folded else s.node end, '' order by s.pos)),
    w.proof || coalesce(string_agg(case when s.pos <> w.pos then s.node end, '' order by s.pos), '')
  from low w join nodes s on s.source is not distinct from w.source and s.level = w.level and s.pos // 3 = w.pos // 3
  where w.n > 1 group by w.id, w.source, w.level, w.pos, w.n, w.folded, w.proof),
high as (
  select l.id, 0 as level, b.pos, b.n, l.folded, l.proof from low l join subs b on b.source is not distinct from l.source where l.n = 1
  union all
  select w.id, w.level + 1, w.pos // 3, (w.n + 2) // 3, sha256(string_agg(case when s.pos = w.pos then w.folded else s.node end, '' order by s.pos)),
    w.proof || coalesce(string_agg(case when s.pos <> w.pos then s.node end, '' order by s.pos), '')
  from high w join tops s on s.level = w.level and s.pos // 3 = w.pos // 3
  where w.n > 1 group by w.id, w.level, w.pos, w.n, w.folded, w.proof)
select p.doc_id, p.leaf, b.subroot, t.node as root, sha256(h.proof) as proof_sha256, h.folded as folded_root, h.folded = t.node as verified
from placed p join high h on h.id = p.id and h.n = 1 join subs b on b.source is not distinct from p.source join tops t on t.n = 1
"""
