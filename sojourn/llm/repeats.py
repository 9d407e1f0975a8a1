"""Removes every byte that a long string covers which also starts anywhere else in the corpus.

The test of suffix arrays for long common prefixes, in blocks that Spark can shuffle:

1. Equal texts become one text with a count.
2. Every string of ``least`` bytes has an anchor: the leftmost of its ``ANCHOR``-byte parts of lowest hash. Equal strings have equal anchors
   at equal places. Strings that follow each other and have one anchor are one row, about one for 170 bytes. Rows of a text with equal
   bytes (a line that it repeats, a run of one letter) are one row with several places.
3. Rows whose anchor occurs once go. Rows with equal bytes throughout are repeats as a whole, and one of them stays for comparison.
4. The bytes of the rows that are left are gathered in blocks in which all rows of an anchor meet. In a block the
   Burrows-Wheeler transform gives all strings that occur twice, by threshold-bounded interval expansion (``suffixes``).
5. An anchor with more than ``HOT`` different rows (a common passage in many contexts) is narrowed first: its rows are cut into
   runs of ``NARROW`` starts, runs whose common bytes occur once go, and the starts of the others are counted by the hash of
   their string, which no hot anchor can hold up.
6. The starts found become covered bytes of each text.

All copies of a string are repeats, the first one too, and strings are judged on the input. Nulls: a null text is an empty one;
texts shorter than ``least`` are kept. Rows with equal or null ``doc_id`` are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm import ragged, shingles, suffixes
from sojourn.llm.scratch import small_batches, written

LEAST = 400
ANCHOR = 64
# Different rows of an anchor beyond which it is narrowed, and starts in a run then.
HOT = 500
NARROW = 16
# Bytes compared in one block, and starts looked at in one step.
BLOCK_BYTES = 500_000
STEP_STARTS = 250_000

ROWS = "array<struct<f:long,whole:long,at:long,first:long,last:long,more:array<struct<first:long,last:long>>>>"
PLACES = "t long, first long, last long"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values that follow each other."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchored(raw: bytes, bounds: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Rows of strings with one anchor, of texts end to end: text number, anchor hash, hash of all bytes, anchor, first and last start."""
    data = np.frombuffer(raw, np.uint8)
    nothing = np.zeros(0, np.int64)
    if len(data) < least:
        return (nothing,) * 6
    hashes = ragged.RangeHash(data)
    starts = np.arange(len(data) - anchor + 1)
    low = hashes(starts, starts + anchor)
    # The upper bits order the parts, the lower ones name the leftmost place.
    bits = np.uint64(max(1, len(data).bit_length()))
    place = (low >> bits << bits) | starts.astype(np.uint64)
    best = (sliding_least(place, least - anchor + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(len(best)), side="right") - 1
    inside = np.arange(len(best)) + least <= bounds[text + 1]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    run = np.cumsum(new)
    ends = np.flatnonzero(np.append(run[1:] != run[:-1], True) | ~np.append(inside[1:], False))
    ends = ends[inside[ends]]
    last = ends[np.searchsorted(ends, first)] if len(first) else first
    return text[first], low[best[first]].view(np.int64), hashes(first, last + least).view(np.int64), best[first], first, last


def text_rows(raw: bytes, least: int, anchor: int) -> list[tuple]:
    """The rows of one text, in steps that bound memory."""
    out = []
    for a in range(0, max(1, len(raw) - least + 1), STEP_STARTS):
        part = raw[a : a + STEP_STARTS + least - 1]
        _, f, whole, at, first, last = anchored(part, np.array([0, len(part)]), least, anchor)
        out += zip(f.tolist(), whole.tolist(), (at + a).tolist(), (first + a).tolist(), (last + a).tolist(), strict=True)
    return out


def one_of_equal(rows: list[tuple]) -> list[tuple]:
    """The first of a text's rows with equal bytes, with the places of the others."""
    out: dict[tuple, tuple] = {}
    for f, whole, at, first, last in rows:
        if (f, whole) in out:
            out[f, whole][5].append((first, last))
        else:
            out[f, whole] = (f, whole, at, first, last, [])
    return list(out.values())


def anchor_rows(least: int, anchor: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, sizes = [], []
            for _, raws in shingles.text_slices(list(frame["text"])):
                sizes += map(len, raws)
                if len(raws) == 1:
                    rows.append(one_of_equal(text_rows(raws[0], least, anchor)))
                    continue
                bounds = ragged.ends(np.array(list(map(len, raws))))
                text, f, whole, at, first, last = anchored(b"".join(raws), bounds, least, anchor)
                columns = [x.tolist() for x in (f, whole, at - bounds[text], first - bounds[text], last - bounds[text])]
                every = list(zip(*columns, strict=True))
                cut = np.searchsorted(text, np.arange(len(raws) + 1))
                rows += [one_of_equal(every[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pd.DataFrame({"key": frame["key"], "n": sizes, "rows": rows})

    return run


def cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the asked rows of each text."""
    for frame in frames:
        out = []
        for text, asked in zip(frame["text"], frame["asked"], strict=True):
            raw = text.encode()
            for x in asked:
                out.append((x["t"], x["f"], x["hot"], x["at"], x["first"], x["last"], raw[x["first"] : x["stop"]]))
        yield pd.DataFrame(out, columns=["t", "f", "hot", "at", "first", "last", "bytes"])


def runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(marked.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def compare_blocks(least: int):
    """Rows come sorted by anchor; a block ends between two anchors."""

    def block(rows: list[tuple]) -> pd.DataFrame:
        marks = suffixes.repeated_starts([r[2] for r in rows], least)
        out = [(t, first + a, first + b) for (t, first, _), m in zip(rows, marks, strict=True) for a, b in runs(m)]
        return pd.DataFrame(out, columns=["t", "first", "last"], dtype="int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, now = [], 0, None
        for frame in frames:
            for t, f, first, raw in zip(frame["t"], frame["f"], frame["first"], frame["bytes"], strict=True):
                if f != now and size >= BLOCK_BYTES:
                    yield block(rows)
                    rows, size = [], 0
                now = f
                rows.append((t, first, raw))
                size += len(raw)
        if rows:
            yield block(rows)

    return run


def narrow_runs(least: int):
    """Runs of ``NARROW`` starts, counted from the anchor, with the hash of the bytes that all strings of the run share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t, f, at, first, last, raw in zip(*(frame[c] for c in ("t", "f", "at", "first", "last", "bytes")), strict=True):
                hashes = ragged.RangeHash(np.frombuffer(raw, np.uint8))
                number = np.arange((at - last) // NARROW, (at - first) // NARROW + 1)
                a, b = at - number * NARROW - first, at - number * NARROW - NARROW + 1 + least - first
                core = hashes(a, b).view(np.int64)
                low = np.maximum(at - number * NARROW - NARROW + 1, first)
                high = np.minimum(at - number * NARROW, last)
                out += [(t, f, first, k, c, x, y) for k, c, x, y in zip(*(v.tolist() for v in (number, core, low, high)), strict=True)]
            yield pd.DataFrame(out, columns=["t", "f", "row", "number", "core", "first", "last"])

    return run


def string_hashes(least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t, f, row, raw, asked in zip(*(frame[c] for c in ("t", "f", "row", "bytes", "asked")), strict=True):
                hashes = ragged.RangeHash(np.frombuffer(raw, np.uint8))
                starts = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in asked])
                found = hashes(starts - row, starts - row + least).view(np.int64)
                out += [(t, f, h, s) for h, s in zip(found.tolist(), starts.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["t", "f", "string", "first"])

    return run


def hot_marks(rows: DataFrame, least: int) -> DataFrame:
    """Repeated starts of rows of hot anchors, by counts of strings."""
    narrow = written(rows.mapInPandas(narrow_runs(least), "t long, f long, row long, number long, core long, first long, last long"), "narrow")
    shared = written(narrow.groupBy("f", "number", "core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "narrow-shared")
    left = narrow.join(shared, ["f", "number", "core"])
    asked = left.groupBy("t", "row").agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    again = rows.select("t", "f", F.col("first").alias("row"), "bytes").join(asked, ["t", "row"])
    strings = written(again.mapInPandas(string_hashes(least), "t long, f long, string long, first long"), "strings")
    twice = written(strings.groupBy("f", "string").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "strings-shared")
    return strings.join(twice, ["f", "string"]).select("t", "first", F.col("first").alias("last"))


def without_marks(least: int):
    """What is left of each text, and how much went."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, copies, marks in zip(frame["key"], frame["text"], frame["copies"], frame["marks"], strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                if copies > 1 and len(raw) >= least:
                    edge[0], edge[-1] = 1, -1
                elif marks is not None and len(marks):
                    np.add.at(edge, [x["first"] for x in marks], 1)
                    np.add.at(edge, [x["last"] + least for x in marks], -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = raw[~gone].tobytes()
                # As text, a character goes as a whole.
                character = np.cumsum((raw & 0xC0) != 0x80) - 1
                broken = np.bincount(character, weights=gone, minlength=1) > 0
                left = raw[~broken[character]].tobytes().decode()
                out.append((key, len(raw), int(gone.sum()), len(runs(gone)), hashlib.sha256(kept).hexdigest(), kept, left))
            yield pd.DataFrame(out, columns=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "left"])

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def cleaned_texts(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """For each distinct ``text`` its ``key``, ``n_bytes, n_removed, n_spans, kept_sha256, kept`` and ``left``, what is kept as text, without
    characters that lost one of their bytes."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(text_key(F.col("text")).alias("key"), text.alias("text"))
    # One text of each key; copies are folded where they are read.
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    scanned = keyed.mapInPandas(anchor_rows(least, anchor), f"key binary, n long, rows {ROWS}")
    folded = scanned.groupBy("key").agg(F.first("rows").alias("rows"))
    known = written(folded.withColumn("t", F.monotonically_increasing_id()), "anchors")

    rows = known.select("t", F.inline("rows"))
    places = F.sum(1 + F.size("more")).alias("k")
    often = written(rows.groupBy("f").agg(places).filter("k > 1").drop("k"), "anchors-shared")
    shared = written(rows.join(often, "f"), "rows-shared")
    same = shared.groupBy("f", "whole").agg(places, F.min(F.struct("t", "at", "first", "last")).alias("one"))
    same = written(same, "rows-folded")
    here = F.array(F.struct("first", "last")).alias("places")
    whole = shared.join(same.filter("k > 1").select("f", "whole"), ["f", "whole"]).select("t", F.concat(here, "more").alias("places"))

    kinds = written(same.groupBy("f").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "anchors-mixed")
    asked = same.join(kinds, "f").select("one.t", "f", (F.col("kinds") > HOT).alias("hot"), "one.at", "one.first", "one.last")
    asked = asked.withColumn("stop", F.col("last") + least)
    # A text has one number, so its places are gathered before they meet its key.
    asked = asked.groupBy("t").agg(F.collect_list(F.struct("t", "f", "hot", "at", "first", "last", "stop")).alias("asked"))
    asked = asked.join(known.select("t", "key"), "t").drop("t")
    cut = texts.select("key", "text").join(asked, "key").select("text", "asked")
    strings = written(cut.mapInPandas(cut_out, "t long, f long, hot boolean, at long, first long, last long, bytes binary"), "row-bytes")
    blocks = strings.filter("not hot").select("t", "f", "first", "bytes").repartition("f").sortWithinPartitions("f")
    marks = blocks.mapInPandas(compare_blocks(least), PLACES).unionByName(hot_marks(strings.filter("hot"), least))
    marks = marks.select("t", here).unionByName(whole)
    marks = marks.groupBy("t").agg(F.flatten(F.collect_list("places")).alias("marks")).join(known.select("t", "key"), "t").drop("t")
    return texts.join(marks, "key", "left").mapInPandas(
        without_marks(least), "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, left string"
    )


def remove_repeats(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (of the bytes that stay) and ``has_repeats``, whether any byte went."""
    digests = written(cleaned_texts(docs.select("text"), least, anchor).drop("kept", "left"), "kept-digests")
    found = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(digests, "key").drop("key")
    return found.withColumn("has_repeats", F.col("n_removed") > 0)


def kept_documents(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """The documents with what is left of their texts. A character that lost one of its bytes goes as a whole; a null text stays null,
    and a document that had text and has none left goes. ``n_chars``, where there is one, is counted anew. Other columns stay as they are,
    whatever their names."""
    texts = cleaned_texts(docs.select("text"), least, anchor)
    left = written(texts.filter("n_removed > 0").select(F.col("key").alias("of"), "left"), "kept-texts")
    # The caller's columns go by place, so no name can clash.
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): names[i] for i, c in enumerate(docs.columns)}
    whole = docs.toDF(*names).withColumn("key", text_key(F.col(at["text"])))
    joined = whole.join(left, F.col("key") == F.col("of"), "left").filter("left is null or left <> ''")
    out = {at["text"]: F.coalesce("left", at["text"])}
    if "n_chars" in at:
        kind = docs.schema[docs.columns[names.index(at["n_chars"])]].dataType
        out[at["n_chars"]] = F.when(F.col("left").isNull(), F.col(at["n_chars"])).otherwise(F.length("left")).cast(kind)
    return joined.withColumns(out).select(*names).toDF(*docs.columns)
