"""Byte-level BPE: every distinct word of the corpus is encoded once, and ids are decoded by the token table.

1. Texts are cut into pre-tokens in blocks of bounded size. A block keeps the position of each pre-token as an index
   into the block's own list of distinct words.
2. The lists are exploded into (block, bucket) rows, where the bucket is a hash of the word, and shuffled by bucket. So
   all copies of a word in the corpus meet in one task, which runs the merges for it once.
3. The ids go back to their blocks in a second shuffle and are laid out by position.

A word that is in every text is one entry per block in the shuffle, so no key is hot. What a task holds at a time is one block or
the words of one bucket with their ids; buckets follow each other within a task, and their number grows with the shuffle's.

Nulls: a null text is an empty one (no ids). Rows with equal or null ``doc_id`` are all kept. Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm import pretokens, ragged
from sojourn.llm.scratch import small_batches

# Characters handled at a time; a longer text is cut before a space.
STEP_CHARS = 250_000
# A block ends at so many distinct words or characters.
BLOCK_WORDS = 400_000
BLOCK_CHARS = 8_000_000
# Buckets of words for each partition of a shuffle.
BUCKETS = 8
# Occurrences compared with their word at a time.
COMPARED = 100_000
# Tokens laid out at a time.
CHUNK_TOKENS = 200_000

LISTS = "block long, mark long, bucket int, n int, words binary"
TEXTS = "block long, mark long, doc_ids array<long>, n_pretokens array<long>, positions array<binary>, word_buckets binary"


def read_ranks(path: str) -> bytes:
    """The rank file as it is; the driver reads it and tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of equal place, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.ZstdCompressor(level=3).compress(lengths.tobytes() + b"".join(words))


def unpack_words(raw: bytes, n: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    at = 4 * n + ragged.ends(np.frombuffer(data[: 4 * n], "<u4").astype(np.int64))
    return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def distinct_words(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """One occurrence of each distinct word, its hash and count, and the word number of every occurrence."""
    hashes = ragged.RangeHash(codes)(starts, stops)
    values, first, word, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    # Equal hashes must be equal words; should they ever not be, words are told apart by their characters.
    long = stops - starts
    same = np.array_equal(long, long[first][word])
    for i in range(0, len(starts) * same, COMPARED):
        some = slice(i, i + COMPARED)
        at = ragged.ends(long[some])
        inside = np.arange(at[-1]) - np.repeat(at[:-1], long[some])
        here, there = np.repeat(starts[some], long[some]), np.repeat(starts[first][word[some]], long[some])
        same = same and np.array_equal(codes[here + inside], codes[there + inside])
    if not same:
        words = [codes[a:b].tobytes() for a, b in zip(starts, stops, strict=True)]
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        word = np.array([known[w] for w in words])
        count = np.bincount(word)
        first = np.full(len(known), len(words))
        np.minimum.at(first, word, np.arange(len(words)))
        values = hashes[first]
    return values, first, count, word


def check_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A second hash of each word, unlike the first."""
    at = ragged.ends(stops - starts)
    inside = np.arange(at[-1]) - np.repeat(at[:-1], stops - starts)
    terms = ragged.splitmix(codes[np.repeat(starts, stops - starts) + inside].astype(np.uint64) * np.uint64(0x10001) + inside.astype(np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return sums[at[1:]] - sums[at[:-1]]


class Block:
    """Texts whose pre-tokens are kept as numbers of distinct words, in order of first appearance."""

    def __init__(self, number: int, n_buckets: int):
        self.number, self.n_buckets = number, n_buckets
        self.ids: list = []
        self.per_text: list[int] = []
        self.positions: list[bytes] = []
        self.words: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)
        self.numbers = np.zeros(0, np.int64)
        self.checks = np.zeros(0, np.uint64)
        self.buckets = np.zeros(0, np.int64)
        self.size = 0

    def add(self, doc_ids: list, texts: list[str], goes_on: bool) -> bool:
        """Takes the texts in (the first may go on the last one), unless a hash means two words."""
        codes, firsts = pretokens.codes_of(texts)
        starts, stops = pretokens.token_bounds(codes)
        if len(starts):
            values, first, _, word = distinct_words(codes, starts, stops)
            checks = check_hashes(codes, starts[first], stops[first])
            at = np.minimum(np.searchsorted(self.hashes, values), max(0, len(self.hashes) - 1))
            old = self.hashes[at] == values if len(self.hashes) else np.zeros(len(values), bool)
            if (self.checks[at[old]] != checks[old]).any() or len(np.unique(values)) < len(values):
                if len(self.hashes):
                    return False
            # New words are numbered as they appear, so their numbers follow each other.
            new = np.flatnonzero(~old)
            new = new[np.argsort(first[new], kind="stable")]
            number = np.empty(len(values), np.int64)
            number[old] = self.numbers[at[old]]
            number[new] = len(self.words) + np.arange(len(new))
            where = zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)
            self.words += ["".join(map(chr, codes[a:b].tolist())).encode() for a, b in where]
            self.buckets = np.concatenate([self.buckets, (values[new] % np.uint64(self.n_buckets)).astype(np.int64)])
            hashes = np.concatenate([self.hashes, values[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes = hashes[order]
            self.numbers = np.concatenate([self.numbers, number[new]])[order]
            self.checks = np.concatenate([self.checks, checks[new]])[order]
            self.positions.append(pack(number[word]))
        counts = np.diff(np.searchsorted(starts, firsts)).tolist()
        if goes_on:
            self.per_text[-1] += counts.pop(0)
        self.per_text += counts
        self.ids += [None if pd.isna(x) else int(x) for x in doc_ids]
        self.size += len(codes)
        return True

    def mark(self) -> int:
        """A checksum of the block's texts and words."""
        sizes = np.array([len(self.ids), self.size, len(self.words)], np.int64)
        return zlib.crc32(self.checks.tobytes() + self.numbers.tobytes() + sizes.tobytes() + repr(self.ids).encode())

    def lists(self) -> pd.DataFrame:
        rows = []
        grouped = np.argsort(self.buckets, kind="stable")
        at = np.flatnonzero(np.diff(self.buckets[grouped], prepend=-1))
        mark = self.mark()
        for a, b in zip(at, [*at[1:], len(grouped)][: len(at)], strict=True):
            some = grouped[a:b].tolist()
            rows.append((self.number, mark, int(self.buckets[some[0]]), b - a, pack_words([self.words[i] for i in some])))
        return pd.DataFrame(rows, columns=["block", "mark", "bucket", "n", "words"])

    def texts(self) -> pd.DataFrame:
        # The bucket of each word tells where its ids are when they come back.
        row = (self.number, self.mark(), self.ids, self.per_text, self.positions, pack(self.buckets))
        return pd.DataFrame([row], columns=["block", "mark", "doc_ids", "n_pretokens", "positions", "word_buckets"])


def steps(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str], bool]]:
    """Texts in steps of bounded size: ids, texts, and whether the first goes on the last text of the step before."""
    ids, texts, size = [], [], 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            text = text if isinstance(text, str) else ""
            if texts and size + len(text) > STEP_CHARS:
                yield ids, texts, False
                ids, texts, size = [], [], 0
            goes_on = False
            while len(text) > STEP_CHARS:
                # Before a space that follows something else, no match reaches across.
                cut = re.compile(r"(?<=\S) ").search(text, STEP_CHARS)
                if not cut:
                    break
                yield [] if goes_on else [doc_id], [text[: cut.start()]], goes_on
                text, goes_on = text[cut.start() :], True
            if goes_on:
                yield [], [text], True
                continue
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts, False


def to_blocks(n_buckets: int, what: Callable[[Block], pd.DataFrame]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(TaskContext.get().partitionId() << 32, n_buckets)
        for ids, texts, goes_on in steps(frames):
            full = len(block.words) >= BLOCK_WORDS or block.size >= BLOCK_CHARS
            if not goes_on and block.ids and full or not block.add(ids, texts, goes_on):
                if goes_on:
                    raise ValueError("two words of one text have one hash")
                yield what(block)
                block = Block(block.number + 1, n_buckets)
                block.add(ids, texts, False)
        if block.ids:
            yield what(block)

    return run


def encode_words(ranks: bytes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Every word is one match, so the merges see it whole.
        encoding = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=parse_ranks(ranks), special_tokens={})
        # The ids of a bucket's words, each encoded once; its rows follow each other.
        known: dict[bytes, bytes] = {}
        now = None
        for frame in frames:
            out = []
            for block, mark, bucket, n, raw in zip(*(frame[c] for c in ("block", "mark", "bucket", "n", "words")), strict=True):
                if bucket != now:
                    known, now = {}, bucket
                words = unpack_words(raw, n)
                for word in words:
                    if word not in known:
                        known[word] = np.array(encoding.encode_ordinary(word.decode()), "<u4").tobytes()
                ids = [known[word] for word in words]
                lengths = np.fromiter(map(len, ids), np.int64, n) // 4
                out.append((block, mark, bucket, pack(lengths), pack(np.frombuffer(b"".join(ids), "<u4"))))
            yield pd.DataFrame(out, columns=["block", "mark", "bucket", "lengths", "ids"])

    return run


def lay_out(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The ids of a block's texts by position."""
    if block.empty:
        raise ValueError("the rows came in another order when they were read again; write them to a table first")
    row = block.iloc[0]
    # Ids came back by bucket, and within a bucket in the order of the block's list.
    listed = np.argsort(unpack(row["word_buckets"]), kind="stable")
    found = found.sort_values("bucket")
    lengths = np.concatenate([np.zeros(0, np.int64), *(unpack(x).astype(np.int64) for x in found["lengths"])])
    ids = np.concatenate([np.zeros(0, "<u4"), *(unpack(x) for x in found["ids"])])
    if len(listed) != len(lengths):
        raise ValueError("a word of the block has no ids")
    place = np.empty(len(listed), np.int64)
    place[listed] = np.arange(len(listed))
    at = ragged.ends(lengths)
    parts, sizes = [], []
    for raw in row["positions"]:
        words = unpack(raw)
        for i in range(0, len(words), CHUNK_TOKENS):
            flat, bounds = ragged.take(ids, at, place[words[i : i + CHUNK_TOKENS]])
            parts.append(flat.tobytes())
            sizes.append(np.diff(bounds).astype(np.uint8 if lengths.max() < 256 else np.uint32))
    flat, size = b"".join(parts), np.concatenate([np.zeros(0, np.uint8), *sizes])
    per_word = ragged.ends(size)
    bounds = 4 * per_word[ragged.ends(np.asarray(row["n_pretokens"], np.int64))]
    out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    doc_ids = pd.array([None if pd.isna(x) else int(x) for x in row["doc_ids"]], dtype="Int64")
    return pd.DataFrame({"doc_id": doc_ids, "n_tokens": np.diff(bounds) // 4, "ids": out})


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every whole text. The rows are read twice and must
    come in the same order, as those of files do; if they do not, the query fails."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = read_ranks(ranks_path)
    n_buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ids go through Python as text, since pandas has no whole numbers with nulls.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    # The texts are cut twice rather than written and shuffled: the same files give the same blocks, and ids reach a block
    # only under its checksum.
    lists = texts.mapInPandas(to_blocks(n_buckets, Block.lists), LISTS).repartition("bucket").sortWithinPartitions("bucket")
    ids = lists.mapInPandas(encode_words(ranks), "block long, mark long, bucket int, lengths binary, ids binary")
    blocks = texts.mapInPandas(to_blocks(n_buckets, Block.texts), TEXTS).groupBy("block", "mark")
    return blocks.cogroup(ids.groupBy("block", "mark")).applyInPandas(lay_out, "doc_id long, n_tokens long, ids binary")


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """(id, bytes) of every token of a vocabulary; its size is that of the vocabulary file."""
    known = sorted((i, bytearray(t)) for t, i in parse_ranks(read_ranks(ranks_path)).items())
    return spark.createDataFrame(known, "id long, bytes binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of all ids. The token table has as many rows as the vocabulary, so every task holds it
    whole and looks up all ids of a text at once. An unknown id is an error."""
    ranks = read_ranks(ranks_path)

    @F.pandas_udf("binary")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = parse_ranks(ranks)
        lengths = np.full(max(known.values(), default=0) + 1, -1, np.int64)
        for token, i in known.items():
            lengths[i] = len(token)
        at = ragged.ends(np.maximum(lengths, 0))
        flat = np.frombuffer(b"".join(t for t, _ in sorted(known.items(), key=lambda x: x[1])), np.uint8)
        for column in columns:
            out = []
            for raw in column:
                ids = np.frombuffer(raw or b"", "<u4")
                if len(ids) and (ids.max() >= len(lengths) or lengths[ids].min() < 0):
                    raise ValueError("an id is not in the token table")
                parts = [
                    ragged.take(flat, at, ids[i : i + CHUNK_TOKENS].astype(np.int64))[0].tobytes()
                    for i in range(0, len(ids), CHUNK_TOKENS)
                ]
                out.append(b"".join(parts))
            yield pd.Series(out, dtype=object)

    return encoded.withColumn("decoded", run("ids"))


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Ids and decoded bytes of every text as digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    both = decode(encode(docs, ranks_path), ranks_path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
