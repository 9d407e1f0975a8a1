"""Best-fit packing of tokenised documents by a configuration linear program.

1. Every text is tokenised and cut into pieces of at most ``CAPACITY`` tokens; the pieces are written once.
2. The histogram of piece lengths (at most ``CAPACITY`` rows, whatever the corpus) is what the driver plans with. A configuration
   is a multiset of lengths that fits one sequence. The linear program asks for the fewest configurations that hold the histogram, that is,
   for as much of it as can be in full ones. Multiplicative weights solve it: a length's price rises as it is used up, and a
   knapsack over token counts finds the cheapest full configurations.
3. Multiplicities are rounded to whole numbers that fit, the program is solved again for what is left while that gains
   anything, and the rest goes by best fit, longest first; of these rounds as many count as give the fewest sequences.
4. Every piece gets its rank among the pieces of its length, and a table of rank intervals (its size is that of the
   histogram) names its sequence and offset.

Nulls: a null text is an empty one, and has the end token alone. Rows with equal or null ``doc_id`` are all packed. Columns other
than ``doc_id`` and ``text`` are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from sojourn.llm import ragged
from sojourn.llm.scratch import small_batches, written

CAPACITY = 2048
END_TOKEN = 0
# Bytes of texts handled at a time.
STEP_CHARS = 1_000_000
# Words whose ids a worker remembers.
CACHE_WORDS = 500_000
WORDS_AT_ONCE = 1000
# Lower-case letters of ASCII and Latin-1, which every step before the model leaves alone, and signs that do not join with what is before them.
LETTERS = "^[a-zß-öø-ÿ]+$"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}"
# Rows that are numbered together.
RANK_ROWS = 50_000
# Rounds of multiplicative weights at first and for what rounding leaves, and how fast prices rise.
ROUNDS = 8
AGAIN = 2
STEP = 8.0
# Lengths whose configurations are taken at the same prices.
PRICED = 32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


class Words:
    """Ids of words as bytes; each distinct word is tokenised once and remembered.

    Signs after a letter or digit are a word of their own for the tokenizer, too, so words are looked up without them. Most new words are
    letters alone. For these the normaliser and the pattern change nothing, so many go through the tokenizer's model as one text; an id with
    the end-of-word suffix ends each. Other new words go through the whole tokenizer, with a mark between them that is a word of its own. A
    text in which an added token of the vocabulary is written out (in any case) goes through it as a whole, which knows where such tokens count.
    """

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t.content.encode().lower().decode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {b"": b""}
        self.mark = self._encode("~")
        model = json.loads(tokenizer_json)["model"]
        suffix = model.get("end_of_word_suffix")
        self.letters = _letters_tokenizer(model) if model["type"] == "BPE" and suffix else None
        self.is_end = np.zeros(max(model["vocab"].values()) + 1, bool) if self.letters else None
        if self.letters:
            self.is_end[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn_letters(self, words: list[bytes]) -> None:
        for i in range(0, len(words) if self.letters else 0, WORDS_AT_ONCE):
            some = words[i : i + WORDS_AT_ONCE]
            text = b" ".join(some).decode()
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()
            # A vocabulary without all letters would leave some out.
            if len(stops) == len(some):
                raw = ids.tobytes()
                self.known.update(zip(some, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def _learn_marked(self, words: list[bytes]) -> None:
        # A mark of several ids, or one inside a word, would not part the words.
        plain = [w for w in words if b"~" not in w] if len(self.mark) == 1 else []
        for i in range(0, len(plain), WORDS_AT_ONCE):
            some = plain[i : i + WORDS_AT_ONCE]
            joined = " ~ ".join([w.decode() for w in some])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark[0])
            starts, stops = [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]
            raw = ids.tobytes()
            self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, starts, stops, strict=True))
        for w in words:
            if w not in self.known:
                self.known[w] = np.array(self._encode(w.decode()), "<u4").tobytes()

    def _learned(self, words: list[bytes], letters: np.ndarray) -> list[bytes]:
        """Ids of each word; ``letters`` tells which are letters alone."""
        known = self.known
        ids = list(map(known.get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            known[b""] = b""
            new = [i for i, w in enumerate(words) if w]
        if not new:
            return ids
        plain = letters[new].tolist()
        self._learn_letters([words[i] for i, x in zip(new, plain, strict=True) if x])
        self._learn_marked([w for i in new if (w := words[i]) not in known])
        return list(map(known.__getitem__, words))

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and where each word's start."""
        bare, tails, letters = parted(words)
        coded = bare.dictionary_encode()
        at = coded.indices.to_numpy()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        plain = np.zeros(len(distinct), bool)
        plain[at] = letters
        signs = tails.dictionary_encode()
        ends = signs.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = self._learned(distinct + ends, np.append(plain, np.zeros(len(ends), bool)))
        parts = np.stack([at, len(distinct) + signs.indices.to_numpy()], axis=1).ravel()
        flat, bounds = ragged.take(np.frombuffer(b"".join(ids), "<u4"), ragged.ends(np.fromiter(map(len, ids), np.int64, len(ids)) // 4), parts)
        return flat, bounds[::2]

    def flat_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's start."""
        # The tokenizer lower-cases, so spellings that differ in ASCII case are one word.
        lowered = pc.fill_null(pc.ascii_lower(texts), "")
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(lowered, token).to_numpy(zero_copy_only=False)
        if whole.any():
            lowered = pc.if_else(pa.array(whole), "", lowered)
        words = pc.ascii_split_whitespace(lowered)
        coded = words.flatten().dictionary_encode()
        flat, bounds = ragged.take(*self.word_ids(coded.dictionary), coded.indices.to_numpy())
        offsets = words.offsets.to_numpy()
        bounds = bounds[offsets - offsets[0]]
        if whole.any():
            parts = [np.array(self._encode(texts[i].as_py()), "<u4") if whole[i] else flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            flat, bounds = np.concatenate(parts), ragged.ends(np.array(list(map(len, parts))))
        return flat, bounds

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        flat, bounds = self.flat_ids(pa.array(texts, pa.string()))
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def parted(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Of each word what is before the signs at its end, these signs, and whether the first is letters alone. Capitals of Latin-1 become small.
    A word whose signs may join with what is before them stays whole."""
    bare = pc.ascii_rtrim(words, SIGNS)
    cut = (pc.binary_length(words).to_numpy() - pc.binary_length(bare).to_numpy()).astype(np.int64)
    letters = pc.match_substring_regex(bare, LETTERS).to_numpy(zero_copy_only=False)
    ends = letters | pc.match_substring_regex(bare, "[a-z0-9]$").to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(~letters & ~pc.string_is_ascii(bare).to_numpy(zero_copy_only=False))
    if len(odd):
        low = pa.array([w.lower() for w in bare.take(pa.array(odd)).to_pylist()], words.type)
        small = pc.match_substring_regex(low, LETTERS).to_numpy(zero_copy_only=False)
        odd, low = odd[small], low.filter(pa.array(small))
        letters[odd] = ends[odd] = True
        mask = np.zeros(len(words), bool)
        mask[odd] = True
        bare = pc.replace_with_mask(bare, mask, low)
    bare = pc.if_else(pa.array(ends), bare, words)
    cut[~ends] = 0
    signed = np.flatnonzero(cut)
    tails = np.full(len(words), "", object)
    tails[signed] = [w[-n:] for w, n in zip(words.take(pa.array(signed)).to_pylist(), cut[signed].tolist(), strict=True)]
    return bare, pa.array(tails, words.type), letters


def _letters_tokenizer(model: dict) -> Tokenizer:
    """The model alone, for words of letters parted by spaces. Words come once each, so it keeps none."""
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    tokenizer = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
    return tokenizer


def small_steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each as many as have ``STEP_CHARS`` bytes, or one longer text."""
    size = ragged.ends(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, size[a] + STEP_CHARS, side="right")) - 1)
        yield a, b
        a = b


@functools.lru_cache(maxsize=1)
def worker_words(tokenizer_json: str) -> Words:
    """The words that a worker has learned, for one task after the other."""
    return Words(tokenizer_json)


def tokenize_pieces(tokenizer_json: str, capacity: int, end_token: int):
    """Cuts the ids of each text and its end token into pieces.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(tokenizer_json)
        end = np.array([end_token], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for first, last in small_steps(batch.column("text")):
                flat, bounds = words.flat_ids(batch.column("text").slice(first, last - first))
                bounds = bounds.tolist()
                of, out = [], []
                for i in range(last - first):
                    ids = flat[bounds[i] : bounds[i + 1]].tobytes() + end
                    for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        of.append(first + i)
                        out.append((piece, a // 4, len(part) // 4, zlib.crc32(part)))
                columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 3), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(of)), *columns], PIECE_COLUMNS)

    return run


def cheapest_fill(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the lowest price of lengths that make up exactly each number of tokens, and the last length taken."""
    best = np.full(capacity + 1, np.inf)
    last = np.zeros(capacity + 1, np.int64)
    best[0] = 0.0
    for room in range(1, capacity + 1):
        n = np.searchsorted(lengths, room, side="right")
        if n:
            worth = prices[:n] + best[room - lengths[:n]]
            i = int(worth.argmin())
            best[room], last[room] = worth[i], lengths[i]
    return best, last


def configuration(first: int, last: np.ndarray, capacity: int) -> dict[int, int]:
    """The cheapest full configuration that holds the length ``first``."""
    out, room = {first: 1}, capacity - first
    while room > 0:
        out[int(last[room])] = out.get(int(last[room]), 0) + 1
        room -= int(last[room])
    return out


def multiplicative_weights(counts: dict[int, int], capacity: int, rounds: int) -> dict[tuple, float]:
    """Full configurations with fractional multiplicities that use no length more often than the histogram has it.

    Full configurations waste nothing, so the program's value is what they leave. A length's price per token is its weight,
    which is multiplied by a constant power of the share of its pieces that a step uses up. Each step takes the lengths
    used least so far, long ones ahead of short ones, which fill up anything, and for each the cheapest full
    configuration that a knapsack over token counts finds.
    """
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[x] for x in lengths.tolist()], float)
    place = {x: i for i, x in enumerate(lengths.tolist())}
    used = np.zeros(len(lengths))
    weight = np.ones(len(lengths))
    stuck = np.zeros(len(lengths), bool)
    found: dict[tuple, float] = {}
    while True:
        open_ = np.flatnonzero(used < 1 - 1e-9)
        todo = open_[~stuck[open_]]
        if not len(todo):
            return found
        usable = lengths[open_]
        best, last = cheapest_fill(usable, (weight * lengths / capacity)[open_], capacity)
        gained = False
        for mine in todo[np.argsort((used - lengths / capacity)[todo], kind="stable")[:PRICED]].tolist():
            length = int(lengths[mine])
            times = 0.0
            if np.isfinite(best[capacity - length]):
                parts = configuration(length, last, capacity)
                at = [(place[x], n) for x, n in parts.items()]
                times = min(need[mine] / parts[length] / rounds, *((1 - used[j]) * need[j] / n for j, n in at))
            if times <= 1e-12:
                # No full configuration, or its partners went in this very step.
                stuck[mine] = not gained
                continue
            gained = True
            key = tuple(sorted(parts.items()))
            found[key] = found.get(key, 0.0) + times
            for j, n in at:
                used[j] += n * times / need[j]
                weight[j] *= np.exp(STEP * n * times / need[j])


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first into the fullest sequence with room; equal sequences are handled together."""
    open_: dict[int, dict[tuple, int]] = {}
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(n, each)
                for size, times in ((each, full), (rest, 1)):
                    if size and times:
                        key = ((length, size),)
                        slot = open_.setdefault(capacity - length * size, {})
                        slot[key] = slot.get(key, 0) + times
                n = 0
                continue
            key, times = next(iter(open_[room].items()))
            take = min(n, times)
            n -= take
            for k, t in ((key, times - take), (None, take)):
                if not t and k is not None:
                    del open_[room][k]
                    if not open_[room]:
                        del open_[room]
                elif k is not None:
                    open_[room][k] = t
            parts = dict(key)
            parts[length] = parts.get(length, 0) + 1
            new = tuple(sorted(parts.items()))
            slot = open_.setdefault(room - length, {})
            slot[new] = slot.get(new, 0) + take
    return [(dict(key), times) for slot in open_.values() for key, times in slot.items()]


def whole_configurations(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations with whole multiplicities that hold exactly the pieces of the histogram."""
    left = {x: n for x, n in counts.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []

    def use(parts: dict[int, int], most: int) -> None:
        times = min([most, *(left.get(x, 0) // n for x, n in parts.items())])
        if times > 0:
            out.append((parts, times))
            for x, n in parts.items():
                left[x] -= n * times
                if not left[x]:
                    del left[x]

    # Rounding down leaves less each time; the program is solved again for what is left. What best fit makes of the rest
    # decides after how many of these rounds to stop.
    rest = best_fit(left, capacity)
    taken, fewest = 0, sum(n for _, n in rest)
    while left:
        before = len(out)
        fractional = multiplicative_weights(left, capacity, ROUNDS if not out else AGAIN)
        for whole in (True, False):
            for key, times in sorted(fractional.items(), key=lambda x: (-(x[1] % 1), x[0])):
                use(dict(key), int(times) if whole else int(times % 1 > 0))
        if len(out) == before:
            break
        fitted = best_fit(left, capacity)
        total = sum(n for _, n in out) + sum(n for _, n in fitted)
        if total <= fewest:
            rest, taken, fewest = fitted, len(out), total
    return out[:taken] + rest


def intervals(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """For each length in turn: ranks from ``rank`` on, ``copies`` to a sequence, from ``sequence`` and ``offset`` on."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, times in plan:
        offset = 0
        for length in sorted(parts, reverse=True):
            n = parts[length]
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """A rank from 0 for each piece among those of its length. Pieces are numbered inside shares of about
    ``RANK_ROWS`` rows; only the share counts of a length meet."""
    shares = max(1, -(-total // RANK_ROWS))
    dealt = pieces.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    counts = dealt.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_share").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("_at", F.row_number().over(inside))
    return numbered.join(starts, ["length", "_share"]).withColumn("_rank", F.col("_before") + F.col("_at") - 1)


def place(plan: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One number orders (length, rank): the ranks of a length stay below 2^44.
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame["_rank"].to_numpy(np.int64)
            row = plan[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(plan) else np.zeros((0, 5), np.int64)
            past = rank - row[:, 1]
            sequence = row[:, 3] + past // row[:, 2]
            yield frame.drop(columns="_rank").assign(sequence_id=sequence, offset=row[:, 4] + past % row[:, 2] * length)

    return run


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    small_batches(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenize_pieces(tokenizer_json, capacity, end_token), PIECES)
    pieces = written(cut, "pieces")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = intervals(whole_configurations(counts, capacity))
    # Ids go through Python as text, since pandas has no whole numbers with nulls.
    rows = ranked(pieces, sum(counts.values())).select(
        F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32", "_rank"
    )
    placed = rows.mapInPandas(place(plan), PIECES.replace("doc_id long", "doc_id string") + ", sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))
