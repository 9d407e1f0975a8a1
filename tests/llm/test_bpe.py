import base64
import hashlib
import struct

import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sojourn.llm import bpe, pretokens
from tests.llm import frames

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)


def pieces(texts):
    codes, _ = pretokens.codes_of(texts)
    return ["".join(map(chr, codes[a:b])) for a, b in zip(*pretokens.token_bounds(codes), strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZstrevmld'' \n\t\x1c\x85 19.,é!漢🙂İ\0")), max_size=4))
def test_pretokens_are_those_of_the_pattern(texts):
    assert pieces(texts) == [x for t in texts for x in PATTERN.findall(t)]


def digests(text):
    ids = ENCODING.encode_ordinary(text or "")
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_ids_and_round_trip(spark, monkeypatch):
    # Long texts are cut inside, and several blocks are made.
    monkeypatch.setattr(bpe, "STEP_CHARS", 3000)
    got = [tuple(r) for r in bpe.round_trip(frames.edge(spark), PATH).collect()]
    want = [(i, *digests(text)) for i, text in frames.EDGE]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bpe.round_trip(frames.nothing(spark), PATH).count() == 0


def test_decode_joins_the_token_table(spark):
    rows = bpe.token_table(spark, PATH).limit(1000).collect()
    assert all(RANKS[bytes(r["bytes"])] == r["id"] for r in rows)


def test_equal_hashes_of_two_words_are_told_apart(monkeypatch):
    import numpy as np

    class Blind:
        def __init__(self, values): ...

        def __call__(self, start, stop):
            return np.zeros(len(start), np.uint64)

    monkeypatch.setattr(bpe.ragged, "RangeHash", Blind)
    codes, _ = pretokens.codes_of(["ab cd ab"])
    starts, stops = pretokens.token_bounds(codes)
    _, first, count, word = bpe.distinct_words(codes, starts, stops)
    assert len(first) == 3 and word.tolist() == [0, 1, 2] and count.tolist() == [1, 1, 1]
