import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sojourn.llm import packing

JSON = open(public_tokenizers.path("word_bpe_49k.json")).read()
TOKENIZER = Tokenizer.from_str(JSON)
WORDS = packing.Words(JSON)


def check(words, texts):
    want = [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)] == want


def test_a_word_is_remembered_without_its_signs():
    """Words that differ in the signs at their end are one word."""
    words = packing.Words(JSON)
    check(words, ["kept, kept. kept; KEPT!? 17, 17% Été, été) ...", None, "", "a.b. %%% '' don't. ², x²."])
    assert {b"kept", "été".encode(), b"17", b"a.b", b"."} <= set(words.known)
    assert not {b"kept,", b"kept.", "été)".encode(), b"17,", b"17%", b"a.b."} & set(words.known)


def test_tasks_of_a_worker_share_what_they_learned():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["someword one", "two"]})
    first = [x.to_pylist() for x in packing.tokenize_pieces(JSON, 2048, 0)(iter([batch]))]
    assert b"someword" in packing.worker_words(JSON).known
    assert first == [x.to_pylist() for x in packing.tokenize_pieces(JSON, 2048, 0)(iter([batch]))]


def test_words_forgotten_in_between(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    words = packing.Words(JSON)
    for texts in (["one two three"], ["four, five. six seven"], ["one two. four %"], ["", None], ["a b c d e f g h, i"]):
        check(words, texts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZstre''.,!%;)-_~ \n\t\x1c\x1f\x85\xa0éÉßÿ×ºµª÷Ÿẞ̸́KÅİΣς1²٣漢🙂<|>\0"), max_size=30), max_size=5))
def test_ids_are_those_of_the_tokenizer(texts):
    check(WORDS, texts)
