import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from staveframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(PATH)


def check(coder, library, texts):
    ids, counts = coder.encode(texts)
    back = coder.decode(ids, counts)
    at = 0
    for text, n, b in zip(texts, counts.tolist(), back, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want
        assert b.decode() == library.decode(want, skip_special_tokens=False) == text
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abc  \n\t'sd.,<|>0é漢\u00a0\x1c👍", "<|endoftext|>"]), max_size=60).map("".join), min_size=1, max_size=5))
def test_like_the_library(coder, library, texts):
    check(coder, library, texts)


def test_runs_and_long_words(coder, library):
    check(coder, library, ["a" * 5001, "abab" * 999, " " * 77 + "x", "", "don't you'll 's", "the cat" * 3000])


def test_forgets_and_goes_on(library):
    small = bpe.Coder(PATH, keep=3)
    for text in ("one two three four", "four five six", "one"):
        check(small, library, [text])


def test_decode_of_any_ids(coder):
    assert coder.decode(np.array([10**9, -5, 72]), np.array([3])) == coder.decode(np.array([72]), np.array([1]))


def test_table(docs, empty, rows, library):
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == len(rows)
    want = sorted((i or -1, *_digest(library, t or "")) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    again = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in again) == sorted((i or -1, t or "") for i, t in rows)
    assert bpe.round_trip(empty, PATH).count() == bpe.encode(empty, PATH).count() == 0


def _digest(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
