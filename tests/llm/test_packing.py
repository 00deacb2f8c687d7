import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from staveframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = packing.WordTokens(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*"abC.,!_'s \n\x1c\xa0Éé\u0301Σσİ漢3²", "<|endoftext|>"]), max_size=50).map("".join))
def test_like_the_library(text):
    ids, _ = WORDS.encode([text])
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, dtype=np.int64), 100)
    rooms: list[int] = []
    for i in np.argsort(-np.array(lengths, dtype=np.int64), kind="stable"):
        at = next((b for b, left in enumerate(rooms) if left >= lengths[i]), len(rooms))
        if at == len(rooms):
            rooms.append(100)
        assert (bins[i], offsets[i]) == (at, 100 - rooms[at])
        rooms[at] -= lengths[i]


def test_table(docs, empty, rows):
    got = packing.pack_documents(docs, PATH, group_size=4).toPandas()
    want = [[*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]
    assert got.length.sum() == sum(map(len, want)) and got.length.between(1, 4096).all()
    by_id = {i: ids for (i, _), ids in zip(rows, want, strict=True)}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        ids = by_id[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all() and g.length.sum() <= 4096
    assert packing.pack_documents(empty, PATH).count() == 0


def test_other_tokenizer():
    """A tokenizer that doesn't drop white space gets whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.WordTokens(path)
    rows = ["Two  Words, here.\n", "", "x\x1c.y"]
    ids, counts = own.encode(rows)
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]
