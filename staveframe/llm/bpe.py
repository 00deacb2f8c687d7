"""Operator 1: byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces (words with their leading space, as the vocabulary's splitting pattern cuts them) of
a chunk of a partition are laid end to end. An index maps every adjacent pair that has a merge rank to all
of its positions. Active ranks are taken in ascending order; all occurrences of a rank are merged at once
and the lists of the pairs that this creates are updated. A worker keeps what it has encoded, so that each
distinct piece of a partition goes through the index once (until ``keep`` pieces are held, then it starts anew).

Every document is a row of its own, so there is no shuffle, and a lost task redoes its own split only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveframe.llm._batches import chunks, ragged, texts

# The splitting pattern of the byte-level vocabulary, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Texts in which white space is only single blanks and line feeds are cut without the pattern.
UNEVEN = re.compile("[ \n][ \n]|[\x00\t\r\f\v\x85\xa0  -     　]")


def byte_symbols() -> list[str]:
    """The printable symbol that the vocabulary file writes for each byte: printable Latin-1 stands for
    itself, the others get the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Byte-level BPE vocabulary: ids of bytes, merge ranks and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = np.array([ids[s] for s in symbols], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        made = np.full(max(ids.values()) + 1, -1, dtype=np.int64)
        made[self.merged] = np.arange(len(pairs))
        if len(pairs) and (np.maximum(made[self.left], made[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a token that only a later merge makes; ranks cannot be taken in order")
        keys = (self.left << 32) | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        back = {s: b for b, s in enumerate(symbols)}
        table = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        table |= {i: token.encode() for token, i in self.special.items()}
        self.size = max(table) + 1
        parts = [table.get(i, b"") for i in range(self.size)]
        self.token_len = np.array([len(p) for p in parts], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(left), -1, dtype=np.int64)
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], -1)


def merge_all(vocab: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces laid end to end, and how many each piece has, through the pair occurrence index."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    token = vocab.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    n = len(token)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(sizes)[sizes > 0]
    after[ends - 1] = -1
    before[np.r_[0, ends[:-1]]] = -1
    alive = np.ones(n, dtype=bool)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(positions: np.ndarray) -> None:
        """Adds the pairs that begin at these positions to the index."""
        rank = vocab.ranks(token[positions], token[after[positions]])
        positions, rank = positions[rank >= 0], rank[rank >= 0]
        if not len(rank):
            return
        by = np.argsort(rank, kind="stable")
        rank, positions = rank[by], positions[by]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, own in zip(rank[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
            if r in index:
                index[r].append(own)
            else:
                index[r] = [own]
                heapq.heappush(active, r)

    enter(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        a, b = vocab.left[r], vocab.right[r]
        at = at[alive[at] & (token[at] == a)]
        second = after[at]
        held = (second >= 0) & (token[second] == b)
        at, second = at[held], second[held]
        if a == b and len(at) > 1:  # runs such as "aaaa": every other position, from the left
            joined = np.r_[False, second[:-1] == at[1:]]
            first = np.maximum.accumulate(np.where(~joined, np.arange(len(at)), 0))
            even = (np.arange(len(at)) - first) % 2 == 0
            at, second = at[even], second[even]
        if not len(at):
            continue
        token[at] = vocab.merged[r]
        alive[second] = False
        following = after[second]
        after[at] = following
        linked = following >= 0
        before[following[linked]] = at[linked]
        ahead = before[at]
        enter(np.unique(np.concatenate([ahead[ahead >= 0], at[after[at] >= 0]])))
    return token[alive], np.bincount(piece[alive], minlength=len(pieces))


class Coder:
    """Encodes and decodes texts; holds the ids of up to ``keep`` distinct pieces between calls."""

    def __init__(self, path: str, keep: int = 300_000):
        self.vocab, self.keep = Vocabulary(path), keep
        self.pattern = regex.compile(PATTERN)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.vocab.special, key=len, reverse=True))) + ")") if self.vocab.special else None
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids, self.at, self.len = (np.zeros(0, dtype=np.int64) for _ in range(3))
        for name, i in self.vocab.special.items():
            self._add([name], np.array([i]), np.array([1]))

    def _add(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.seen.update(zip(names, range(len(self.at), len(self.at) + len(names)), strict=True))
        self.at = np.r_[self.at, len(self.ids) + np.cumsum(counts) - counts]
        self.len, self.ids = np.r_[self.len, counts], np.r_[self.ids, ids]

    def _blocks(self, text: str) -> list[str]:
        """Cuts a text where no piece can reach across: before single blanks and around line feeds; else by the pattern."""
        if self.specials and "<|" in text and self.specials.search(text):
            return [b for k, part in enumerate(self.specials.split(text)) for b in ([part] if k % 2 else self._blocks(part)) if part]
        if UNEVEN.search(text):
            return self.pattern.findall(text)
        return [b for b in text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if b]

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and how many each has."""
        if len(self.seen) > self.keep:
            self.clear()
        blocks = [self._blocks(t) for t in rows]
        fresh = list(set(chain.from_iterable(blocks)).difference(self.seen))
        if fresh:
            pieces = [self.pattern.findall(b) for b in fresh]
            flat = [p.encode() for own in pieces for p in own]
            ids, counts = merge_all(self.vocab, flat)
            owner = np.repeat(np.arange(len(fresh)), [len(own) for own in pieces])
            self._add(fresh, ids, np.bincount(owner, weights=counts, minlength=len(fresh)).astype(np.int64))
        at = np.array(list(map(self.seen.__getitem__, chain.from_iterable(blocks))), dtype=np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(own) for own in blocks])
        counts = np.bincount(owner, weights=self.len[at], minlength=len(rows)).astype(np.int64) if len(at) else np.zeros(len(rows), dtype=np.int64)
        return ragged(self.ids, self.at[at], self.len[at]), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary give nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        known = (ids >= 0) & (ids < self.vocab.size)
        owner = np.repeat(np.arange(len(counts)), counts)[known]
        ids = ids[known]
        lengths = self.vocab.token_len[ids]
        whole = ragged(self.vocab.token_bytes, self.vocab.token_at[ids], lengths).tobytes()
        ends = np.cumsum(np.bincount(owner, weights=lengths, minlength=len(counts)).astype(np.int64)) if len(ids) else np.zeros(len(counts), dtype=np.int64)
        return [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


_CODERS: dict[str, Coder] = {}


def coder_for(path: str) -> Coder:
    """This worker's coder for a vocabulary; later tasks of the same worker find their pieces encoded."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, ids array<int>`` for every row. Null and empty texts have no ids; repeated rows are
    encoded once each; a special token's string in a text is that token; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(vocabulary)
        for batch in chunks(batches, "text", 4 << 20):
            ids, counts = coder.encode(texts(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return _id(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id long, text string`` for every row of ids; null lists give the empty text, null or unknown ids nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(vocabulary)
        for batch in batches:
            rows = [np.array([i for i in x or [] if i is not None], dtype=np.int64) for x in batch.column("ids").to_pylist()]
            out = coder.decode(np.concatenate([*rows, np.zeros(0, dtype=np.int64)]), np.array([len(x) for x in rows], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode() for x in out], pa.string())], ["doc_id", "text"])

    source = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
    Ids are digested as little-endian unsigned 32-bit integers. Edge cases as in :func:`encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(vocabulary)
        for batch in chunks(batches, "text", 4 << 20):
            ids, counts = coder.encode(texts(batch.column("text")))
            back = coder.decode(ids, counts)
            raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array([hashlib.sha256(x).hexdigest() for x in back])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _id(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
