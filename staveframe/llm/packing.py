"""Operator 7: packing of token sequences by first-fit decreasing with a tournament tree.

Each document's tokens are cut into full sequences of ``capacity`` tokens and one rest. Only the pieces'
lengths and checksums leave the task that tokenizes. Rests are dealt at random to groups of about
``group_size`` documents; each group is packed on its own by first-fit decreasing, where a tournament tree
over the capacities left in the bins finds the first bin that a piece fits. The number of groups follows the
number of rows, so a task's share stays the same at any size, whatever keys or sources the rows have.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveframe.llm._batches import chunks, ragged, texts

CAPACITY = 4096
END_ID = 2
#: Distinct words whose ids a worker keeps between chunks and tasks.
KEEP = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
#: A full stop or comma beside another sign, with which it makes one piece; separators that Unicode does not take for white space are signs too.
JOINED = re.compile(r"[\x1c-\x1f]|[.,](?:(?<=[^\w\s].)|(?<=_.)|(?=[^\w\s]|_))")
#: Words that the tokenizer gets at once.
WORDS = 2048


def spaced(text: str) -> str:
    """The text with parts that can be encoded apart set apart by ASCII white space. Where it changes no id, it is also
    lower-cased, and full stops and commas are set apart, so that there are fewer distinct parts."""
    if "<|" in text or "Σ" in text or "İ" in text or JOINED.search(text) or not unicodedata.is_normalized("NFC", text):
        return text
    return text.lower().replace(",", " , ").replace(".", " . ")


def by_words(path: str) -> bool:
    """Whether texts may be cut and changed as :func:`spaced` does: the tokenizer in the file lower-cases, and drops white
    space, across which none of its pieces reaches."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = cutters[0] if cutters else {}
    drops_spaces = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and (first.get("pattern") or {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    no_prefix = all(x["type"] == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex", True) for x in cutters[1:])
    return steps == ["NFC", "Replace", "Lowercase"] and drops_spaces and no_prefix


def _strings(words: pa.Array) -> list[str]:
    """The strings of an array of words, which hold no line feeds; faster than one by one."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, "\n")[0].as_py().split("\n") if len(words) else []


class WordTokens:
    """Ids of texts by a tokenizer. Where its pieces never reach across white space, it encodes each distinct word once,
    until ``keep`` words are held; else it gets whole texts."""

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep, self.by_words = keep, by_words(path)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids, self.at, self.len = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def _add(self, words: list[str]) -> None:
        ids, counts = [self.ids], []
        for k in range(0, len(words), WORDS):
            part = words[k : k + WORDS]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, dtype=np.int64))
            counts.append(np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(part)))
        self.seen.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        count = np.concatenate(counts)
        self.at, self.len = np.r_[self.at, len(self.ids) + np.cumsum(count) - count], np.r_[self.len, count]
        self.ids = np.concatenate(ids)

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and how many each has."""
        if not self.by_words:
            got = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in rows]
            return np.fromiter(chain.from_iterable(got), dtype=np.int64), np.array([len(x) for x in got], dtype=np.int64)
        if len(self.seen) > self.keep:
            self.clear()
        lists = pc.ascii_split_whitespace(pa.array([spaced(t) for t in rows], pa.string()))
        coded = lists.flatten().dictionary_encode()
        words = _strings(coded.dictionary)
        fresh = [w for w in words if w not in self.seen]
        if fresh:
            self._add(fresh)
        at = np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words))[np.asarray(coded.indices)]
        total = np.r_[0, np.cumsum(self.len[at])]
        ends = np.asarray(lists.offsets)
        counts = np.diff(total[ends - ends[0]])
        return ragged(self.ids, self.at[at], self.len[at]), counts


_TOKENS: dict[str, WordTokens] = {}


def tokens_for(path: str, keep: int) -> WordTokens:
    """This worker's tokenizer; later tasks of the same worker find up to ``keep`` words encoded."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    _TOKENS[path].keep = keep
    return _TOKENS[path]


class BinTree:
    """Tournament tree over the capacities left in bins: each node holds the largest below it, so the first
    bin with room for a piece is found in as many steps as the tree is deep. Grows as bins are opened."""

    def __init__(self, capacity: int, leaves: int = 64):
        self.capacity, self.leaves = capacity, leaves
        self.most = [capacity] * (2 * leaves)

    def _grow(self) -> None:
        old, self.leaves = self.most[self.leaves :], 2 * self.leaves
        self.most = [self.capacity] * self.leaves + old + [self.capacity] * len(old)
        for node in range(self.leaves - 1, 0, -1):
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])

    def place(self, length: int) -> tuple[int, int]:
        """Puts a piece into the first bin with room; its bin and its offset there."""
        if self.most[1] < length:
            self._grow()
        node = 1
        while node < self.leaves:
            node *= 2
            if self.most[node] < length:
                node += 1
        left = self.most[node]
        bin_, offset = node - self.leaves, self.capacity - left
        self.most[node] = left - length
        while node > 1:
            node //= 2
            best = max(self.most[2 * node], self.most[2 * node + 1])
            if self.most[node] == best:
                break
            self.most[node] = best
        return bin_, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; among equal lengths the earlier row goes first. Empty pieces are not allowed."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree = BinTree(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], offsets[i] = tree.place(int(lengths[i]))
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """Tokenizes every text (null: empty), adds ``end_id``, and cuts into full pieces and a rest: ``doc_id, start,
    length, ids_crc32, doc_tokens, row``; ``row`` tells repeated rows apart. Each id lies in exactly one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_for(vocabulary, keep)
        for batch in chunks(batches, "text", 2 << 20):
            ids, counts = tokens.encode(texts(batch.column("text")))
            at = np.cumsum(counts) - counts
            out = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts, at = counts + 1, at + np.arange(len(counts))
            n = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, counts[doc] - start)
            raw = memoryview(out).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip((at[doc] + start).tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc]), batch.column("row").take(pa.array(doc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return source.mapInArrow(run, PIECES)


def pack(cut: DataFrame, rows: int, capacity: int = CAPACITY, group_size: int = 4000, seed: int = 7) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces. ``rows`` is the number of documents; it sets the number of groups.

    A piece of ``capacity`` tokens fills a sequence alone; the others of a group go by first-fit decreasing.
    Offsets have no gaps. An empty table gives an empty table. Sequence ids are unique, not consecutive.
    """
    groups = max(1, -(-rows // group_size))
    bits = 32

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group["grp"].to_numpy().astype(np.int64) << bits) + bins, offset=offsets).drop(columns=["grp", "row"])

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, group_size: int = 4000, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """:func:`pieces` and :func:`pack` together: one row for each piece of each row of ``docs``."""
    return pack(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, keep), docs.count(), capacity, group_size)
