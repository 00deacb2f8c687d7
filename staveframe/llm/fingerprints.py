"""Operator 5: homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines that aren't blank). Each paragraph is hashed to a wide vector, and
the fingerprint is the sum of the vectors modulo 2**32 in every lane. So the order of paragraphs doesn't matter,
and a paragraph is inserted or deleted by adding or subtracting its vector. A vector has two parts: ``EQUAL`` lanes
of a 512-bit hash of the whole paragraph, for equality, and ``ALIKE`` lanes to which each run of three words of the
paragraph adds +1 or -1 in one hashed lane; inner products of those sums estimate how much two texts share.

To compare each document with the next one by id, rows are dealt to ranges of the id by bounds taken from the ids
alone; the first row of a range is also sent to the range before it. Texts are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveframe.llm._batches import chunks, texts

EQUAL, ALIKE, RUN = 16, 256, 3
LANES = EQUAL + ALIKE
#: Text of a range of ids in bytes, at least; ranges grow beyond that once there are ``MOST_RANGES`` of them.
RANGE_BYTES, MOST_RANGES = 16 << 20, 100_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Hasher:
    """Vectors of many texts at once; keeps the hashes of up to ``keep`` distinct words."""

    def __init__(self, keep: int = 400_000):
        self.keep, self.words = keep, {}

    def vectors(self, rows: list[str]) -> np.ndarray:
        """A row of ``LANES`` lanes for each text; the empty text gives zeros."""
        if len(self.words) > self.keep:
            self.words.clear()
        parts = [[p for p in t.split("\n") if p and not p.isspace()] for t in rows]
        out = np.zeros((len(rows), LANES), dtype=np.uint32)
        paragraphs = list(chain.from_iterable(parts))
        if not paragraphs:
            return out
        owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
        digests = np.frombuffer(b"".join(hashlib.blake2b(p.encode()).digest() for p in paragraphs), dtype="<u4").reshape(-1, EQUAL)
        first = np.flatnonzero(np.r_[True, np.diff(owner) > 0])
        out[owner[first], :EQUAL] = np.add.reduceat(digests, first, axis=0, dtype=np.uint32)
        words = [p.split() for p in paragraphs]
        for w in set(chain.from_iterable(words)).difference(self.words):
            self.words[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array(list(map(self.words.__getitem__, chain.from_iterable(words))), dtype=np.uint64)
        sizes = np.array([len(w) for w in words])
        paragraph = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Runs begin at each word but the last RUN - 1; a shorter paragraph is one run.
        begins = np.flatnonzero((at + RUN <= sizes[paragraph]) | (at == 0))
        g = np.zeros(len(begins), dtype=np.uint64)
        padded, inside = np.r_[h, np.zeros(RUN, dtype=np.uint64)], np.r_[paragraph, np.full(RUN, -1)]
        with np.errstate(over="ignore"):
            for k in range(RUN):
                g += np.where(inside[begins + k] == paragraph[begins], padded[begins + k], np.uint64(0)) * MIX[k]
            g ^= g >> np.uint64(31)
            g *= MIX[0]
        lane = (g >> np.uint64(40)).astype(np.int64) % ALIKE
        sign = np.where(g & np.uint64(1 << 33), 1.0, -1.0)
        sums = np.bincount(owner[paragraph[begins]] * ALIKE + lane, weights=sign, minlength=len(rows) * ALIKE)
        out[:, EQUAL:] = sums.reshape(-1, ALIKE).astype(np.int64).astype(np.uint32)
        return out


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of the union of two multisets of paragraphs."""
    return (a + b).astype(np.uint32)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint after the paragraphs of ``b`` are deleted from ``a``."""
    return (a - b).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows: 1 for equal fingerprints, else the cosine of the ALIKE lanes, 0 at least."""
    x, y = (v[:, EQUAL:].astype(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a == b).all(axis=1), 1.0, np.clip(cosine, 0.0, 1.0))


def written(vectors: np.ndarray) -> list[str]:
    """Fingerprints as text: base64 of the lanes as little-endian unsigned 32-bit integers."""
    return [base64.b64encode(v.astype("<u4").tobytes()).decode() for v in vectors]


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u4").astype(np.uint32)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row; null texts count as empty, whose fingerprint is all zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(written(hasher.vectors(texts(batch.column("text")))))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, text, range, copy`` so dealt and sorted that each row's next document follows it in its partition
    and range; rows with ``copy`` = 1 only stand there to be the next one. Order: id (null first), hash of the text. Rows
    equal in both share a range, through which rows are streamed one after the other."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"))
    size = rows.select(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ranges = max(1, -(-size // max(range_bytes, size // MOST_RANGES)))
    key = F.struct("k", "h")
    firsts = keyed.select("k", "h").repartitionByRange(ranges, "k", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("first")).collect()
    bounds = sorted({tuple(x["first"]) for x in firsts})  # one key for each range

    first_k, first_h = (np.array([x[i] for x in bounds], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("struct<range:int,first:boolean>")
    def place(k: pd.Series, h: pd.Series) -> pd.DataFrame:
        k, h = k.to_numpy(), h.to_numpy()
        low, high = np.searchsorted(first_k, k, "left"), np.searchsorted(first_k, k, "right")
        while (low < high).any():  # among bounds of the same id, by the hash
            middle = (low + high) // 2
            inside = low < high
            up = inside & (first_h[np.minimum(middle, len(first_h) - 1)] <= h)
            low, high = np.where(up, middle + 1, low), np.where(inside & ~up, middle, high)
        at = np.maximum(low - 1, 0)
        return pd.DataFrame({"range": at.astype(np.int32), "first": (first_k[at] == k) & (first_h[at] == h)})

    own, n = F.col("place.range"), max(1, len(bounds))
    before = F.pmod(own - 1, F.lit(n))
    spots = F.when(F.col("place.first"), F.array(F.struct(own.alias("range"), F.lit(0).alias("copy")), F.struct(before.alias("range"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(own.alias("range"), F.lit(0).alias("copy"))))
    dealt = keyed.withColumn("place", place("k", "h")).withColumn("spot", F.explode(spots)).select("doc_id", "text", "k", "h", "spot.range", "spot.copy")
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "copy", "k", "h").select("doc_id", "text", "range", "copy")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row, its fingerprint and that of its text with the last half taken from the next document:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is the one with the next larger id (after the last: the first; a single row is its own next;
    rows of equal ids follow each other by a hash of the text). Null texts count as empty. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        last = None  # the row that still waits for its next one: id, text, range, vector
        for batch in chunks(batches, "text"):
            own = texts(batch.column("text"))
            vectors = hasher.vectors(own)
            rows = list(zip(batch.column("doc_id").to_pylist(), own, batch.column("range").to_pylist(), batch.column("copy").to_pylist(), vectors, strict=True))
            line = ([last] if last else []) + rows
            pairs = [(a, b) for a, b in zip(line, line[1:], strict=False) if a[2] == b[2] and not a[3]]
            last = line[-1]
            if not pairs:
                continue
            changed = [edited(a[1], b[1]) for a, b in pairs]
            mine, theirs, after = np.stack([a[4] for a, _ in pairs]), np.stack([b[4] for _, b in pairs]), hasher.vectors(changed)
            columns = [
                pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(written(mine)), pa.array(written(after)), pa.array(likeness(mine, after)), pa.array(likeness(mine, theirs)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
