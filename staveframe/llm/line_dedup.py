"""Operator 6: line deduplication with two Bloom filters and exact confirmation of suspects.

A first pass hashes the key of every eligible line, once for each document. Each task keeps two Bloom filters,
of hashes seen once and seen twice, and hands them over in compressed slices; all bits of a hash lie in one slice,
so slices merge on their own, each in a task: bits that two tasks hold, or that one holds as seen twice, are seen
twice. The second pass lets only lines whose hash is in the seen-twice filter go on. These suspects are shuffled
as (128-bit digest of the key, document) and confirmed exactly; the confirmed keys' lines go back to
their documents, which are joined to them on the document id.

The filter has ``bits_per_line`` bits for each line, up to ``filter_bytes`` in all: that is the bound of what is
sent to every task. Beyond it the filter lets more lines through as suspects, and the exact count decides as before.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staveframe.llm._batches import chunks, quoted, texts
from staveframe.llm._lineage import cut

MIN_CHARS, MIN_DOCS = 20, 3
#: Bits of a slice; the filter has a whole number of slices.
SLICE_BITS = 1 << 20
BITS_PER_LINE, FILTER_BYTES = 10, 64 << 20
#: The confirmed keys by document are broadcast up to this size; beyond, documents and keys are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
SPACE = " \t\n\v\f\r"


def line_key(line: str) -> bytes | None:
    """The key that lines are compared by; None if it is shorter than the least length."""
    key = line.strip(SPACE)
    return key.encode().lower() if len(key) >= MIN_CHARS else None


def positions(hashes: np.ndarray, slices: int, probes: int, slice_bits: int = SLICE_BITS) -> np.ndarray:
    """Bit positions of each hash, a row for each; all within one slice."""
    base = (hashes >> np.uint64(40)) % np.uint64(slices) * np.uint64(slice_bits)
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    with np.errstate(over="ignore"):
        inner = hashes[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)[None, :]
        inner ^= inner >> np.uint64(29)
    return (base[:, None] + inner % np.uint64(slice_bits)).astype(np.int64)


def set_bits(bits: np.ndarray, at: np.ndarray) -> None:
    """Sets bits of a packed array."""
    at = np.unique(at)
    if len(at):
        byte, mask = at >> 3, (128 >> (at & 7)).astype(np.uint8)
        first = np.flatnonzero(np.r_[True, np.diff(byte) > 0])
        bits[byte[first]] |= np.bitwise_or.reduceat(mask, first)


def get_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of a packed array at these positions."""
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def _doc_hashes(text: str) -> list[int]:
    return list({xxhash.xxh3_64_intdigest(k) for k in map(line_key, text.split("\n")) if k is not None})


def seen_twice(docs: DataFrame, lines: int, text_col: str = "text", slice_bits: int = SLICE_BITS) -> tuple[np.ndarray, int, int]:
    """The packed bits of the seen-twice filter, its number of slices and of probes, for about ``lines`` lines."""
    bits = min(lines * BITS_PER_LINE, FILTER_BYTES * 8)
    slices = max(1, -(-bits // slice_bits))
    probes = int(min(7, max(1, round(0.69 * slices * slice_bits / max(1, lines)))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(slices * slice_bits // 8, dtype=np.uint8), np.zeros(slices * slice_bits // 8, dtype=np.uint8)
        for batch in chunks(batches, "text", 4 << 20):
            own = np.fromiter((h for t in texts(batch.column("text")) for h in _doc_hashes(t)), dtype=np.uint64)
            own, count = np.unique(own, return_counts=True)
            at = positions(own, slices, probes, slice_bits)
            # A hash of which all bits are set counts as seen before: there may be more suspects, never fewer.
            set_bits(twice, at[(count > 1) | get_bits(once, at).all(axis=1)].ravel())
            set_bits(once, at.ravel())
        for k in range(slices):
            part = slice(k * slice_bits // 8, (k + 1) * slice_bits // 8)
            if once[part].any():
                packed = [zlib.compress(x[part].tobytes(), 1) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["slice", "once", "twice"])

    def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(slice_bits // 8, dtype=np.uint8), np.zeros(slice_bits // 8, dtype=np.uint8)
        for part in parts:
            for a, b in zip(part["once"], part["twice"], strict=True):
                new = np.frombuffer(zlib.decompress(a), dtype=np.uint8)
                twice |= np.frombuffer(zlib.decompress(b), dtype=np.uint8) | (once & new)
                once |= new
        yield pd.DataFrame({"slice": [key[0]], "twice": [zlib.compress(twice.tobytes(), 1)]})

    built = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(build, "slice int, once binary, twice binary")
    merged = built.groupBy("slice").applyInPandas(merge, "slice int, twice binary").collect()  # FILTER_BYTES at most
    whole = np.zeros(slices * (slice_bits // 8), dtype=np.uint8)
    for row in merged:
        whole[row["slice"] * (slice_bits // 8) : (row["slice"] + 1) * (slice_bits // 8)] = np.frombuffer(zlib.decompress(row["twice"]), dtype=np.uint8)
    return whole, slices, probes


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest``: the lines that may repeat, once for each row of ``docs``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = source.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    slice_bits = SLICE_BITS
    bits, slices, probes = seen_twice(source, lines, slice_bits=slice_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in chunks(batches, "text", 4 << 20):
            rows, keys = [], []
            for i, t in enumerate(texts(batch.column("text"))):
                own = {k for k in map(line_key, t.split("\n")) if k is not None}
                keys += own
                rows += [i] * len(own)
            if not keys:
                continue
            at = positions(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys)), slices, probes, slice_bits)
            held = np.flatnonzero(get_bits(bits, at).all(axis=1))
            digests = pa.array([hashlib.blake2b(keys[i], digest_size=16).digest() for i in held.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.array(rows)[held])), digests], ["doc_id", "digest"])

    return source.mapInArrow(run, "doc_id long, digest binary")


def drops(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, gone array<binary>``: the confirmed keys that each document loses. Exact: keys of ``min_docs``
    distinct documents or more, in all of these but the largest id. A null id counts as one document, below all."""
    pairs = found.distinct()
    agg = pairs.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("digest", "keeper")
    lost = pairs.join(agg, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_list("digest").alias("gone"))


def strip(text: str, gone: set[bytes]) -> tuple[str, int]:
    """The text without the lines whose key's digest is in ``gone``, and how many lines went."""
    lines = text.split("\n")
    kept = [x for x in lines if (k := line_key(x)) is None or hashlib.blake2b(k, digest_size=16).digest() not in gone]
    return "\n".join(kept), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of ``docs``, with the repeated lines taken out of the text, and ``n_lines`` (before) and
    ``n_dropped`` added (columns of these names are replaced).

    Null or empty texts are one empty line and stay as they are. Every line of a confirmed key goes, also where a
    document repeats it; the document with the largest id keeps all of its own. Rows that share an id are one
    document. Keys that are too short, and those of fewer than ``min_docs`` documents, stay everywhere.
    """
    gone = cut(drops(cut(suspects(docs, id_col, text_col)), min_docs))
    held = gone.agg(F.sum(F.size("gone") * 32 + 64)).first()[0] or 0
    gone = (F.broadcast(gone) if held <= BROADCAST_BYTES else gone).select(F.col("doc_id").alias("key"), "gone")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    source = docs.select(F.struct(*map(quoted, columns)).alias("doc"), F.col(id_col).cast("long").alias("own"))
    joined = source.join(gone, F.col("own").eqNullSafe(F.col("key")), "left").select("doc", F.col(f"doc.`{text_col}`").cast("string").alias("text"), "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            old, lists = batch.column("text").to_pylist(), batch.column("gone").to_pylist()
            new = [strip(t, set(g)) if t and g else (t, 0) for t, g in zip(old, lists, strict=True)]
            n = pa.array([1 + (t or "").count("\n") for t in old], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([t for t, _ in new], pa.string()), n, pa.array([k for _, k in new], pa.int64())], ["doc", "text", "n_lines", "n_dropped"])

    schema = StructType([source.schema["doc"]]).add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in columns], "n_lines", "n_dropped")
