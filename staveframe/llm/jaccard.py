"""Operator 10: join of documents by the Jaccard similarity of their word shingles, by chosen paths.

Texts with the same set of shingles are one class, and classes are what is joined. Each run samples a token of every
set (the least by a hash function of the run and level) and splits the classes by it: sets with similarity s share the
sample with chance s. A bucket of more than ``LIMIT`` classes is split again by the next sample, up to ``LEVELS`` times;
small buckets, and what is still large then, are compared by brute force, the large ones in pairs of blocks. Runs are
repeated until pairs at the threshold are found with the target chance even after the most splits.

A pair counts in the first run that brings it together and nowhere else, so links are counted without listing pairs:
each bucket gives a row for each of its members, with the number of its new links and the least member that they
lead to. Before sets are shipped, buckets drop members that no other member can be linked with newly: by the sizes of
the sets, which is exact, or by samples of which too few agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staveframe.llm._batches import chunks, give_back, texts
from staveframe.llm._lineage import cut
from staveframe.llm.components import components

WORDS, THRESHOLD = 5, (4, 5)
LEVELS, LIMIT, TARGET = 3, 256, 0.996
RUNS = math.ceil(math.log(1 - TARGET) / math.log(1 - (THRESHOLD[0] / THRESHOLD[1]) ** LEVELS))
#: A large bucket is cut into blocks of so many classes and shingles.
BLOCK, BLOCK_SHINGLES = 4000, 4_000_000
#: Pairs of which fewer than so many of the RUNS * LEVELS samples agree aren't compared.
AGREE = math.floor(RUNS * LEVELS * 0.42)
BROADCAST_ROWS = 500_000
_SALT = np.random.default_rng(10).integers(1, 1 << 63, size=(2, RUNS * LEVELS), dtype=np.uint64) | np.uint64(1)
MIX = np.random.default_rng(5).integers(1, 1 << 63, size=WORDS, dtype=np.uint64) | np.uint64(1)


class Shingler:
    """Sets of shingle hashes of many texts at once. Words are what white space separates, lower-cased; a text of
    fewer than ``WORDS`` words has one shingle of all of them, a text without words has none."""

    def __init__(self, keep: int = 400_000):
        self.keep, self.words = keep, {}

    def sets(self, rows: list[str]) -> list[np.ndarray]:
        if len(self.words) > self.keep:
            self.words.clear()
        words = [t.lower().split() for t in rows]
        for w in set(chain.from_iterable(words)).difference(self.words):
            self.words[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array(list(map(self.words.__getitem__, chain.from_iterable(words))), dtype=np.uint64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        padded = np.r_[h, np.zeros(WORDS, dtype=np.uint64)]
        left = np.repeat(ends, sizes) - np.arange(len(h))  # words from here to the text's end
        g = np.zeros(len(h), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WORDS):
                g += np.where(left > k, padded[k : k + len(h)], np.uint64(0)) * MIX[k]
            g ^= g >> np.uint64(31)
            g *= MIX[0]
            g ^= g >> np.uint64(29)
        return [np.unique(g[a : max(a + 1, b - WORDS + 1)]) if b > a else g[:0] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """The sampled token of each set (not empty) in every run and level, a row for each set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), RUNS * LEVELS), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(RUNS * LEVELS):
            x = flat * _SALT[0, k]
            x ^= x >> np.uint64(32)
            x *= _SALT[1, k]
            out[:, k] = (np.minimum.reduceat(x, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id, row, digest, n, samples`` of each row; without shingles or id, all but the first two are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in chunks(batches, "text"):
            sets = shingler.sets(texts(batch.column("text")))
            held = [i for i, (s, d) in enumerate(zip(sets, batch.column("doc_id").to_pylist(), strict=True)) if len(s) and d is not None]
            digest, n, sampled = ([None] * len(sets) for _ in range(3))
            for i, x in zip(held, samples([sets[i] for i in held]) if held else (), strict=True):
                digest[i], n[i], sampled[i] = digest_of(sets[i]), len(sets[i]), x.tobytes()
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(sampled, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "digest", "n", "samples"])

    return rows.mapInArrow(run, "doc_id long, row long, digest binary, n long, samples binary")


def paths(classes: DataFrame) -> DataFrame:
    """``node, run, p`` with ``p`` the hashes of the paths of each length, for every class and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("samples").to_pylist()), dtype=np.uint32).reshape(-1, RUNS, LEVELS).astype(np.uint64)
            p = np.empty(x.shape, dtype=np.uint64)
            with np.errstate(over="ignore"):
                last = np.broadcast_to(np.arange(1, RUNS + 1, dtype=np.uint64) * MIX[1], x.shape[:2])
                for k in range(LEVELS):
                    last = (last ^ x[:, :, k]) * MIX[2]
                    last = last ^ (last >> np.uint64(32))
                    p[:, :, k] = last
            node = np.repeat(np.asarray(batch.column("node")), RUNS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, LEVELS), pa.int32()), pa.array(p.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.tile(np.arange(RUNS, dtype=np.int32), len(x))), lists], ["node", "run", "p"])

    return classes.select("node", "samples").mapInArrow(run, "node long, run int, p array<long>")


def buckets(classes: DataFrame) -> DataFrame:
    """``node, run, key, size``: the bucket of two classes or more where each class ends up in each run."""
    now, done = paths(classes), None
    for level in range(LEVELS):
        keyed = now.withColumn("key", F.col("p")[level])
        sizes = cut(keyed.groupBy("run", "key").agg(F.count("*").alias("size")).where(F.col("size") > 1))
        # Large buckets are few, and would be hot keys of a shuffle; the others have LIMIT rows each at most.
        large = sizes.where(F.col("size") > LIMIT)
        if 0 < large.count() <= BROADCAST_ROWS:
            keyed = keyed.join(F.broadcast(large.withColumnRenamed("size", "big")), ["run", "key"], "left")
            spread = F.when(F.col("big").isNotNull(), F.xxhash64("node")).otherwise(F.col("key")).alias("at")
            small = sizes.where(F.col("size") <= LIMIT).withColumnRenamed("key", "at")
            keyed = keyed.select("*", spread).join(small, ["run", "at"], "left").withColumn("size", F.coalesce("big", "size")).where(F.col("size").isNotNull()).drop("at", "big")
        else:
            keyed = keyed.join(sizes, ["run", "key"])
        ended = keyed if level == LEVELS - 1 else keyed.where(F.col("size") <= LIMIT)
        done = ended.drop("p") if done is None else done.unionByName(ended.drop("p"))
        if level < LEVELS - 1:
            now = keyed.where(F.col("size") > LIMIT).drop("key", "size")
            if level == 0:
                keyed_cut = cut(keyed)
                now, done = keyed_cut.where(F.col("size") > LIMIT).drop("key", "size"), keyed_cut.where(F.col("size") <= LIMIT).drop("p")
    return done


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, sorted as they come, that never end within a group."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        cols = [np.asarray(table.column(k)) for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        first = int(np.argmax(same))  # where the last group begins
        if first:
            yield table.slice(0, first)
            waiting = table.slice(first).combine_chunks().to_batches()
            n = table.num_rows - first
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()
    del waiting
    give_back()


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, RUNS)


def _earlier(a: np.ndarray, b: np.ndarray, runs: np.ndarray | int) -> np.ndarray:
    """Whether two classes share a bucket of an earlier run; key 0 stands for none."""
    return ((a == b) & (a != 0) & (np.arange(RUNS) < np.asarray(runs)[..., None])).any(axis=-1)


def promising(small: DataFrame) -> DataFrame:
    """The rows of small buckets that have another member that they may be newly linked with. Rows: ``run, key, node,
    n, keys, samples``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["run", "key"], 20_000):
            key, runs, n = (np.asarray(table.column(c)) for c in ("key", "run", "n"))
            keys = _keys(table.column("keys"))
            x = np.frombuffer(b"".join(table.column("samples").to_pylist()), dtype=np.uint32).reshape(len(n), -1)
            live = np.zeros(len(n), dtype=bool)
            for d in range(1, len(n)):
                i = np.flatnonzero((key[:-d] == key[d:]) & (runs[:-d] == runs[d:]))
                if not len(i):
                    break
                j = i + d
                near = np.minimum(n[i], n[j]) * THRESHOLD[1] >= np.maximum(n[i], n[j]) * THRESHOLD[0]
                i, j = i[near], j[near]
                near = (x[i] == x[j]).sum(axis=1) >= AGREE
                i, j = i[near], j[near]
                new = ~_earlier(keys[i], keys[j], runs[i])
                live[i[new]] = live[j[new]] = True
            yield from table.select(["run", "key", "node"]).filter(pa.array(live)).to_batches()

    return small.repartition("run", "key").sortWithinPartitions("run", "key").mapInArrow(run, "run int, key long, node long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right: shared tokens that many sets
    hold go through a matrix product, the others pair by pair."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    token, inverse = np.unique(np.concatenate(left + right), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    is_left = row < len(left)
    in_left, in_right = np.bincount(inverse[is_left], minlength=len(token)), np.bincount(inverse[~is_left], minlength=len(token))
    many = np.flatnonzero((in_left * in_right) >= max(64, len(left) * len(right) // 400))
    for at in range(0, len(many), 1024):
        part = np.full(len(token), -1)
        part[many[at : at + 1024]] = np.arange(len(many[at : at + 1024]))
        col = part[inverse]
        x, y = (np.zeros((k, min(1024, len(many) - at)), dtype=np.float32) for k in out.shape)
        hit = (col >= 0) & is_left
        x[row[hit], col[hit]] = 1
        hit = (col >= 0) & ~is_left
        y[row[hit] - len(left), col[hit]] = 1
        out += x @ y.T
    few = (in_left > 0) & (in_right > 0)
    few[many] = False
    by = np.argsort(inverse, kind="stable")
    by = by[few[inverse[by]]]
    a, b = by[is_left[by]], by[~is_left[by]]
    if len(a):
        times = in_right[inverse[a]]
        start = np.searchsorted(inverse[b], inverse[a])
        total = int(times.sum())
        pick = np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start, times)
        out += np.bincount(np.repeat(row[a], times) * len(right) + row[b[pick]] - len(left), minlength=out.size).reshape(out.shape)
    return out


def _least_reached(i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The least node that links among these lead to, for each."""
    least = node.copy()
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == least).all():
            return least
        least = new


def compared(rows: DataFrame) -> DataFrame:
    """``node, links, least`` of the members of each bucket that have new links there, from rows ``run, key, part,
    side, node, n, copies, keys, tokens``: side 0 of a part is compared with side 1, or with itself if there's none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["run", "key", "part"], 256):
            ids = [np.asarray(table.column(c)) for c in ("run", "key", "part")]
            cuts = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in ids])) + 1
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, table.num_rows].tolist(), strict=True):
                if b - a > 1:
                    out += _links(table.slice(a, b - a), int(ids[0][a]))
            if out:
                node, links, least = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(least)], ["node", "links", "least"])

    ordered = rows.repartition("run", "key", "part").sortWithinPartitions("run", "key", "part", "side", "node")
    return ordered.mapInArrow(run, "node long, links long, least long")


def _links(group: pa.Table, run: int) -> list[tuple[np.ndarray, ...]]:
    node, n, copies, side = (np.asarray(group.column(c)) for c in ("node", "n", "copies", "side"))
    first = np.r_[True, node[1:] != node[:-1]] | np.r_[True, side[1:] != side[:-1]]  # repeated rows have come twice
    keys, sets = _keys(group.column("keys"))[first], [np.frombuffer(x, dtype=np.uint64) for x, f in zip(group.column("tokens").to_pylist(), first, strict=True) if f]
    node, n, copies, side = node[first], n[first], copies[first], side[first]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = not len(right)
    right = left if own else right
    if len(left) == 0 or len(node) < 2:
        return []
    most, least_share = 9, 4  # 9 |A and B| >= 4 (|A| + |B|) is a similarity of 4/5 or more
    near = most * overlaps([sets[k] for k in left], [sets[k] for k in right]) >= least_share * (n[left][:, None] + n[right][None, :])
    i, j = np.nonzero(np.triu(near, 1) if own else near)
    i, j = left[i], right[j]
    new = np.concatenate([~_earlier(keys[i[k : k + 500_000]], keys[j[k : k + 500_000]], run) for k in range(0, len(i), 500_000)]) if len(i) else np.zeros(0, dtype=bool)
    i, j = i[new], j[new]
    if not len(i):
        return []
    links = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
    held = np.unique(np.r_[i, j])
    return [(node[held], links[held].astype(np.int64), _least_reached(i, j, node)[held])]


def tokens_of(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """``node, tokens`` (hashes as little-endian 64-bit integers) of the classes ``needed(node, class_id, digest)``, made
    again from the row of that id and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in chunks(batches, "text"):
            sets = shingler.sets(texts(batch.column("text")))
            held = [(n, s.tobytes()) for n, d, s in zip(batch.column("node").to_pylist(), batch.column("digest").to_pylist(), sets, strict=True) if digest_of(s) == d]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), pa.array([t for _, t in held], pa.binary())], ["node", "tokens"])

    wanted = needed.select("node", F.col("class_id").alias("doc_id"), "digest")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return rows.join(wanted, "doc_id").select("node", "digest", "text").mapInArrow(run, "node long, tokens binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id, n_links, component_id, kept, digest``.

    ``class_id`` is the smallest id with the same set of shingles, ``n_links`` counts the other documents with a
    similarity of 0.8 or more, copies included, ``component_id`` is the smallest id that links lead to, and ``kept``
    holds for one row of each component, of that id. Null and wordless texts, and rows without an id, link with
    nothing and are kept, with their own id as class and component. Repeated rows count as documents of their own.
    """
    rows = _rows(docs, id_col, text_col)
    every = cut(digests(rows))
    classes = cut(every.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("samples").alias("samples")).select("digest", F.col("rep.row").alias("node"), F.col("rep.doc_id").alias("class_id"), "copies", "n", "samples"))
    ended = cut(buckets(classes))
    spread = F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.coalesce(F.element_at("by", r), F.lit(0).cast("long")))
    # Each class's bucket in every run, to tell which run brings a pair together first.
    by_node = ended.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("run", "key"))).alias("by")).select("node", spread.alias("keys"))
    facts = cut(by_node.join(classes.select("node", "n", "copies", "samples"), "node"))
    members = ended.join(facts, "node")
    small = promising(members.where(F.col("size") <= LIMIT).select("run", "key", "node", "n", "keys", "samples")).select("run", "key", "node", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"))
    large = members.where(F.col("size") > LIMIT)
    parts = cut(large.groupBy("run", "key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    # Block a is side 0 of the parts (a, b) with b >= a, and side 1 of those (b, a) with b < a.
    block = F.pmod(F.xxhash64("node", "run"), F.col("blocks")).cast("int")
    spots = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct((F.least("block", b).cast("long") * 1_000_000 + F.greatest("block", b)).alias("part"), F.when(b < F.col("block"), 1).otherwise(0).alias("side")))
    blocks = large.join(parts, ["run", "key"]).withColumn("block", block).select("run", "key", "node", F.explode(spots).alias("spot")).select("run", "key", "node", "spot.part", "spot.side")
    spots_ = cut(small.unionByName(blocks))
    tokens = tokens_of(rows, spots_.select("node").distinct().join(classes.select("node", "class_id", "digest"), "node"))
    found = cut(compared(spots_.join(facts.select("node", "n", "copies", "keys").join(tokens, "node"), "node")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    graph = classes.select("digest", "node", "class_id", "copies").join(counted, "node", "left").join(linked.select(F.col("id").alias("node"), "component"), "node", "left")
    graph = graph.select("digest", "node", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    heads = graph.groupBy("component").agg(F.min(F.struct("class_id", "node")).alias("head"))
    verdict = cut(graph.join(heads, "component").select("digest", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("head.class_id").alias("component_id"), F.col("head.node").alias("keeper")))
    out = every.select("doc_id", "row", "digest").join(verdict, "digest", "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("keeper") == F.col("row"), F.lit(True)).alias("kept"), "digest",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component left; all rows that link with nothing stay."""
    found = cut(join(docs, id_col, text_col).select("doc_id", "digest", "kept"))
    gone = cut(found.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all")).where(~F.col("all")))
    small = gone.count() <= BROADCAST_ROWS
    with_id = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("doc_id"))
    left = with_id.join(F.broadcast(gone) if small else gone, "doc_id", "left").where(F.col("some").isNull() | F.col("some"))
    if gone.where("some").limit(1).count() == 0:  # ids tell rows apart
        return left.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
    # Rows that share an id, of which some go: they are told apart by their shingles, and equal ones by their place.
    clear = left.where(F.col("some").isNull())
    mixed = left.where(F.col("some")).select("doc", "doc_id", F.col(f"doc.`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in chunks(batches, "text"):
            sets = shingler.sets(texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary())], ["doc", "doc_id", "digest"])

    told = mixed.mapInArrow(run, StructType([mixed.schema["doc"]]).add("doc_id", "long").add("digest", "binary"))
    keepers = found.where("kept and digest is not null").select("doc_id", "digest").distinct()
    one = told.join(keepers, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    rest = told.where(F.col("digest").isNull())
    return clear.select("doc").unionByName(one.select("doc")).unionByName(rest.select("doc")).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
