"""Operator 12: hard-negative mining through an inverted multi-index, exact by certified windows.

Half scores of the cells (see :mod:`multi_index`) become bounds by the radii of the codes: no row of a cell scores more
than the sum of its two bounds. What is asked of an anchor depends on its positives and on the first negatives under
each, so three visits raise the score that decides:

1. the heap takes cells by their bound until they hold ``SEEDS`` rows; the positives met there, and a few examples of
   each label, bound the scores of the true positives from below;
2. all cells that can reach the lowest of these bounds give the positives exactly, and of the negatives met the first
   few under each bound, which bound the ends of the true windows from below;
3. all cells that can reach the lowest end give the negatives of each window. No row of another cell scores so much.

Scores are inner products of whole numbers, exact in double precision up to 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staveframe.llm import multi_index
from staveframe.llm._lineage import cut
from staveframe.llm.multi_index import Index, Shard

POSITIVES, NEGATIVES = 5, 5
SEEDS, EXAMPLES, SALTS = 2000, 8, 16
FOUND = "anchor long, key long, kind int, vec_id long, score long"


def whole(column: pa.Array) -> np.ndarray:
    """floor(256 x) of every component."""
    return np.floor(256 * multi_index.matrix(column))


def _padded(lists: list, width: int) -> np.ndarray:
    out = np.full((len(lists), width), np.nan)
    for k, values in enumerate(lists):
        out[k, : len(values or [])] = values or []
    return out


def _told(anchor: np.ndarray, key: np.ndarray, kind: int, ids: np.ndarray, who: np.ndarray, what: np.ndarray, scores: np.ndarray, most: int) -> pa.RecordBatch:
    found = scores[who, what]
    keep = multi_index.first_of(who, found, ids[what], most)
    who, what, found = who[keep], what[keep], found[keep]
    values = [pa.array(anchor[who]), pa.array(key[who]), pa.array(np.full(len(who), kind, dtype=np.int32)), pa.array(ids[what]), pa.array(np.clip(found, -(2.0**62), 2.0**62).astype(np.int64))]
    return pa.RecordBatch.from_arrays(values, ["anchor", "key", "kind", "vec_id", "score"])


def _work(positives: bool):
    """What a shard tells of each anchor: its first positives (kind 0), and of each window (kind 1 and more) the first
    negatives no higher than its ``tops`` and, where ``lows`` are given, no lower than these."""

    def run(shard: Shard, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchor, key, label = (np.asarray(part.column(c)) for c in ("id", "key", "label"))
        scores = shard.scores(whole(part.column("vector")), np.asarray(part.column("least")), bounds=True)
        same = label[:, None] == shard.labels[None, :]
        if positives:
            own = np.where(same & (anchor[:, None] != shard.ids[None, :]), scores, -np.inf)
            yield _told(anchor, key, 0, shard.ids, *multi_index.best(own, shard.ids, POSITIVES), own, POSITIVES)
        tops, lows = part.column("tops").to_pylist(), part.column("lows").to_pylist()
        width = max((len(t or []) for t in tops), default=0)
        upper, lower = _padded(tops, width), _padded(lows, width)
        others = np.where(same, -np.inf, scores)
        for k in range(width):
            fits = others <= upper[:, k, None]
            if any(lows):
                fits &= others >= lower[:, k, None]
            within = np.where(fits, others, -np.inf)
            yield _told(anchor, key, k + 1, shard.ids, *multi_index.best(within, shard.ids, NEGATIVES), within, NEGATIVES)

    return run


def _first(found: DataFrame) -> DataFrame:
    within = Window.partitionBy("anchor", "key", "kind").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= max(POSITIVES, NEGATIVES))


def _sent(anchors: DataFrame, index: Index, seeds: int | None = None) -> DataFrame:
    """Anchors once for each shard with a cell whose bound reaches their ``least``; with ``seeds`` that is found first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                a, b = index.half_scores(whole(part.column("vector")), bounds=True)
                least = [index.reached(a[k], b[k], seeds) for k in range(len(a))] if seeds else part.column("least").to_pylist()
                targets = [index.shards_of(a[k], b[k], least[k]) for k in range(len(a))]
                at = {**dict(zip(part.schema.names, part.columns, strict=True)), "least": pa.array(least, pa.float64()), "targets": pa.array(targets, pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_arrays([at[c] for c in names], names)

    names = [*anchors.columns, "targets"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields) + ", targets array<int>"
    return anchors.mapInArrow(run, schema).withColumn("target", F.explode("targets")).drop("targets")


def _exemplified(anchors: DataFrame, placed: DataFrame) -> DataFrame:
    """Anchors with ``known``: the scores of the best of a few rows of their label, other than themselves, descending."""
    within = Window.partitionBy("label").orderBy(F.xxhash64("vec_id"), "vec_id")
    few = placed.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= EXAMPLES)
    few = few.groupBy("label").agg(F.collect_list(F.struct("vec_id", "vector")).alias("examples"))
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a label may hold most anchors
    met = anchors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(few, ["label", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = []
            if batch.num_rows:
                q, owner = whole(batch.column("vector")), batch.column("examples")
                flat, lengths = owner.flatten(), np.diff(np.asarray(owner.offsets))
                x, ids, at = whole(flat.field("vector")), np.asarray(flat.field("vec_id")), np.repeat(np.arange(len(q)), lengths)
                score = np.einsum("kd,kd->k", q[at], x)
                other = ids != np.asarray(batch.column("id"))[at]
                known = [np.sort(score[other & (at == k)])[::-1][:POSITIVES].astype(np.int64).tolist() for k in range(len(q))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "label", "vector")), pa.array(known, pa.list_(pa.int64()))], ["id", "key", "label", "vector", "known"])

    kind = anchors.schema["vector"].dataType.simpleString()
    return met.mapInArrow(run, f"id long, key long, label long, vector {kind}, known array<long>")


def mine(embeddings: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors, the rows whose id is
    divisible by ``every``: of each of an anchor's first five other rows of its label (all, if fewer), the first five rows
    of other labels (all, if fewer) that score no more, and at least four fifths as much.

    Where the id is divisible by 7 the label first becomes (label + 1) % 10; components become floor(256 x). Rows with a
    null id, label or vector, with null or non-finite components or with a vector that has not the usual length take no
    part. Ties go to the smaller id. Rows equal in id, label and vector count once; those that share an id only are rows
    of their own, though never positives of each other. An anchor whose label no other row has, or whose positives all
    score below zero, gives no rows; neither does an empty table. Other columns are left out.
    """
    given = F.col(f"`{label_col}`").cast("long")
    rows = multi_index.usable(embeddings, id_col, vector_col, given.alias("label")).where("label IS NOT NULL")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    # Of rows equal in vector and label no anchor can list more than these, itself included.
    placed, index = multi_index.build(multi_index.representatives(rows, max(POSITIVES + 1, NEGATIVES), "label"), whole)
    if index is None:
        return placed.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    entries = placed.withColumnRenamed("vec_id", "id")
    anchors = rows.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("id"), F.xxhash64("vector", "label").alias("key"), "label", "vector")
    empty = F.array().cast("array<long>")
    unknown = F.lit(None).cast("double")

    seeding = cut(_exemplified(anchors, placed).where(F.size("known") > 0)).withColumns({"least": unknown, "tops": empty, "lows": empty})
    seeds = _first(multi_index.visit(entries, _sent(seeding.drop("known"), index, SEEDS), index, _work(True), FOUND, whole))
    seeds = seeds.groupBy("anchor", "key").agg(F.sort_array(F.collect_list("score"), asc=False).alias("met"))
    keyed = [F.col("id") == F.col("anchor"), F.col("key") == F.col("other")]
    known = F.coalesce(F.zip_with("known", "met", lambda a, b: F.greatest(a, b)), F.col("known"))  # either is a bound for each place
    bounded = seeding.drop("least", "tops", "lows").join(seeds.withColumnRenamed("key", "other"), keyed, "left").select("id", "key", "label", "vector", known.alias("tops"))
    bounded = bounded.withColumns({"least": F.greatest(F.element_at("tops", -1), F.lit(0)).cast("double"), "lows": empty})

    bounded = cut(bounded)
    found = _first(multi_index.visit(entries, _sent(bounded, index), index, _work(True), FOUND, whole))
    found = found.groupBy("anchor", "key").agg(F.array_sort(F.collect_list(F.struct("kind", "nth", "score", "vec_id"))).alias("found"))
    positives = F.filter("found", lambda r: (r["kind"] == 0) & (r["nth"] <= POSITIVES) & (r["score"] >= 0))
    last = lambda k: F.filter("found", lambda r: (r["kind"] == k + 1) & (r["nth"] == NEGATIVES))[0]["score"]
    windows = bounded.drop("least", "lows", "tops").join(found.withColumnRenamed("key", "other"), keyed).withColumn("positives", positives)
    windows = windows.withColumn("tops", F.transform("positives", lambda r: r["score"]))
    low = F.transform("tops", lambda p, k: F.greatest(_least_allowed(p), F.coalesce(last(k), F.lit(0))))
    windows = windows.withColumn("lows", low).where(F.size("tops") > 0).withColumn("least", F.array_min("lows").cast("double")).drop("found", "anchor", "other")

    windows = cut(windows)
    probes = _sent(windows.drop("positives"), index)
    mined = _first(multi_index.visit(entries, probes, index, _work(False), FOUND, whole)).where(F.col("nth") <= NEGATIVES)
    told = mined.join(windows.select("id", F.col("key").alias("other"), "positives"), keyed)
    positive = F.col("positives")[F.col("kind") - 1]
    return told.select(
        F.col("anchor").alias("anchor_id"), positive["vec_id"].alias("positive_id"), F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _least_allowed(p):
    """The least whole n with 80 p <= 100 n, for p >= 0."""
    return ((p * 4 + 4 - F.pmod(p * 4 + 4, F.lit(5))) / 5).cast("long")
