"""Operator 11: nearest neighbours by inner product through an inverted multi-index.

See :mod:`multi_index` for how rows are placed. For each query the sums of the two half scores order the cells; a heap
goes through them until the cells visited hold so many rows as the audit asks for. All rows of these cells are scored
anew in double precision. The audit holds ``AUDIT`` queries, chosen by a hash, against all rows: from the cell of each
true neighbour follows after how many rows its query would have met it, and the budget is what ``RECALL`` of all true
neighbours need, ``ENTRIES`` at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staveframe.llm import multi_index
from staveframe.llm.multi_index import Index, Shard

NEAREST = 20
AUDIT, RECALL, ENTRIES = 64, 0.97, 2000

FOUND = "query long, key long, vec_id long, score double"


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first component on: the same digits for the same two vectors anywhere."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * x[:, k]
    return total


def nearest_in(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, column and exact score of the first ``most`` of each query; a query's own id is no candidate."""
    scores[own[:, None] == ids[None, :]] = -np.inf
    reach = np.abs(q).sum(axis=1).max(initial=0) * np.abs(x).max(initial=0)
    who, what = multi_index.best(scores, ids, most, 1e-12 * reach)
    exact = np.concatenate([products(q[who[a : a + 65536]], x[what[a : a + 65536]]) for a in range(0, len(who), 65536)]) if len(who) else np.zeros(0)
    keep = multi_index.first_of(who, exact, ids[what], most)
    return who[keep], what[keep], exact[keep]


def _truth(placed: DataFrame, audit: pa.Table, most: int) -> DataFrame:
    """Exact neighbours of the audited queries among all rows: ``query, vec_id, score, cell``; each task keeps few."""
    q, own = multi_index.matrix(audit.column("vector").combine_chunks()), np.asarray(audit.column("vec_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x, ids = multi_index.matrix(part.column("vector")), np.asarray(part.column("vec_id"))
                who, what, score = nearest_in(q, own, x, ids, q @ x.T, most)
                kept.append((who, ids[what], score, np.asarray(part.column("cell"))[what]))
            if len(kept) > 8:
                kept = [_shortened(kept, most)]
        if kept:
            who, ids, score, cell = _shortened(kept, most)
            yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(ids), pa.array(score), pa.array(cell)], ["query", "vec_id", "score", "cell"])

    found = placed.mapInArrow(run, "query int, vec_id long, score double, cell int")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= most)


def _shortened(kept: list, most: int) -> tuple:
    who, ids, score, cell = (np.concatenate(c) for c in zip(*kept, strict=True))
    keep = multi_index.first_of(who, score, ids, most)
    return who[keep], ids[keep], score[keep], cell[keep]


def budget(index: Index, q: np.ndarray, query: np.ndarray, cell: np.ndarray, recall: float = RECALL) -> int:
    """Rows that a query must meet so that ``recall`` of the given (query, cell) of true neighbours are among them."""
    a, b = index.half_scores(q)
    needs = np.zeros(len(query), dtype=np.int64)
    for k in range(len(q)):
        sums = (a[k][:, None] + b[k][None, :]).ravel()
        by = np.argsort(-sums, kind="stable")
        met = np.empty(len(by), dtype=np.int64)
        met[by] = np.cumsum(index.counts.ravel()[by])
        needs[query == k] = met[cell[query == k]]
    needs.sort()
    return max(ENTRIES, int(needs[int(np.ceil(recall * len(needs))) - 1])) if len(needs) else ENTRIES


def search(embeddings: DataFrame, every: int = 20, most: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``most`` nearest found of each query, which are the rows whose id is divisible
    by ``every``; candidates are all rows but those with the query's id.

    Rows whose vector is null, empty, zero or holds null or non-finite components, rows without an id and rows whose
    vector has not the usual length take no part. Rows equal in id and vector count once; those that share an id only are
    rows of their own, and as queries have lists of their own under the same id. Ties go to the smaller id. Fewer
    candidates give shorter lists; an empty table gives none. Other columns are left out.
    """
    rows = multi_index.usable(embeddings, id_col, vector_col)
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    # Of equal vectors no query can list more than these, its own included.
    placed, index = multi_index.build(multi_index.representatives(rows, most + 1))
    if index is None:
        return placed.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    audit = queries.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(AUDIT).toArrow()
    truth = _truth(placed, audit, most).select("query", "cell").toArrow()  # AUDIT x most rows
    q = multi_index.matrix(audit.column("vector").combine_chunks()) if len(audit) else np.zeros((0, index.first.shape[1] + index.second.shape[1]))
    want = budget(index, q, np.asarray(truth.column("query")), np.asarray(truth.column("cell")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                a, b = index.half_scores(multi_index.matrix(part.column("vector")))
                least = [index.reached(a[k], b[k], want) for k in range(len(a))]
                targets = [index.shards_of(a[k], b[k], least[k]) for k in range(len(a))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("key"), part.column("vector"), pa.array(least, pa.float64()), pa.array(targets, pa.list_(pa.int32()))], ["id", "key", "vector", "least", "targets"])

    def work(shard: Shard, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q, own, key = multi_index.matrix(part.column("vector")), np.asarray(part.column("id")), np.asarray(part.column("key"))
        scores = shard.scores(q, np.asarray(part.column("least")))
        who, what, exact = nearest_in(q, own, shard.x, shard.ids, scores, most)
        yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(key[who]), pa.array(shard.ids[what]), pa.array(exact)], ["query", "key", "vec_id", "score"])

    kind = queries.schema["vector"].dataType.simpleString()
    probes = queries.withColumn("key", F.xxhash64("vector")).mapInArrow(send, f"id long, key long, vector {kind}, least double, targets array<int>")
    probes = probes.withColumn("target", F.explode("targets")).drop("targets")
    found = multi_index.visit(placed.withColumnRenamed("vec_id", "id"), probes, index, work, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "key").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= most).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
