"""The inverted multi-index that operators 11 and 12 search: two codebooks, one for each half of a vector, whose pairs of
codes are cells.

Codebooks are fitted on ``FIT_ROWS`` rows at most, chosen by a hash of their vectors; every row is put in a cell. The
driver gets what is of the size of the codebooks only: a count for each cell and a radius for each code. Cells are dealt
to shards of bounded size in the order of their codes; a cell that is larger than a shard is split over several. A probe
goes once to each shard that has one of its cells, so the number of copies grows with the cells that it visits and not
with the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from staveframe.llm._lineage import cut

#: Rows that the codebooks are fitted on, at most, and their components together; rounds of the fit.
FIT_ROWS, FIT_VALUES, ROUNDS = 20_000, 2_000_000, 10
#: Codes of a half: so many that a cell has about CELL_ROWS rows, within these bounds.
CELL_ROWS, LEAST_CODES, MOST_CODES = 32, 4, 1024
#: Components in a shard, at most, and the shards that there are at least where there are rows enough.
SHARD_VALUES, SHARDS, LEAST_SHARD = 3_200_000, 16, 500
#: Probes that are compared with a shard at once.
PROBES = 128


def usable(rows: DataFrame, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    """``vec_id, vector`` and the others, of the rows that take part: those with an id and a vector of finite components
    which has the length that most such vectors have (the greatest, where there are several)."""
    kind = rows.schema[vector_col].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType)
    vector = F.col(f"`{vector_col}`") if plain else F.col(f"`{vector_col}`").cast("array<double>")
    chosen = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"), *others)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = chosen.where(F.coalesce(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite, F.lit(False)))
    length = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("vector") == (length["n"] if length else 0))


def representatives(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """Rows equal in all columns once, and of those equal in the vector and ``keys`` the ``most`` with the smallest ids: no
    search for fewer can tell the others. Both steps shrink the rows before they are shuffled."""
    within = Window.partitionBy("vector", *keys).orderBy("vec_id")
    return rows.distinct().withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= most).drop("nth")


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of an array."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)[None, :]


def codebook(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Centroids by Lloyd's rounds, from distinct rows on; the same for the same rows in any order of equal ones."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(x, axis=0)
    codes = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        own = np.concatenate([_distances(x[a : a + 4096], codes).argmin(axis=1) for a in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(codes))
        sums = np.stack([np.bincount(own, weights=x[:, d], minlength=len(codes)) for d in range(x.shape[1])], axis=1)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


@dataclass
class Index:
    """Codebooks, what the cells hold, and which shards hold them."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray = None
    radius: tuple = (0.0, 0.0)
    shard: np.ndarray = None
    parts: np.ndarray = None
    shards: int = 1

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each vector, and its distances from the two centroids."""
        out = []
        for part, codes in ((x[:, : self.half], self.first), (x[:, self.half :], self.second)):
            own = _distances(part, codes).argmin(axis=1)
            out.append((own, np.sqrt(((part - codes[own]) ** 2).sum(axis=1))))
        return out[0][0] * len(self.second) + out[1][0], out[0][1], out[1][1]

    def half_scores(self, q: np.ndarray, bounds: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of each probe's halves with the codes; with ``bounds`` those that no vector of a code exceeds."""
        out = []
        for part, codes, radius in ((q[:, : self.half], self.first, self.radius[0]), (q[:, self.half :], self.second, self.radius[1])):
            scores = part @ codes.T
            if bounds:
                reach = np.sqrt((part * part).sum(axis=1))[:, None]
                scores = scores + reach * (radius + 1e-9 * (1 + np.sqrt((codes * codes).sum(axis=1))))[None, :]
            out.append(scores)
        return out[0], out[1]

    def reached(self, a: np.ndarray, b: np.ndarray, want: int) -> float:
        """The sum of half scores of the last cell that a probe visits: cells come from the greatest sum on, taken from a
        heap that holds one cell of each code of the first half, until they hold ``want`` rows."""
        if want >= self.counts.sum():
            return -np.inf
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        down_a, down_b, counts = a[by_a].tolist(), b[by_b].tolist(), self.counts[by_a][:, by_b].tolist()
        heap, got, last = [(-(down_a[0] + down_b[0]), 0, 0)], 0, 0.0
        while heap and got < want:
            last, i, j = heapq.heappop(heap)
            got += counts[i][j]
            if j + 1 < len(down_b):
                heapq.heappush(heap, (-(down_a[i] + down_b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(down_a):
                heapq.heappush(heap, (-(down_a[i + 1] + down_b[0]), i + 1, 0))
        return -last - 1e-9 * (1 + abs(last))

    def shards_of(self, a: np.ndarray, b: np.ndarray, least: float) -> list[int]:
        """The shards with a cell whose half scores add up to ``least`` or more."""
        cells = np.flatnonzero(((a[:, None] + b[None, :] >= least) & (self.counts > 0)).ravel())
        if not len(cells):
            return []
        one = np.unique(self.shard[cells])
        more = cells[self.parts[cells] > 1]
        return np.unique(np.concatenate([one, *(np.arange(self.shard[c], self.shard[c] + self.parts[c]) for c in more.tolist())])).tolist()

    def deal(self, rows_a_shard: int) -> None:
        """Gives cells, in the order of their codes, to shards of about so many rows; larger cells get several alone."""
        flat = self.counts.ravel()
        self.shard, self.parts = np.zeros(len(flat), dtype=np.int64), np.ones(len(flat), dtype=np.int64)
        at, room = 0, rows_a_shard
        for cell in np.flatnonzero(flat).tolist():
            n = int(flat[cell])
            if n > room and room < rows_a_shard:
                at, room = at + 1, rows_a_shard
            self.shard[cell] = at
            if n > rows_a_shard:
                self.parts[cell] = -(-n // rows_a_shard)
                at += int(self.parts[cell])
            else:
                room -= n
        self.shards = max(1, at + (room < rows_a_shard))


def build(rows: DataFrame, as_vectors: Callable[[pa.Array], np.ndarray] = matrix) -> tuple[DataFrame, Index | None]:
    """All rows with their ``cell`` and ``target`` shard, and the index; no index for an empty table.

    Costs two passes over the rows: one finds the sample, one places every row (written to the shared folder)."""
    head = rows.select("vector").first()
    if head is None:
        return rows.withColumn("cell", F.lit(0)).withColumn("target", F.lit(0)), None
    width = len(head["vector"])
    n, most = rows.count(), max(256, min(FIT_ROWS, FIT_VALUES // width))
    sample = rows.orderBy(F.xxhash64("vector"), "vector").limit(most).select("vector").toArrow()
    x = as_vectors(sample.column("vector").combine_chunks())
    x = x[np.lexsort(x.T)]
    codes = int(min(MOST_CODES, max(LEAST_CODES, round((n / CELL_ROWS) ** 0.5))))
    half = (width + 1) // 2
    index = Index(codebook(x[:, :half], codes), codebook(x[:, half:], codes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, near, far = index.place(as_vectors(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near), pa.array(far)], [*batch.schema.names, "cell", "r1", "r2"])

    schema = StructType(list(rows.schema.fields)).add("cell", "integer").add("r1", "double").add("r2", "double")
    placed = cut(rows.mapInArrow(place, schema))
    index.counts = np.zeros((len(index.first), len(index.second)), dtype=np.int64)
    index.radius = np.zeros(len(index.first)), np.zeros(len(index.second))
    for cell, count, r1, r2 in placed.groupBy("cell").agg(F.count("*"), F.max("r1"), F.max("r2")).collect():  # as many as codes x codes at most
        i, j = divmod(cell, len(index.second))
        index.counts[i, j] = count
        index.radius[0][i], index.radius[1][j] = max(index.radius[0][i], r1), max(index.radius[1][j], r2)
    index.deal(max(LEAST_SHARD, min(SHARD_VALUES // width, -(-n // SHARDS))))
    lookup = placed.sparkSession.createDataFrame([(int(c), int(index.shard[c]), int(index.parts[c])) for c in np.flatnonzero(index.counts.ravel())], "cell int, shard int, parts int")
    dealt = placed.drop("r1", "r2").join(F.broadcast(lookup), "cell")  # no more rows than cells
    own = F.col("shard") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))
    return dealt.withColumn("target", own.cast("int")).drop("shard", "parts"), index


class Shard:
    """Rows of one shard in the order of their cells."""

    def __init__(self, batches: list[pa.RecordBatch], index: Index, as_vectors: Callable[[pa.Array], np.ndarray]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        cell = np.asarray(rows.column("cell"))
        by = np.argsort(cell, kind="stable")
        self.index, self.ids = index, np.asarray(rows.column("id"))[by]
        self.labels = np.asarray(rows.column("label"))[by] if "label" in rows.schema.names else None
        self.x = as_vectors(rows.column("vector").combine_chunks())[by]
        self.cells, start = np.unique(cell[by], return_index=True)
        self.spans = list(zip(start.tolist(), [*start.tolist()[1:], len(by)], strict=True))

    def scores(self, q: np.ndarray, least: np.ndarray, bounds: bool = False, product: Callable = np.matmul) -> np.ndarray:
        """Inner products of probes with the rows of the cells that each visits; minus infinity for the others."""
        a, b = self.index.half_scores(q, bounds)
        i, j = np.divmod(self.cells, len(self.index.second))
        visits = a[:, i] + b[:, j] >= least[:, None]
        out = np.full((len(q), len(self.ids)), -np.inf)
        for k, (start, end) in enumerate(self.spans):
            who = np.flatnonzero(visits[:, k])
            if len(who):
                out[who, start:end] = product(q[who], self.x[start:end].T)
        return out


def visit(entries: DataFrame, probes: DataFrame, index: Index, work: Callable[[Shard, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, as_vectors: Callable = matrix) -> DataFrame:
    """``work`` for every shard and the probes that come to it, some at a time. ``entries`` have their ``target``,
    ``probes`` a row for each shard that they visit; columns that only one of both has are null in the other. A task
    holds the rows of one shard and streams the probes past them."""
    both = entries.withColumn("role", F.lit(0)).unionByName(probes.withColumn("role", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, waiting, shard = None, [], None
        for batch in batches:
            ids, role = np.asarray(batch.column("target")), np.asarray(batch.column("role"))
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(ids)].tolist(), strict=True):
                if a == b:
                    continue
                if ids[a] != target:
                    target, waiting, shard = ids[a], [], None
                if role[a] == 0:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if waiting:
                    shard, waiting = Shard(waiting, index, as_vectors), []
                if shard is not None:
                    for start in range(a, b, PROBES):
                        yield from work(shard, batch.slice(start, min(PROBES, b - start)))

    dealt = both.repartitionById(index.shards, F.col("target"))
    return dealt.sortWithinPartitions("target", "role").mapInArrow(run, schema)


def best(scores: np.ndarray, ids: np.ndarray, most: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Probe and column of all that can be among each probe's first ``most``: no less than the score at that place, less
    the slack; all ties are in it."""
    if scores.shape[1] > most:
        least = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most] - slack
    else:
        least = np.full(len(scores), -np.inf)
    return np.nonzero((scores >= least[:, None]) & (scores > -np.inf))


def first_of(probe: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of each probe's first ``most`` by score descending and id ascending, in this order."""
    by = np.lexsort((ids, -score, probe))
    start = np.r_[0, np.flatnonzero(np.diff(probe[by])) + 1]
    nth = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
    return by[nth < most]
