"""Operator 9: near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors that are equal are one class; the classes are dealt to shards, and each shard gets a graph of layers, of
which every one holds a sixteenth of the one below. A search goes down from the top and keeps a beam of the best
vectors met; it is done for many queries at once. Every class is searched for in every other shard (for each two
shards, from one of the two sides) and in its own. Beams start at ``BEAM``. In each shard a sample of its own vectors,
and a hashed sample of the queries that come to it from other shards, are held against an exact comparison; while less
than ``RECALL`` of a sample's links are found, the beam is doubled. A sample of few links or none proves nothing: the
beam is ``WIDE`` at least then. A query whose beam is full of links goes on with a wider one. Links are verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveframe.llm._lineage import cut
from staveframe.llm.components import components

LEAST = 0.95
DEGREE, BUILD_BEAM, BEAM = 16, 32, 16
RECALL, AUDIT = 0.98, 128
#: Vectors that an audit looks at, at most; the links that it must rest on, and the beam where there are fewer.
SAMPLE, AUDIT_LINKS, WIDE = 4096, 32, 256
#: Shards: an odd number, at least so many, and so that none has more classes than this.
SHARDS, SHARD_ROWS = 9, 50_000
#: Room that a search may take for an exact margin below the bound, as it runs in single precision.
SLACK = 1e-4


class Graph:
    """A layered small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 9):
        n = len(vectors)
        self.order = np.random.default_rng(seed).permutation(n)
        self.x = vectors[self.order].astype(np.float32)
        self.sizes = [n]
        while self.sizes[-1] > 64:
            self.sizes.append(max(1, self.sizes[-1] // DEGREE))
        self.links: dict[int, np.ndarray] = {}
        for level in range(len(self.sizes) - 2, -1, -1):
            self._build(level)

    def _build(self, level: int) -> None:
        n = self.sizes[level]
        self.links[level] = links = np.full((n, 2 * DEGREE), -1, dtype=np.int32)
        first = min(n, max(self.sizes[level + 1], 4 * DEGREE))
        for a in range(0, first, 512):
            b = min(first, a + 512)
            sims = self.x[a:b] @ self.x[:first].T
            sims[np.arange(b - a), np.arange(a, b)] = -np.inf
            k = min(BUILD_BEAM, first - 1)
            if k:
                ids = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                chosen = self._diverse(np.arange(a, b), ids, 2 * DEGREE)
                links[a:b, : chosen.shape[1]] = chosen
        at = first
        while at < n:
            end = min(n, at + min(at, 512))
            new = np.arange(at, end)
            found, _ = self.search(self.x[at:end], BUILD_BEAM, level, at)
            inside = self.x[at:end] @ self.x[at:end].T
            np.fill_diagonal(inside, -np.inf)
            k = min(8, len(new) - 1)
            both = np.concatenate([found, new[np.argpartition(-inside, k - 1, axis=1)[:, :k]]], axis=1) if k else found
            chosen = self._diverse(new, both, DEGREE)
            links[at:end, : chosen.shape[1]] = chosen
            self._link_back(links, new, chosen)
            at = end

    def _diverse(self, own: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, from the nearest on, those nearer to the vector than to any chosen before;
        what room is left goes to the nearest others."""
        sims = np.einsum("bd,bkd->bk", self.x[own], self.x[np.maximum(ids, 0)])
        sims[ids < 0] = -np.inf
        by = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        c = self.x[np.maximum(ids, 0)]
        mutual = np.einsum("bkd,bld->bkl", c, c)
        taken = np.zeros(ids.shape, dtype=bool)
        for k in range(ids.shape[1]):
            rival = np.where(taken, mutual[:, k, :], -np.inf).max(axis=1)
            taken[:, k] = (ids[:, k] >= 0) & (sims[:, k] > rival) & (taken.sum(axis=1) < most)
        rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
        by = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, by, 1).astype(np.int32)

    def _link_back(self, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        which, start, count = np.unique(target, return_index=True, return_counts=True)
        width = int(min(count.max(), 64))
        extra = np.full((len(which), width), -1, dtype=np.int32)
        nth = np.arange(len(target)) - np.repeat(start, count)
        fits = nth < width
        extra[np.repeat(np.arange(len(which)), count)[fits], nth[fits]] = source[fits]
        for a in range(0, len(which), 1024):
            w = which[a : a + 1024]
            links[w] = self._padded(self._diverse(w, np.concatenate([links[w], extra[a : a + 1024]], axis=1), 2 * DEGREE), 2 * DEGREE)

    @staticmethod
    def _padded(rows: np.ndarray, width: int) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, width - rows.shape[1])), constant_values=-1) if rows.shape[1] < width else rows

    def search(self, q: np.ndarray, beam: int, level: int = 0, within: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (in the graph's order) and similarities of the beam of each query, nearest first; -1 where it's short."""
        q = q.astype(np.float32)
        top = self.x[: self.sizes[-1]]
        sims = q @ top.T
        k = min(4, len(top))
        ids = np.argpartition(-sims, k - 1, axis=1)[:, :k].astype(np.int32)
        for upper in range(len(self.sizes) - 2, level, -1):
            ids = self._walk(q, ids, self.links[upper], 8)[0][:, :4]
        if level not in self.links:  # a graph of one small layer
            by = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            return by.astype(np.int32), np.take_along_axis(sims, by, 1)
        return self._walk(q, ids, self.links[level][:within] if within else self.links[level], beam)

    def _walk(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, width, step = len(q), links.shape[1], 4
        beam = max(beam, entry.shape[1])
        seen = np.zeros((n, len(links)), dtype=bool)
        ids, sims = np.full((n, beam), -1, dtype=np.int32), np.full((n, beam), -np.inf, dtype=np.float32)
        k = entry.shape[1]
        ids[:, :k] = entry
        r = np.arange(n)
        sims[:, :k] = np.where(entry >= 0, np.einsum("bd,bkd->bk", q, self.x[np.maximum(entry, 0)]), -np.inf)
        seen[np.repeat(r, k), np.maximum(entry, 0).ravel()] = True
        todo = ids >= 0
        live = r
        while len(live):
            own = np.where(todo[live], sims[live], -np.inf)
            pick = np.argpartition(-own, min(step, beam) - 1, axis=1)[:, :step]
            good = np.take_along_axis(own, pick, 1) > -np.inf
            some = good.any(axis=1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            rows = np.repeat(live, pick.shape[1])[good.ravel()]
            todo[rows, pick.ravel()[good.ravel()]] = False
            near = links[ids[rows, pick.ravel()[good.ravel()]]]
            owner = np.repeat(rows, width)
            near = near.ravel()
            fresh = (near >= 0) & (near < len(links))
            owner, near = owner[fresh], near[fresh]
            fresh = ~seen[owner, near]
            code = np.unique(owner[fresh].astype(np.int64) * len(links) + near[fresh])
            owner, near = code // len(links), (code % len(links)).astype(np.int32)
            seen[owner, near] = True
            if not len(owner):
                continue
            value = np.einsum("kd,kd->k", q[owner], self.x[near])
            better = value > sims[owner].min(axis=1) if beam < 16 else value > sims.min(axis=1)[owner]
            owner, near, value = owner[better], near[better], value[better]
            if not len(owner):
                continue
            who, start, count = np.unique(owner, return_index=True, return_counts=True)
            wide = int(count.max())
            spot = np.arange(len(owner)) - np.repeat(start, count)
            line = np.repeat(np.arange(len(who)), count)
            more_ids, more = np.full((len(who), wide), -1, dtype=np.int32), np.full((len(who), wide), -np.inf, dtype=np.float32)
            more_ids[line, spot], more[line, spot] = near, value
            all_ids, all_sims = np.concatenate([ids[who], more_ids], axis=1), np.concatenate([sims[who], more], axis=1)
            all_todo = np.concatenate([todo[who], more_ids >= 0], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[who], sims[who], todo[who] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_todo, top, 1)
        by = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)

    def links_from(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) with a similarity of ``least`` or more that beams of at least this width meet."""
        found_q, found_v = [], []
        todo = np.arange(len(q))
        while len(todo):
            full = beam >= len(self.x)  # a beam as wide as the shard is a comparison with all of it
            size = max(1, min(256, (1 << 22) // max(1, beam)))
            left = []
            for a in range(0, len(todo), size):
                own = todo[a : a + size]
                if full:
                    r, c = np.nonzero(q[own].astype(np.float32) @ self.x.T >= least)
                    ids = None
                else:
                    ids, sims = self.search(q[own], beam)
                    hit = (sims >= least) & (ids >= 0)
                    wider = hit.all(axis=1)
                    left.append(own[wider])
                    hit[wider] = False
                    r, c = np.nonzero(hit)
                    c = ids[r, c]
                found_q.append(own[r])
                found_v.append(self.order[c])
            todo = np.concatenate(left) if left else todo[:0]
            beam *= 4
        return (np.concatenate(found_q), np.concatenate(found_v)) if found_q else (np.zeros(0, dtype=np.int64),) * 2

    def audited(self, least: float, beam: int, foreign: np.ndarray | None = None) -> int:
        """The beam, doubled until at least ``RECALL`` of the links of a sample are found; the sample is of vectors that
        have links: of ``foreign`` or, without it, of the shard's own. With less than ``AUDIT_LINKS`` links to go by,
        the beam is ``WIDE`` at least."""
        own = foreign is None
        exact, q, seen = [], self.x[:SAMPLE] if own else foreign[:SAMPLE].astype(np.float32), 0
        for a in range(0, len(q), 256):
            r, c = np.nonzero(q[a : a + 256] @ self.x.T >= least)
            r += a
            if own:
                r, c = r[r != c], c[r != c]
            exact += zip(r.tolist(), self.order[c].tolist(), strict=True)
            seen += len(np.unique(r))
            if seen >= AUDIT:
                break
        sample = np.array(sorted({r for r, _ in exact})[:AUDIT], dtype=np.int64)
        kept = set(sample.tolist())
        true = {(r, c) for r, c in exact if r in kept}
        if len(true) < AUDIT_LINKS:
            beam = max(beam, WIDE)
        while len(sample) and beam < len(self.x):
            r, c = self.links_from(q[sample], least, beam)
            if len(true & set(zip(sample[r].tolist(), c.tolist(), strict=True))) >= RECALL * len(true):
                break
            beam *= 2
        return beam


def _unit(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # squares of very large or small components leave the range
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _least_reached(i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    least = node.copy()
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == least).all():
            return least
        least = new


def linked(rows: DataFrame, least: float, shards: int = SHARDS) -> DataFrame:
    """``node, links, least`` from rows ``target, role, node, copies, vector``: role 0 makes up a shard, role 1 looks for
    links in it. Each of the shards has a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, waiting, first, state = None, [], [], None

        def build():
            node, copies = np.concatenate([np.asarray(b.column("node")) for b in waiting]), np.concatenate([np.asarray(b.column("copies")) for b in waiting])
            unit = np.concatenate([_unit(b.column("vector")) for b in waiting])
            graph = Graph(unit)
            inner = graph.audited(least - SLACK, BEAM)
            outer = graph.audited(least - SLACK, BEAM, np.concatenate([_unit(b.column("vector")) for b in first])) if first else inner
            return node, copies, unit, graph, inner, outer

        def answer(state, node, copies, unit, own: bool):
            members, their, vectors, graph, inner, outer = state
            beam = inner if own else outer
            for a in range(0, len(node), 4096):
                part = slice(a, a + 4096)
                i, j = graph.links_from(unit[part], least - SLACK, beam)
                i += a
                true = np.einsum("kd,kd->k", unit[i], vectors[j]) >= least
                i, j = i[true], j[true]
                if own:
                    keep = i != j
                    pair = np.unique(np.minimum(i, j)[keep] * len(node) + np.maximum(i, j)[keep])
                    yield pair // len(node), pair % len(node)
                elif len(i):
                    yield i, j

        def told(i, j, left, right, left_copies, right_copies):
            ids, back = np.unique(np.r_[left[i], right[j]], return_inverse=True)
            p, q = back[: len(i)], back[len(i) :]
            links = np.bincount(p, weights=right_copies[j], minlength=len(ids)) + np.bincount(q, weights=left_copies[i], minlength=len(ids))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(_least_reached(p, q, ids))], ["node", "links", "least"])

        def own_links(state):
            pairs = list(answer(state, state[0], state[1], state[2], True))
            n = len(state[0])
            both = np.unique(np.concatenate([a * n + b for a, b in pairs])) if pairs else np.zeros(0, dtype=np.int64)
            if len(both):
                yield told(both // n, both % n, state[0], state[0], state[1], state[1])

        def foreign_links(state, part):
            node, copies, unit = np.asarray(part.column("node")), np.asarray(part.column("copies")), _unit(part.column("vector"))
            for i, j in answer(state, node, copies, unit, False):
                yield told(i, j, node, state[0], copies, state[1])

        def begin():
            """The graph of the rows that wait, audited by the first queries from other shards; its own links and theirs."""
            nonlocal state, waiting, first
            state = build()
            waiting = []
            yield from own_links(state)
            for part in first:
                yield from foreign_links(state, part)
            first = []

        for batch in batches:
            ids, role = np.asarray(batch.column("target")), np.asarray(batch.column("role"))
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(ids)].tolist(), strict=True):
                if b == a:
                    continue
                if ids[a] != target:
                    if waiting:
                        yield from begin()
                    target, waiting, first, state = ids[a], [], [], None
                part = batch.slice(a, b - a)
                if role[a] == 0:
                    waiting.append(part)
                elif waiting:
                    room = SAMPLE - sum(len(x) for x in first)
                    first.append(part.slice(0, room))
                    if len(part) >= room:
                        yield from begin()
                    if len(part) > room:
                        yield from foreign_links(state, part.slice(room))
                elif state is not None:  # else nothing to search in
                    yield from foreign_links(state, part)
        if waiting:
            yield from begin()

    dealt = rows.repartitionById(shards, F.pmod("target", F.lit(shards)).cast("int"))
    return dealt.sortWithinPartitions("target", "role", F.xxhash64("node", F.lit(9))).mapInArrow(run, "node long, links long, least long")


def join(embeddings: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of ``embeddings``: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other vectors with a cosine of ``least`` or more, copies included; ``component_id`` is the
    smallest id that links lead to. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and neither do rows without an id or vectors of different lengths with each other. Repeated rows count as
    vectors of their own. Other columns are left out.
    """
    source = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    valid = source.where(usable)
    classes = cut(valid.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    n = classes.count()
    shards = max(SHARDS, -(-n // SHARD_ROWS)) | 1
    shard = F.pmod(F.xxhash64("vector"), F.lit(shards))
    # Vectors of shard i look for links in the shards i + 1 to i + (shards - 1) / 2, so that each two shards meet once.
    spots = F.transform(F.sequence(F.lit(0), F.lit(shards // 2)), lambda k: F.struct((F.pmod(F.col("shard") + k, F.lit(shards)) + F.size("vector") * shards).alias("target"), F.when(k == 0, 0).otherwise(1).alias("role")))
    rows = classes.withColumn("shard", shard).select("node", "copies", "vector", F.explode(spots).alias("spot")).select("spot.target", "spot.role", "node", "copies", "vector")
    found = cut(linked(rows, least, shards))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    graph = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    told = classes.join(counted, "node", "left").join(graph.select(F.col("id").alias("node"), "component"), "node", "left")
    told = told.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    told = told.where(F.col("n_links") > 0)
    out = source.withColumn("vector", F.when(F.col("vec_id").isNotNull(), F.col("vector"))).join(told, "vector", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
