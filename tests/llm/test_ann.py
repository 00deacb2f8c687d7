"""Nearest neighbours against brute force: recall on clusters, exact lists where the budget covers all, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from staveframe.llm import ann, multi_index

CLASHES = ("id", "key", "cell", "target", "role", "label", "vector", "nth", "r1", "shard", "query", "a.b")
SCHEMA = "vec_id long, embedding array<double>"


def wanted(rows, most, every=20):
    """Lists of each query row (id and vector), by inner products added up from the first component on."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    lengths = [len(v) for _, v in good]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    good = sorted(g for g in good if len(g[1]) == width)
    out = []
    for i, v in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i)
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:most])]
    return sorted(out)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(a) for a in rng.integers(-2, 3, size=6)]) for k in range(-60, 300)]  # many equal vectors and equal scores
    rows += [(500 + k, [1.0, 2.0, 0.0, 0.0, -1.0, 1.0]) for k in range(150)] + rows[:20]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 6), (1060, [float("nan")] * 6), (1080, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("inf")] + [1.0] * 5), (1120, [1.0, 0.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"extra {c}") for c in CLASHES}).withColumn("tags", F.create_map(F.lit("a"), F.lit(1))).repartition(3)
    got = sorted(tuple(r) for r in ann.search(frame).collect())
    assert got == wanted(rows, 20)
    assert ann.search(frame.limit(0)).count() == 0
    assert ann.search(frame.where("vec_id >= 1000 OR vec_id IS NULL").where("vec_id <> 1120")).count() == 0
    one = spark.createDataFrame([(20, [2.0]), (21, [3.0]), (22, [-1.0])], SCHEMA)
    assert [tuple(r) for r in ann.search(one).collect()] == [(20, 1, 21, 6.0), (20, 2, 22, -2.0)]


def test_recall_with_a_hot_vector(spark):
    """Clusters, and one vector that a third of the rows have: 0.9 of the true neighbours at least, by scores."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, size=8000)] + 0.4 * rng.normal(size=(8000, 24))
    x[::3] = centres[0]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA).repartition(8)
    got = {}
    for r in ann.search(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    assert sorted(got) == list(range(0, 8000, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - x[q] @ x[v]) < 1e-9 for _, v, s in found)
        scores = x @ x[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-20]
        hits += sum(s >= least - 1e-9 for _, _, s in found)
        # Of equal vectors those with the smallest ids are listed.
        assert [v for _, v, s in found if v % 3 == 0] == [v for v in range(0, 100, 3) if v != q][: sum(v % 3 == 0 for _, v, _ in found)]
    assert hits >= 0.9 * 20 * len(got)


def test_heap_meets_cells_in_order():
    """The heap stops at the cell that a full sort of all cells stops at; shards cover all cells, split ones too."""
    rng = np.random.default_rng(5)
    index = multi_index.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 2)), counts=rng.integers(0, 40, size=(7, 5)))
    index.counts[2, 3] = 500
    index.deal(60)
    q = rng.normal(size=(20, 5))
    a, b = index.half_scores(q)
    for k in range(20):
        sums = (a[k][:, None] + b[k][None, :]).ravel()
        by = np.argsort(-sums)
        for want in (1, 50, 300, 900):
            last = by[np.searchsorted(np.cumsum(index.counts.ravel()[by]), want)]
            assert abs(index.reached(a[k], b[k], want) - sums[last]) < 1e-6
    assert index.reached(a[0], b[0], 10**6) == -np.inf
    everything = index.shards_of(a[0], b[0], -np.inf)
    assert everything == list(range(index.shards)) and index.parts.max() == 9


def test_budget_is_what_the_audit_needs():
    rng = np.random.default_rng(6)
    index = multi_index.Index(rng.normal(size=(40, 3)), rng.normal(size=(40, 3)), counts=np.full((40, 40), 10))
    q = rng.normal(size=(4, 6))
    a, b = index.half_scores(q)
    query = np.repeat(np.arange(4), 100)
    by = [np.argsort(-(a[k][:, None] + b[k][None, :]).ravel()) for k in range(4)]
    cell = np.concatenate([by[k][:700:7] for k in range(4)])  # met after 10, 80, ... rows
    assert ann.budget(index, q, query, cell, 1.0) == 6940
    assert ann.budget(index, q, query, cell, 0.5) == 3440
    assert ann.budget(index, q, query[:0], cell[:0]) == ann.ENTRIES
