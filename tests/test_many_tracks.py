"""Decoders over many tracks at once: the same as track by track, in steps of the longest track alone."""

import numpy as np

from staveframe.operators import decoders as D
from staveframe.operators import tracks as T

ROOTS = np.array([0, 7, 9, 5, -1])


def windows(rng, n):
    start = np.cumsum(rng.choice([0.25, 0.5, 0.75], n))
    return D.Windows(
        start, start + rng.choice([0.25, 0.5, 1.0, 2.0]), np.round(rng.random((n, 5)), 2), rng.choice([1, 0.86, 0.72], n), rng.random(n) < 0.1, rng.random(n), rng.random(n) / 10, rng.random((n, 2)) * 0.4,
        [None if rng.random() < 0.3 else (int(rng.integers(12)), "major", 0.8)] * n, rng.random(n) * 0.1,
    )


def joined(parts):
    both = {f: [getattr(p, f) for p in parts] for f in D.Windows.__dataclass_fields__}
    return D.Windows(**{f: sum(v, []) if f == "key" else np.concatenate(v) for f, v in both.items()}), np.r_[0, np.cumsum([len(p.start) for p in parts])]


def test_many_tracks_like_each_alone(monkeypatch):
    rng = np.random.default_rng(1)
    parts = [windows(rng, int(n)) for n in rng.integers(1, 90, 50)]
    alone = np.concatenate([D.lasting_path(p, ROOTS) for p in parts])
    whole, cuts = joined(parts)
    steps, costs = [], D.change_costs
    monkeypatch.setattr(D, "change_costs", lambda w, t, *more: steps.append(t) or costs(w, t, *more))
    assert (D.lasting_paths(whole, cuts, ROOTS) == alone).all()
    assert len(steps) < 90 * 5  # the windows of one number of all tracks whose states last equally long at once


def test_playable_shapes_are_worked_out_once(monkeypatch):
    calls, shapes = [], D.shapes_of
    monkeypatch.setattr(D, "shapes_of", lambda *a: calls.append(a) or shapes(*a))
    D.chord_shapes([[(float(k), k + 0.5, m, 0.9, k) for m in (40, 47)] for k in range(100)], lambda m: T._positions(m, 20))
    assert len(calls) == 1


def test_tracks_over_several_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3000")
    try:
        notes = spark.range(30_000).selectExpr("int(id % 7) track", "id", "id / 7.0D at", "id / 7.0D + 0.5D end", "int(id % 45) + 40 midi", "0.9D score").repartition(5)
        got = T.lead_voices(notes, "track", 0.3).groupBy("track").count().collect()
        one = T.lead_voices(notes.where("track = 3"), "track", 0.3).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 7 and {r.track: r["count"] for r in got}[3] == one > 100
