"""Candidates drawn from a seed: the same at any partitioning, and those of a generator that counts on one by one."""

from staveframe.operators import calibration as C


def generator(seed):
    state = seed % 2**32
    while True:
        state = (state + 0x6D2B79F5) % 2**32
        x = (state ^ (state >> 15)) * (state | 1) % 2**32
        x ^= (x + (x ^ (x >> 7)) * (x | 61)) % 2**32
        yield (x ^ (x >> 14)) / 2**32


def up(x):
    return int(x * 1000 + 0.5) / 1000


def test_candidates(spark):
    for seed in (1, 20260725, 2**32 - 1):
        rows = {r.id: r for r in C.candidates(spark, seed, 120).repartition(7).collect()}
        assert len(rows) == 126 and rows["current-adaptive"].most_guitar == 0.55 and rows["chord-evidence-only"].bass_weight == 0
        draws = generator(seed)
        for k in range(120):
            d = [next(draws) for _ in range(8)]
            r = rows[f"random-{k + 1:02d}"]
            weight = up(0.35 + d[0] * 0.5)
            assert (r.learned_weight, r.most_guitar) == (weight, up(max(weight, 0.5 + d[1] * 0.4)))
            assert (r.boundary_weight, r.bass_weight) == (C.BOUNDARIES[int(d[2] * 3)], C.BASSES[int(d[3] * 3)])
            assert (r.least_learned, r.most_entropy, r.protected) == (up(0.35 + d[4] * 0.27), up(0.7 + d[5] * 0.29), up(0.68 + d[6] * 0.2))
            assert r.calibration == ("temperature" if d[7] < 0.25 else "none") and r.adaptive and r.place == 6 + k


def test_screening_reads_windows_once(spark):
    from staveframe.plans.roles import judged

    plan = C.screened(judged(spark, "/root/testdata/sf0.001"), C.candidates(spark, 7, 20), "user_id", [0, 0, 9, 5, None])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert C.screened(judged(spark, "/root/testdata/sf0.001").limit(0), C.candidates(spark, 7, 2), "user_id", [0, 0, 9, 5, None]).count() == 0


def test_engines_are_compared_in_one_scan(spark):
    """The shares are those of a plain loop over the windows; the first engine gains nothing on itself."""
    from staveframe.plans.roles import judged

    roots = [0, 0, 9, 5, None]
    windows = judged(spark, "/root/testdata/sf0.001")
    found = C.compared(windows, "user_id", roots)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {(r.user_id, r.engine): r for r in found.collect()}
    tracks = {}
    for w in windows.orderBy("user_id", "place").collect():
        tracks.setdefault(w.user_id, []).append(w)
    assert len(got) == len(tracks) * len(C.ENGINES)
    for user, rows in tracks.items():
        rules = [list(w.rules).index(max(w.rules)) for w in rows]
        learned = [list(w.learned).index(max(w.learned)) for w in rows]
        for name, labels in (("rule-only", rules), ("learned-only", learned)):
            r, seconds = got[user, name], sum(w.seconds for w in rows)
            right = sum(w.seconds for w, x in zip(rows, labels, strict=True) if x + 1 == w.wanted)
            near = sum(w.seconds for w, x in zip(rows, labels, strict=True) if roots[x] == roots[w.wanted - 1])
            assert abs(r.detailed - right / seconds) < 1e-9 and abs(r.root - near / seconds) < 1e-9 and r.seconds == seconds
            assert r.regions == 1 + sum(a != b for a, b in zip(labels, labels[1:], strict=False))
            assert abs(r.differs - sum(w.seconds for w, x, y in zip(rows, labels, rules, strict=True) if x != y)) < 1e-9
        of_user = [got[user, e[0]] for e in C.ENGINES]
        assert of_user[0].gain == 0 and of_user[0].learned == 0 and sorted(r.rank for r in of_user) == list(range(1, len(C.ENGINES) + 1))
        assert all(abs(r.gain - (r.detailed - of_user[0].detailed)) < 1e-12 for r in of_user)
    assert C.compared(windows.limit(0), "user_id", roots).count() == 0
