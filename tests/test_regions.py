"""Clean-up of regions and reinforcement by repeats against plain loops that start anew after every change."""

import random
from statistics import median

import pytest

from staveframe.operators import regions as R
from staveframe.operators import smoothing
from staveframe.plans.roles import OBSERVED

SCHEMA = "k int, place long, start double, end double, label string, margin double, strength double, scores array<double>, sevenths array<double>, seventh double, bass_root string, bass_confidence double, passing boolean"
root = {"C": "C", "C7": "C", "Am": "A", "F": "F", "N": None}.get


def track(rng, k, n):
    rows, at, label = [], 0.0, "C"
    for place in range(n):
        label = label if rng.random() < 0.45 else rng.choice(OBSERVED)
        length = rng.choice([0.25, 0.5, 0.75])
        scores = [None if rng.random() < 0.05 else round(rng.random(), 3) for _ in OBSERVED]
        if rng.random() < 0.7:
            scores[OBSERVED.index(label)] = round(0.8 + 0.2 * rng.random(), 3)
        rows.append((k, place, at, at + length, label, round(rng.random() * 0.05, 4), rng.choice([1.0, 0.86, 0.72]), scores, [None, round(rng.random() * 0.2, 3), None, None, None], 0.05, rng.choice(["C", "A", "F", None]), round(rng.random() * 0.5, 2), rng.random() < 0.1))
        at += length
    return rows


def literal(rows, reduced):
    """Regions of window ranges; after each change all are looked at from the first on."""
    clamp = lambda x: max(0.0, min(1.0, x))
    score = lambda w, name: -1.0 if (s := w[7][OBSERVED.index(name)]) is None else s
    sure = lambda w, name: clamp(score(w, name)) if name == "N" else clamp(score(w, name) * 0.8 + clamp(w[5] / 0.12) * 0.2)
    bass = lambda w, name: root(name) is not None and w[10] == root(name) and w[11] >= 0.22 and not w[12]
    mean = lambda v: sum(v) / len(v)
    regs = []
    for w in rows:
        if regs and regs[-1][0] == w[4]:
            regs[-1][1].append(w)
        else:
            regs.append([w[4], [w], w[4]])
    for r in regs:
        if r[0] == "C7" and mean([w[8][1] for w in r[1]]) < 0.1:
            r[0] = "C"
    length = lambda r: r[1][-1][3] - r[1][0][2]
    conf = lambda r: mean([sure(w, r[0]) for w in r[1]])
    margin = lambda r: mean([w[5] for w in r[1]])

    def merge():
        k = 0
        while k + 1 < len(regs):
            if regs[k][0] == regs[k + 1][0]:
                regs[k][1] += regs.pop(k + 1)[1]
            else:
                k += 1

    def meant(k):
        r, before, after = regs[k], regs[k - 1] if k else None, regs[k + 1] if k + 1 < len(regs) else None
        if length(r) < median(w[3] - w[2] for w in r[1]) * 0.8:
            return False
        beside = lambda w: max(score(w, before[0]) if before else -1.0, score(w, after[0]) if after else -1.0)
        ahead, hits = mean([score(w, r[0]) - beside(w) for w in r[1]]), sum(bass(w, r[0]) for w in r[1])
        if before and after and before[0] == after[0]:
            return hits == len(r[1]) and margin(r) >= 0.036 and ahead >= 0.04 and conf(r) >= 0.82
        near = [len(x[1]) for x in regs[max(0, k - 2) : k + 3] if x[0] != "N"]
        usual = median(near) if near else 0
        if len(r[1]) >= (1 if usual <= 1.5 else 2 if usual <= 3 else 4):
            return margin(r) >= 0.018 * 0.4 or hits > 0 or ahead >= 0.02
        if len(r[1]) >= 2:
            return hits > 0 or ahead >= 0.02
        return hits > 0 and conf(r) >= 0.16 and margin(r) >= 0.01

    merge()
    changed = True
    while changed and len(regs) > 1:
        changed = False
        for k, r in enumerate(regs):
            before, after = regs[k - 1] if k else None, regs[k + 1] if k + 1 < len(regs) else None
            if length(r) >= (1.0 if r[0] == "N" else 1.5):
                continue
            if r[0] != "N" and ((len(r[1]) >= 2 and conf(r) >= 0.82 and r[1][0][6] >= 0.86) or (reduced and meant(k))):
                continue
            if before and after and (before[0] == after[0] or (root(before[0]) and root(before[0]) == root(after[0]))):
                new = before if conf(before) >= conf(after) else after
            elif before and before[0] == "N" and not (after and after[0] == "N"):
                new = after
            elif after and after[0] == "N" and not (before and before[0] == "N"):
                new = before
            else:
                gain = lambda x: mean([score(w, x[0]) for w in r[1]]) + conf(x) * 0.08 if x else float("-inf")  # noqa: B023, E731
                new = before if gain(before) >= gain(after) else after
            if not new:
                continue
            r[0] = new[0]
            merge()
            changed = True
            break
    k = 0
    while k + 1 < len(regs):
        a, b = regs[k], regs[k + 1]
        if root(a[0]) and root(a[0]) == root(b[0]) and (length(a) < 1.5 or length(b) < 1.5 or margin(a) < 0.01 or margin(b) < 0.01):
            a[0] = a[0] if conf(a) * len(a[1]) >= conf(b) * len(b[1]) else b[0]
            a[1] += regs.pop(k + 1)[1]
        else:
            k += 1
    merge()
    return [(r[1][0][2], r[1][-1][3], r[0], len(r[1])) for r in regs]


@pytest.mark.parametrize("reduced", [False, True])
def test_like_the_literal_clean_up(spark, reduced):
    rng = random.Random(3)
    tracks = {k: track(rng, k, n) for k, n in enumerate([1, 2, 3, 7, 40, 90, 200, 300] + [60] * 12)}
    frame = spark.createDataFrame([r for t in tracks.values() for r in t], SCHEMA)
    got = {k: [] for k in tracks}
    for r in R.cleaned(R.labelled_regions(frame, "k", OBSERVED, "label"), "k", OBSERVED, reduced).orderBy("k", "start").collect():
        got[r.k].append((r.start, r.end, r.label, r.windows))
    assert got == {k: literal(t, reduced) for k, t in tracks.items()}
    assert sum(map(len, got.values())) > 60
    assert R.cleaned(R.labelled_regions(frame.limit(0), "k", OBSERVED, "label"), "k", OBSERVED).count() == 0


def test_long_tracks_leave_the_pass():
    """Settled regions don't stay in memory."""
    tidy, rng, most, given = R.Tidy(OBSERVED, True), random.Random(1), 0, 0
    for k in range(4000):
        n = rng.choice([1, 2, 3, 8, 9])
        name = OBSERVED[(k * 2 + rng.randrange(2)) % 5]
        window = {"seconds": 0.5, "scores": [0.5] * 5, "bass": None}
        given += len(tidy.push({"name": name, "start": k * 10.0, "end": k * 10.0 + n * 0.5, "n": n, "margin": 0.02 * n, "seventh": 0.2 * n, "strength": 0.7, "scores": [0.5 * n] * 5, "sure": [0.5 * n] * 5, "short_windows": [window] * n if n < 3 else []}))
        most = max(most, len(tidy.regions))
    assert most < 120 and given + len(tidy.finish()) > 500


def test_repeats_like_a_plain_loop(spark):
    rng = random.Random(4)
    rows = []
    for k in range(3):
        for place in range(150):
            chroma = [0.0] * 12 if rng.random() < 0.05 else [1.0 + (place // 4 % 5) * j % 7 + round(rng.random(), 2) for j in range(12)]
            rows.append((k, place, chroma, round(rng.random() * 0.05, 4), [None if rng.random() < 0.1 else round(rng.random(), 3) for _ in OBSERVED], rng.choice(OBSERVED)))
    frame = spark.createDataFrame(rows, "k int, place long, chroma array<double>, margin double, scores array<double>, label string")

    def alike(a, b):
        n = sum(x * x for x in a) * sum(x * x for x in b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / n**0.5 if n else 0.0

    for bounded in (True, False):
        want = {}
        for k, place, chroma, margin, scores, _ in rows:
            best, prior = 0.0, None
            for lag in range(4, min(64, place) + 1, 4):
                if (a := alike(chroma, rows[k * 150 + place - lag][2])) > best:
                    best, prior = a, rows[k * 150 + place - lag]
            new = list(scores)
            if prior and best >= 0.9 and prior[5] != "N":
                bonus = min(0.035 * best, max(0.0, min(0.015, margin * 0.5)) if bounded else 9.0)
                j = OBSERVED.index(prior[5])
                new[j] = (-1.0 if new[j] is None else new[j]) + bonus
            want[k, place] = new
        got = {(r.k, r.place): r.scores for r in smoothing.reinforced(frame, "k", OBSERVED, "label", bounded).collect()}
        assert got.keys() == want.keys()
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for p in want for a, b in zip(got[p], want[p], strict=True))
        assert sum(got[r[0], r[1]] != r[4] for r in rows) > 100
