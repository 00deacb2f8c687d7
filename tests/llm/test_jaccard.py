from collections import defaultdict

import numpy as np

from staveframe.llm import jaccard as jn


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(k, i, shingles(t)) for k, (i, t) in enumerate(rows)]
    links, up = defaultdict(int), {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    held = [x for x in sets if x[2] and x[1] is not None]
    for a in range(len(held)):
        for b in range(a + 1, len(held)):
            x, y = held[a][2], held[b][2]
            n = len(x & y)
            if 5 * n >= 4 * (len(x) + len(y) - n):
                for k in (a, b):
                    links[held[k][0]] += 1
                p, q = find(held[a][0]), find(held[b][0])
                up[q] = p
    groups = defaultdict(list)
    for k, i, _ in sets:
        groups[find(k)].append(i)
    return sorted((i if i is not None else -1, links[k], min((x for x in groups[find(k)] if x is not None), default=-1)) for k, i, _ in sets), len(groups)


def told(found):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in found)


def test_odd_rows(docs, empty, rows):
    found = jn.join(docs).collect()
    want, groups = brute(rows)
    assert told(found) == want and sum(r.kept for r in found) == groups
    left = jn.dedup(docs)
    assert left.columns == docs.columns and left.count() == groups
    assert jn.join(empty).count() == 0 and jn.dedup(empty).count() == 0


def test_large_groups_are_split_and_blocked(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(160):  # one large group of near copies, beside pairs and single texts
        words = [f"w{j}" for j in range(150)]
        for j in rng.integers(0, 150, size=rng.integers(0, 4)):
            words[j] = f"x{rng.integers(1_000_000)}"
        rows.append((k, " ".join(words)))
    for k in range(60):
        text = " ".join(f"p{k}q{j}" for j in range(100))
        rows += [(1000 + k, text), (2000 + k, text.replace(f"p{k}q5 ", "other ")), (3000 + k, " ".join(f"s{k}t{j}" for j in range(50)) + " some shared words at the end of many texts")]
    monkeypatch.setattr(jn, "LIMIT", 20)
    monkeypatch.setattr(jn, "BLOCK", 40)
    found = jn.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want, groups = brute(rows)
    got = told(found)
    assert sum(x[1] for x in got) >= 0.995 * sum(x[1] for x in want) and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert [x[2] for x in got] == [x[2] for x in want] and sum(r.kept for r in found) == groups


def test_overlaps():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, size=rng.integers(1, 120))).astype(np.uint64) for _ in range(120)]
    got = jn.overlaps(sets[:50], sets[50:])
    assert (got == np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets[50:]] for a in sets[:50]])).all()
