from collections import defaultdict

import numpy as np

from staveframe.llm import line_dedup as ld


def brute(rows):
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    where = defaultdict(set)
    for i, own in lines:
        for x in own:
            k = ld.line_key(x)
            if k is not None:
                where[k].add(i)
    least = lambda i: -1 if i is None else i
    gone = {k: max(s, key=least) for k, s in where.items() if len(s) >= 3}
    return [(i, "\n".join(x for x in own if ld.line_key(x) not in gone or gone[ld.line_key(x)] == i), len(own)) for i, own in lines]


def _key(x):
    return tuple(-1 if v is None else v for v in x)


def test_odd_rows(docs, empty, rows):
    got = ld.dedup_lines(docs)
    assert set(got.columns) == set(docs.columns) and ld.dedup_lines(empty).count() == 0
    assert sorted((_key((r.doc_id, r.text or "", r.n_lines)) for r in got.collect())) == sorted(map(_key, brute(rows)))


def test_random_tables(spark):
    rng = np.random.default_rng(3)
    pool = [f"line number {k} that is long enough to count" for k in range(60)] + ["short", "", "   LINE number 1 THAT is long enough to count\t", "é" * 20, "é" * 19]
    rows = [(int(i), "\n".join(rng.choice(pool, size=rng.integers(0, 12)))) for i in rng.permutation(300)] + [(500, None), (501, ""), (7, pool[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [(r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in ld.dedup_lines(frame).collect()]
    want = [(i, t, n, n - (t.count("\n") + 1) if t or n == 1 else None) for i, t, n in brute(rows)]
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want)
    assert all(d == n - (t.count("\n") + 1) for i, t, n, d in got if t)


def test_full_filter_changes_nothing(spark, monkeypatch):
    rows = [(k, f"this line is in every one of the documents\nline of document {k} alone, and long enough") for k in range(2000)]
    monkeypatch.setattr(ld, "FILTER_BYTES", 128)
    monkeypatch.setattr(ld, "SLICE_BITS", 1024)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.text) for r in ld.dedup_lines(frame).collect()) == sorted(x[:2] for x in brute(rows))


def test_filter_has_no_false_negatives():
    bits = np.zeros(1 << 17, dtype=np.uint8)
    hashes = np.random.default_rng(2).integers(0, 1 << 63, size=5000, dtype=np.uint64)
    at = ld.positions(hashes, 1, 7)
    ld.set_bits(bits, at.ravel())
    assert ld.get_bits(bits, at).all()
