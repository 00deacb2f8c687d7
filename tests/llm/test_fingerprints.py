import hashlib

import numpy as np

from staveframe.llm import fingerprints as fp


def test_homomorphic():
    h = fp.Hasher()
    ab, ba, a, b, c = h.vectors(["one two three four\nsecond line here", "second line here\none two three four", "one two three four", "second line here", "third"])
    assert (ab == ba).all() and (fp.plus(a, b) == ab).all() and (fp.minus(ab, b) == a).all()
    assert not (a == b).all() and (fp.read(fp.written(ab[None])[0]) == ab).all()
    assert (h.vectors([""])[0] == 0).all() and (fp.plus(fp.plus(a, c), b) == fp.plus(ab, c)).all()


def test_likeness():
    words = [f"w{k}" for k in range(2000)]
    h = fp.Hasher()
    whole, half, other = h.vectors([" ".join(words), " ".join(words[:1000] + [f"x{k}" for k in range(1000)]), " ".join(f"y{k}" for k in range(2000))])
    near = fp.likeness(np.stack([whole, whole, whole]), np.stack([whole, half, other]))
    assert near[0] == 1 and 0.35 < near[1] < 0.65 and near[2] < 0.25


def test_against_sorted_texts(docs, empty, rows):
    got = fp.compare_with_next(docs).collect()
    assert len(got) == len(rows)
    import xxhash

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    texts = [rows[k][1] or "" for k in order]
    ids = [rows[k][0] for k in order]
    want = []
    for k, text in enumerate(texts):
        changed = fp.edited(text, texts[(k + 1) % len(texts)])
        want.append((ids[k] or -1, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = {r.fingerprint for r in got if r.doc_id == 11}
    assert len(same) == 1 and xxhash
    assert fp.compare_with_next(empty).count() == 0
    assert fp.compare_with_next(docs.where("doc_id = 8")).first().near_next == 1


def test_many_ranges(spark):
    rows = [(k * 37 % 1009, f"text {k} " * (k % 7)) for k in range(1009)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = fp.with_next(frame, range_bytes=2000)
    assert dealt.rdd.getNumPartitions() > 5
    by_id = dict(rows)
    got = dealt.mapInPandas(lambda it: it, "doc_id long, text string, range int, copy int").collect()
    line = {}
    for a, b in zip(got, got[1:], strict=False):
        if a.range == b.range and not a.copy:
            line[a.doc_id] = b.doc_id
    assert line == {k: (k + 1) % 1009 for k in by_id}


def test_long_repetitive_texts():
    """Counts beyond 16 bits do not wrap round."""
    a, b, c, d = fp.Hasher().vectors(["a b c\n" * k for k in (20_000, 40_000, 32_767, 32_769)])
    near = fp.likeness(np.stack([a, c]), np.stack([b, d]))
    assert (near > 0.999).all() and not (a == b).all()


def test_ranges_within_one_id(spark):
    """Rows of one id are dealt to ranges by the hash of their text, and each still has one next row."""
    frame = spark.createDataFrame([(5, f"text {k} " * 9) for k in range(300)] + [(4, "first"), (6, "last")], "doc_id long, text string").repartition(3)
    dealt = fp.with_next(frame, range_bytes=2000).mapInPandas(lambda it: it, "doc_id long, text string, range int, copy int").collect()
    follows = [(a.text, b.text) for a, b in zip(dealt, dealt[1:], strict=False) if a.range == b.range and not a.copy]
    assert len({x.range for x in dealt}) > 5
    assert len(follows) == 302 and len({a for a, _ in follows}) == len({b for _, b in follows}) == 302
