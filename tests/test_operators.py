"""Hand-worked cases of operators that have no SQL twin, and edge cases of those that have."""

import time

import pytest
from pyspark.sql import functions as F

from staveframe.functions import labels as L
from staveframe.functions import scalars as X
from staveframe.operators import fusion, intervals, notes, scores, sequences, tracks
from staveframe.streaming import live


def test_alignment_of_the_worked_example(spark):
    left = spark.createDataFrame([("s", 0.0, 1.0, "E"), ("s", 1.0, 2.0, "A"), ("s", 2.0, 3.0, "E")], "k string, start double, end double, label string")
    right = spark.createDataFrame([("s", 0.0, 1.1, "E"), ("s", 1.1, 2.0, "A"), ("s", 2.0, 3.0, "E")], "k string, start double, end double, label string")
    segments = intervals.aligned_segments(left, right, "k")
    row = intervals.agreement(segments, "k").first()
    assert abs(row.agreed / row.total - 0.9667) < 1e-3
    assert abs(sum(r.end - r.start for r in segments.collect()) - 3.0) < 1e-9
    assert intervals.agreement(intervals.aligned_segments(left.limit(0), right, "k"), "k").count() == 0


def test_anchored_clusters_of_one_long_track(spark):
    """One key with 300,000 times, in threes: a fold over all of them in one array grows with their square."""
    at = (F.col("id") - F.col("id") % 3) * 100 + F.col("id") % 3 * 40
    began = time.monotonic()
    got = sequences.anchored_clusters(spark.range(300_000).select(F.lit("a").alias("k"), "id", at.alias("at")), "k", 50)
    wrong = F.col("anchor") != F.when(F.col("id") % 3 == 2, F.col("at")).otherwise(F.col("at") - F.col("id") % 3 * 40)
    assert got.where(wrong).count() == 0 and got.count() == 300_000
    assert time.monotonic() - began < 60


def test_gap_merge_weights_in_order(spark):
    rows = spark.createDataFrame([("p", 1, 0, 10, 1.0), ("p", 2, 12, 22, 0.5), ("p", 3, 40, 50, 0.2)], "k string, id long, at long, end long, score double")
    got = {r.island: (r.start, r.end, round(r.score, 4)) for r in sequences.gap_merge(rows, "k", 5).collect()}
    assert got == {1: (0, 22, 0.75), 2: (40, 50, 0.2)}


def test_anchored_is_no_session(spark):
    rows = spark.createDataFrame([("k", i, 40 * i) for i in range(5)], "k string, id long, at long")
    assert [r.anchor for r in sequences.anchored_clusters(rows, "k", 50).orderBy("at").collect()] == [0, 0, 80, 80, 160]


@pytest.mark.parametrize(("label", "strict", "lenient", "majmin"), [("Bb:min7/F", "A#m7/F", "Bbm7", "A#:min"), ("N", "N", "N", "N"), ("X", None, "N", "X"), ("Q7", None, "N", "X"), ("C#", "C#", "C#", "C#:maj"), ("A:hdim7", "Adim", "Adim", "A:min"), ("Gm(b5)", "Gm", "Gm", "G:min")])
def test_labels(spark, label, strict, lenient, majmin):
    c = F.lit(label)
    row = spark.range(1).select(L.strict(c)["symbol"].alias("a"), L.lenient(c)["symbol"].alias("b"), L.annotated(c)["majmin"].alias("c")).first()
    assert (row.a, row.b, row.c) == (strict, lenient, majmin)


def test_scalars(spark):
    row = spark.range(1).select(X.half_up(F.lit(-0.5), 0).alias("a"), X.safe_div(F.lit(1.0), F.lit(0.0)).alias("b"), X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"), X.hash_split(F.lit("p00"), 1).alias("d"), X.title_key(F.lit("The  Song (Live) [2001]!")).alias("e"), X.byte_size(F.lit(2048)).alias("f"), X.canonical_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(None).cast("int"))).alias("g")).first()
    assert (row.a, row.b, row.c, row.e, row.f, row.g) == (0.0, 0.0, 0.0, "the song", "2.0 KB", '{"b":1}') and row.d in ("development", "validation", "test")


def test_note_cleanup(spark):
    raw = [("t", 1, 0.0, 0.3, 60, 0.9), ("t", 2, 0.32, 0.6, 60, 0.8), ("t", 3, 0.01, 0.3, 72, 0.3), ("t", 4, 1.0, 1.02, 50, 0.5), ("t", 5, 2.0, 2.5, 99, 0.9), ("t", 6, float("nan"), 2.5, 60, 0.9), ("t", 7, 3.0, 3.4, 64, 0.6)]
    got = notes.cleaned(spark.createDataFrame(raw, "track string, id long, at double, end double, midi int, score double")).orderBy("at").collect()
    assert [(r.at, r.end, r.midi) for r in got] == [(0, 600_000, 60), (3_000_000, 3_400_000, 64)]
    both = notes.combined(spark.createDataFrame(got), spark.createDataFrame(got).withColumn("score", F.lit(0.1)))
    assert both.count() == 2 and both.agg(F.min("score")).first()[0] > 0.1
    facts = notes.diagnostics(spark.createDataFrame(got), spark.createDataFrame([("t", 4.0)], "track string, seconds double"))
    assert facts.first().n == 2 and notes.arrangement(facts, 9).first().mode == "mixed" and notes.warnings(facts).count() == 0
    drop_d = spark.createDataFrame([("t", float(k), k + 1.0, m, 1.0) for k, m in enumerate([38, 38, 45, 50, 38, 45])], "track string, at double, end double, midi int, score double")
    assert notes.setup_estimate(drop_d).first().setup == "Drop D"


def test_fusion(spark):
    good = (1, [0.0, 1.0], [[1.0] + [0.0] * 11] * 2, [[1.0, 0.0, 0.0]] * 2, [0.1, 0.2])
    bad = (2, [1.0, 1.0], [[0.5] + [0.0] * 11] * 2, [[1.0, 0.0, 0.0]] * 2, [0.1])
    rows = spark.createDataFrame([good, bad], "id int, times array<double>, root array<array<double>>, quality array<array<double>>, nochord array<double>")
    assert sorted((r.id, r.problem) for r in fusion.response_problems(rows).collect()) == [(2, "lengths"), (2, "root"), (2, "times")]
    w = spark.range(1).select(fusion.gated_weight(0.35, 0.3, [("quiet", F.lit(0.5)), ("missing", F.lit(None))]).alias("w")).first().w
    assert w.weight == 0 and [s.stage for s in w.trace] == ["quiet", "missing"] and w.trace[0].after == 0.15
    rules = spark.createDataFrame([(1, "C"), (2, "G"), (3, "A")], "id int, label string")
    learned = spark.createDataFrame([(1, "Am", None), (2, "X", "timeout")], "id int, label string, error string")
    assert sorted((r.id, r.label, r.reason or "") for r in fusion.with_fallback(rules, learned, "id").collect()) == [(1, "Am", ""), (2, "G", "timeout"), (3, "A", "no response")]
    c = lambda x: L.strict(F.lit(x))
    none = F.lit(None)
    kinds = [("C", "C", None), ("Am", "C", "relative major/minor confusion"), ("C", "C7", "transient seventh detected"), ("C7", "C", "seventh omitted"), ("N", "C", "missed N"), ("C", "N", "false N"), ("C", "F#", "wrong root")]
    row = spark.range(1).select(*[fusion.mismatch_class(c(a), c(b), none.cast("int"), F.lit(1.0), none.cast("boolean"), none.cast("boolean")).alias(str(k)) for k, (a, b, _) in enumerate(kinds)]).first()
    assert list(row) == [k for *_, k in kinds]


def test_choices(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 1.0, 0.5), ("d", 2.0, 1.0)], "c string, up double, down double")
    assert {r.c for r in scores.skyline(rows, ["up"], ["down"]).collect()} == {"b", "c", "d"}
    assert scores.reliability(spark.createDataFrame([(1.0, True)], "confidence double, right boolean"), 4).orderBy("bin").collect()[3].n == 1
    tied = spark.createDataFrame([(1, 0.5)], "k int, value double")
    assert scores.paired_difference(tied, tied, "k").first().tied == 1


def test_tracks_on_empty(spark):
    empty = spark.createDataFrame([], "k string, place long, scores array<double>")
    assert tracks.viterbi_labels(empty, "k", ["a"]).count() == 0
    one = spark.createDataFrame([("k", 1, 1.0)], "k string, id long, at double")
    assert tracks.greedy_matches(one, one.limit(0), ["k"], 1.0).count() == 0


def test_stream(spark, tmp_path):
    rows = [("u", k, "AABABBB"[k], 1.0, f"2024-01-01 00:0{k}:00") for k in range(7)]
    source = f"{tmp_path}/in"
    frame = spark.createDataFrame(rows, "key string, id long, label string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    for name, made, mode in (("confirmed", live.confirmed_changes(stream, "key"), "append"), ("counted", live.windowed_counts(stream, "ts", "label", "5 minutes", "1 minute"), "complete")):
        query = made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.awaitTermination()
    assert [r.label for r in spark.table("confirmed").orderBy("id").collect()] == list("AAAAABB")
    assert sum(r.n for r in spark.table("counted").collect()) == 7


def test_local_keys_against_all_pairs(spark):
    """Frames that overlap a widened window, with starts and ends that only touch it left out, give its key by their robust
    mean: quiet frames are left out, and where all are quiet none is; without any level the mean is plain."""
    import random
    from statistics import median

    from staveframe.operators import metrics
    from staveframe.operators.fusion import MAJOR, MINOR
    from staveframe.functions.labels import SHARPS

    rng = random.Random(4)
    frames = [(k % 2, a := rng.randrange(200), a + rng.randrange(1, 12), [rng.random() ** 3 for _ in range(12)], 0.001 * (k % 3 > 0) if a > 150 else 0.0 if a > 120 else rng.random() ** 3) for k in range(80)]
    windows = [(k % 3, k, a := rng.randrange(-40, 240), a + rng.randrange(1, 9)) for k in range(60)]

    def best(heard):
        if not heard:
            return None
        loudest = max(level for _, level in heard)
        heard = [(v, level) for v, level in heard if level >= max(0.004, 0.15 * loudest)] or heard
        weight = sum(level for _, level in heard)
        mean = [0.35 * median(v[i] for v, _ in heard) + 0.65 * (sum(v[i] * w for v, w in heard) / weight if weight else sum(v[i] for v, _ in heard) / len(heard)) for i in range(12)]
        mean = [x / sum(mean) for x in mean]
        scored = sorted(((sum(m * p[(i - t) % 12] / sum(p) for i, m in enumerate(mean)), f"{SHARPS[t]} {n}") for t in range(12) for n, p in (("major", MAJOR), ("minor", MINOR))), reverse=True)
        return scored[0][1], max(0.0, min(1.0, (scored[0][0] - scored[1][0]) / 0.018))

    want = {}
    for key, k, a, b in windows:
        local, whole = best([f[3:] for f in frames if f[0] == key and f[2] > a - 8 and f[1] < b + 8]), best([f[3:] for f in frames if f[0] == key])
        use = local is not None and (whole is None or local[1] >= 0.25)
        want[k] = (*((local if use else whole) or (None, None)), use)
    got = metrics.local_keys(spark.createDataFrame(windows, "k long, id long, start long, end long"), spark.createDataFrame([(f[0], n, *f[1:]) for n, f in enumerate(frames)], "k long, id long, start long, end long, vector array<double>, level double"), "k", 8, 16).collect()
    assert len(got) == 60
    for r in got:
        name, sure, use = want[r.id]
        assert (r.name, r.is_local) == (name, use) and (sure is None or abs(r.confidence - sure) < 1e-6)
    assert sum(use for *_, use in want.values()) >= 3
