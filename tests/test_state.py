"""State that is carried on: the versioned store, evidence that is kept, sums that are refreshed, changes confirmed in a stream."""

import random

import pytest
from pyspark.sql import functions as F

from staveframe.operators import evidence, rollups
from staveframe.plans.roles import OBSERVED, observations
from staveframe.sources import store as stores
from staveframe.sources.store import Store
from staveframe.streaming import changes

FOLDER = "/root/testdata/sf0.001"


def held(store):
    return {r.k: r.v for r in store.current().collect()}


def test_store_versions_and_failed_writes(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), "k", 4)
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    assert store.current() is None
    store.upsert(rows(("a", 1), ("b", 1), (None, 9), ("a", 1)))
    store.upsert(rows(("b", 2), ("c", 2)))
    assert held(store) == {"a": 1, "b": 2, "c": 2}
    before = store.current()
    failing = F.udf(lambda k: 1 // 0 if k == "z" else 5, "int")
    with pytest.raises(Exception, match="ZeroDivision"):
        store.upsert(rows(("a", 3), ("z", 3)).withColumn("v", failing("k")))
    assert held(store) == {"a": 1, "b": 2, "c": 2} and before.count() == 3  # as it was, for new and for earlier readers
    other = Store(spark, str(tmp_path / "s"), "k", 4)
    real = other.commits
    answers = [real(), [*real(), (99, "elsewhere", False)]]
    monkeypatch.setattr(other, "commits", lambda: answers.pop(0))
    with pytest.raises(stores.ChangedMeanwhile):
        other.upsert(rows(("a", 7)))
    assert held(store)["a"] == 1
    bucket = spark.range(1).select(store.bucket(F.lit("c"))).first()[0]
    some = store.current([bucket])
    assert "c" in {r.k for r in some.collect()} and "PartitionFilters: [" in some._jdf.queryExecution().toString()
    monkeypatch.setattr(stores, "MERGE_AFTER", 4)
    for k in range(5):
        store.upsert(rows(("a", 10 + k), (f"n{k}", k)))
    assert held(store) == {"a": 14, "b": 2, "c": 2, **{f"n{k}": k for k in range(5)}} and len(store.commits()) < 5


def requests(spark, n, model="m1"):
    rows = [(f"track {k}", "mic" if k % 2 else "pickup", f"p0{1 + k % 2}", k, model) for k in range(n)]
    return spark.createDataFrame(rows, "track string, capture string, performer string, seed int, model string").withColumn("cache_key", evidence.request_key("track", "capture", "seed", "model"))


def test_evidence_is_worked_out_once(spark, tmp_path):
    store, asked = Store(spark, str(tmp_path / "e"), "cache_key", 4), []

    def answer(todo):
        asked.append(sorted(r.track for r in todo.collect()))
        return todo.select("cache_key", F.array(F.col("seed") * 1.5, F.length("model").cast("double")).alias("p"))

    valid = F.size("p") == 2
    run = lambda r: evidence.cached(r, store, answer, ["model"], valid)
    first = {r.track: r.p for r in run(requests(spark, 6)).collect()}
    again = {r.track: (r.p, r.status) for r in run(requests(spark, 6)).collect()}
    assert asked == [sorted(first), []] and again == {t: (p, "hit") for t, p in first.items()}
    # Another version of one capture is asked for again, the rest is not; neither are repeated requests asked twice.
    newer = requests(spark, 8, "m2").where("capture = 'mic'").unionByName(requests(spark, 6).where("capture = 'pickup'"))
    told = run(newer.unionByName(newer)).collect()
    assert asked[2] == [f"track {k}" for k in (1, 3, 5, 7)] and len(told) == 14
    assert {r.status for r in told if r.model == "m2"} == {"miss"} and {r.status for r in told if r.model == "m1"} == {"hit"}
    # An entry that is cut short, of another form or of another version under the same key is invalid and replaced.
    some = requests(spark, 3).orderBy("track").select("cache_key", "track")
    worse = some.withColumns({"p": F.when(F.col("track") == "track 0", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))), "model": F.when(F.col("track") == "track 1", "m0").otherwise("m1"), "entry": F.when(F.col("track") == "track 2", 0).otherwise(evidence.ENTRY)}).drop("track")
    store.upsert(worse)
    told = {r.track: (r.status, r.p) for r in run(requests(spark, 6)).collect()}
    assert asked[3] == ["track 0", "track 1", "track 2"] and {t: p for t, (_, p) in told.items()} == first
    assert [told[f"track {k}"][0] for k in range(6)] == ["invalid"] * 3 + ["hit"] * 3
    # A fresh answer that isn't valid is not kept.
    with pytest.raises(evidence.Unusable):
        evidence.cached(requests(spark, 9), store, lambda todo: todo.select("cache_key", F.array(F.lit(0.0)).alias("p")), ["model"], valid)
    assert run(requests(spark, 9)).where("status = 'miss'").count() == 3
    assert run(requests(spark, 0)).count() == 0


def test_evidence_of_a_split(spark, tmp_path):
    split = [("p01", "training", "f1"), ("p02", "development", "f2")]
    frame = lambda rows: spark.createDataFrame(rows, "performer string, role string, fold string")
    answer = lambda todo: todo.select("cache_key", F.col("seed").alias("p"))
    run = lambda rows, a, store: evidence.evidence(requests(spark, 6), frame(rows), store, a, ["model"], F.col("p").isNotNull(), F.sha2(F.col("p").cast("string"), 256), "p00")
    store = Store(spark, str(tmp_path / "e"), "cache_key", 4)
    told = run(split, answer, store)
    assert {(r.capture, r.track) for r in told.where("parity").collect()} == {("pickup", "track 0"), ("mic", "track 1")}
    assert {(r.capture, r.hits, r.misses, r.invalid) for r in evidence.cache_stats(told).collect()} == {("pickup", 0, 3, 0), ("mic", 0, 3, 0)}
    for bad in ([*split, ("p00", "training", "f1")], [("p01", "training", None)]):
        with pytest.raises(evidence.Unusable):
            run(bad, answer, store)
    with pytest.raises(evidence.Unusable, match="differ"):  # what is kept isn't what the model says now
        run(split, lambda todo: todo.select("cache_key", (F.col("seed") + 1).alias("p")), store)


REPORT = "report_id string, song string, genre string, metrics map<string,double>, mismatches array<struct<error_type:string,duration:double>>, confusions array<struct<pair:string,seconds:double>>"


def song_report(rng, k):
    metrics = None if rng.random() < 0.1 else {m: rng.choice([None, float("nan"), float("inf"), round(rng.random(), 4)]) for m in ("rootAccuracy", "detailedAccuracy", "meanBoundaryErrorMs") if rng.random() < 0.8}
    wrong = [(rng.choice(["late", "missing", "wrong root"]), rng.choice([None, round(rng.random(), 3)])) for _ in range(rng.randrange(4))]
    confused = None if rng.random() < 0.2 else [(rng.choice(["C>G", "A>E"]), round(rng.random(), 3)) for _ in range(rng.randrange(3))]
    return (f"r{k}", f"song {k % 7}", rng.choice(["rock", "", None, "jazz"]), metrics, wrong, confused)


def plain_report(reports):
    """The roll-up from all reports at once."""
    up = lambda x, n=4: int(x * 10**n + 0.5) / 10**n
    finite = lambda v: v is not None and abs(v) < float("inf")
    mean = lambda v: up(float(round(sum(round(x, 8) for x in v), 8)) / len(v))
    good = [r for r in reports if r[3] is not None]
    out = {("songs", "", "", len(good), None, None)} if good else set()
    for genre in {None, *(r[2] or "Unspecified" for r in good)}:
        own = [r for r in good if genre is None or (r[2] or "Unspecified") == genre]
        if genre is not None:
            out.add(("genre", genre, "", len(own), None, None))
        for m in {m for r in own for m in r[3]}:
            v = [r[3][m] for r in own if finite(r[3].get(m))]
            if v and (genre is None or m in rollups.GENRE_METRICS):
                out.add(("metric", m, "", len(v), None, mean(v)) if genre is None else ("genre", genre, m, len(v), None, mean(v)))
    for e in {e for r in good for e, _ in r[4]}:
        hits = [(r[1], d or 0) for r in good for x, d in r[4] if x == e]
        out.add(("cause", e, "", len({s for s, _ in hits}), len(hits), up(round(sum(d for _, d in hits), 6), 3)))
    for p in {p for r in good for p, _ in r[5] or []}:
        v = [s for r in good for x, s in r[5] or [] if x == p]
        out.add(("confusion", p, "", len(v), None, up(round(sum(v), 6), 3)))
    return out


def test_refresh_is_the_whole_roll_up(spark, tmp_path):
    rng, now = random.Random(5), {}
    stored, sums = Store(spark, str(tmp_path / "r"), "report_id", 4), Store(spark, str(tmp_path / "s"), "sum_key", 2)
    told = lambda: {(r.part, r.name, r.item, r.songs, r.occurrences, r.value) for r in rollups.report(sums.current()).collect()}
    for size in (9, 1, 12):
        batch = [song_report(rng, k) for k in rng.sample(range(20), size)]
        rollups.refresh(spark.createDataFrame(batch, REPORT), stored, sums)
        now |= {r[0]: r for r in batch}
        assert told() == plain_report(now.values())
    assert all(r.recurring == (r.songs >= 3) for r in rollups.report(sums.current()).where("part = 'cause'").collect())
    sums.upsert(sums.current().withColumn("reports", F.col("reports") + 1))  # sums gone astray
    rollups.rebuild(stored, sums)
    assert told() == plain_report(now.values())


def test_stream_gives_the_labels_of_the_table(spark, tmp_path):
    """Windows in several micro-batches, out of order, with a restart from the checkpoint in between; what is taken back and
    what is given add up to the labels of the whole table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    windows = observations(spark, FOLDER).withColumn("at", F.timestamp_millis((F.col("place") + 1) * 1000))
    want = {(r.user_id, r.place): r.label for r in changes.confirmed(windows, "user_id", OBSERVED).collect()}
    part = F.floor((F.col("place") + F.when(F.col("place") % 7 == 3, 2).otherwise(0)) / 14)
    windows = windows.withColumn("part", part)
    end = windows.groupBy("user_id").agg(F.max("place").alias("place")).select("user_id", "place")
    # The watermark only moves on with later windows: a last one of another track lets the ends of all tracks be judged.
    last = windows.limit(1).withColumns({"user_id": F.lit(-1), "place": F.lit(0), "at": F.timestamp_millis(F.lit(10**9))})
    files = [windows.where(F.col("part") == k).drop("part") for k in range(int(windows.agg(F.max("part")).first()[0]) + 1)]

    def run():
        rows = spark.readStream.schema(windows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = changes.confirmed_stream(rows, "user_id", OBSERVED, "20 seconds")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return len(q.recentProgress)

    try:
        for k, rows in enumerate(files):
            rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if k == len(files) // 2:
                assert run() > 0
        files[0].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # windows that come again
        last.drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    net, taken = {}, 0
    for r in spark.read.parquet(str(tmp_path / "out")).where("user_id >= 0").collect():
        net[r.user_id, r.place, r.label] = net.get((r.user_id, r.place, r.label), 0) + r.sign
        taken += r.sign < 0
    assert {k[:2]: k[2] for k, n in net.items() if n == 1} == want and set(net.values()) <= {0, 1}
    assert taken > 20 and end.count() > 10


def test_change_state_stays_small():
    """A long track without a confirmed change keeps a few windows only."""
    track = changes.Track(["C", "F", "N"])
    for k in range(3000):
        lead = k % 2
        window = {"best": "CF"[lead], "second": "FC"[lead], "best_score": 0.5, "margin": 0.001, "confidence": 0.0, "strength": 0.7, "scores": [0.5, 0.5, 0.1], "sevenths": None, "seventh": None, "bass_root": None, "bass_confidence": None, "passing": None, "decoded": "C"}
        assert track.add(k, window) and not track.add(k, window)
        assert all(label == "C" and d is None for _, label, d in track.ready())
        assert len(track.held["windows"]) < 30
    assert len(list(track.ready(2999))) == 4
