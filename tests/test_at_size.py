"""What lets queries grow no faster than their input: how often rows are shuffled, and what each row costs."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_smoothing_deals_the_windows_once(spark):
    """All passes over a track's windows run in one map; numbering the events and the clean-up of regions shuffle too."""
    told = plan(entry.queries()["smoothed_chords"](spark, SMALL))
    assert told.count("Exchange hashpartitioning") <= 3 and told.count("MapInArrow") == 2 and "Join" not in told
    assert told.count("Window ") == 1  # the numbers of the events


def test_repeats_keep_odd_rows(spark):
    """Null and uneven chroma meet nothing, null scores count as -1 where a bonus falls on them, null labels lend none."""
    from staveframe.operators import smoothing

    same = [1.0] * 12
    chroma = {0: same, 4: None, 8: same, 12: same[:11], 16: [*same[:11], None], 20: same}
    rows = [("a", k, chroma.get(k, [0.0] * 12), None if k == 8 else 0.02, None if k == 12 else "C", [None, 0.5]) for k in range(24)]
    frame = spark.createDataFrame(rows, "k string, place long, chroma array<double>, margin double, label string, scores array<double>")
    found = {r.place: r for r in smoothing.repeats(frame, "k", "label").collect()}
    assert {p: (r.prior, r.prior_label, r.bonus) for p, r in found.items() if r.bonus is not None} == {8: (0, "C", 0.015), 20: (8, "C", 0.01)}
    scores = {r.place: r.scores for r in smoothing.reinforced(frame, "k", ["C", "N"], "label").collect()}
    assert scores[20] == [-1.0 + 0.01, 0.5] and scores[19] == [None, 0.5] and len(scores) == 24


def test_robust_means_are_one_map(spark):
    """Whole groups in Arrow instead of a row and a hash table of values for each element; nulls and uneven lengths as in SQL."""
    from staveframe.operators import scores

    rows = [("a", 0.5, [1.0, 2.0]), ("a", 0.1, [3.0, None]), ("a", 0.01, [99.0, 99.0]), ("b", 0.0, [1.0]), ("b", 0.001, [3.0, 5.0]), ("b", None, [2.0, 1.0]), (None, 0.2, [4.0]), (None, 0.2, None), ("c", None, [1.0]), ("d", 1.0, [None, 1.0])]
    found = scores.robust_mean(spark.createDataFrame(rows, "k string, level double, vector array<double>"), ["k"])
    assert "MapInArrow" in plan(found) and "Generate" not in plan(found)
    a = [0.35 * 2.0 + 0.65 * (0.5 + 0.3) / 0.6, 0.35 * 2.0 + 0.65 * 1.0 / 0.6]
    b = [0.35 * 2.0 + 0.65 * 3.0, 0.35 * 3.0 + 0.65 * 5.0]
    want = {"a": [x / sum(a) for x in a], "b": [x / sum(b) for x in b], None: [1.0], "d": [0.0, 0.0]}
    got = {r.k: r.chroma for r in found.collect()}
    assert set(got) == set(want)
    assert all(abs(x - y) < 1e-12 and len(got[k]) == len(want[k]) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_mismatches_read_labels_once_a_pair(spark):
    """No label is parsed in the scan of the segments: the parsing stands above the distinct pairs."""
    from staveframe.operators import metrics

    line = lambda rows: spark.createDataFrame(rows, "k string, id long, start long, end long, label string")
    left, right = line([("a", 1, 0, 4, "C"), ("a", 2, 4, 9, "G7"), ("b", 3, 0, 2, "X?")]), line([("a", 4, 1, 6, "Am"), ("a", 5, 6, 9, "G7"), ("b", 6, 0, 2, "C/E")])
    found = metrics.mismatch_runs(left, right, "k")
    assert sorted(tuple(r) for r in found.collect()) == [("a", 0, 1, "C", "N"), ("a", 1, 4, "C", "Am"), ("a", 4, 6, "G7", "Am"), ("b", 0, 2, "N", "C")]
    lines = found._jdf.queryExecution().optimizedPlan().toString().lower().splitlines()
    at = [k for k, line in enumerate(lines) if "aggregate [_r#" in line]
    reads = lambda part: any("regexp" in x or "rlike" in x for x in part)
    assert len(at) == 1 and reads(lines[: at[0]]) and not reads(lines[at[0] :])


def test_rollup_reads_its_sums_once(spark, tmp_path):
    """What reports add comes from plain explodes without casts to decimals for each row, and the report is one pass over the sums."""
    from staveframe.operators import rollups
    from staveframe.sources.store import Store

    kind = "report_id string, song string, genre string, metrics map<string,double>, mismatches array<struct<error_type:string,duration:double>>, confusions array<struct<pair:string,seconds:double>>"
    rows = [("r1", "s1", "x", {"rootAccuracy": 0.5, "z": None}, [("late", 1.5), ("late", None), (None, 2.0), None], None), (None, "s2", None, {"rootAccuracy": 9.0}, [("late", 1.0)], []), ("r3", None, None, {}, None, [("C>G", 0.25), (None, 1.0), None])]
    reports = spark.createDataFrame(rows, kind)
    told = plan(rollups.contributions(reports)).lower()
    assert "lambda" not in told and "decimal" not in told
    stored, sums = Store(spark, str(tmp_path / "r"), "report_id", 4), Store(spark, str(tmp_path / "s"), "sum_key", 2)
    for _ in range(2):  # the second time the same reports are replaced
        rollups.refresh(reports, stored, sums)
        found = rollups.report(sums.current())
        want = {("metric", "rootAccuracy", "", 1, None, 0.5), ("songs", "", "", 2, None, None), ("genre", "x", "rootAccuracy", 1, None, 0.5), ("genre", "x", "", 1, None, None), ("genre", "Unspecified", "", 1, None, None), ("cause", "late", "", 1, 2, 1.5), ("confusion", "C>G", "", 1, None, 0.25)}
        assert {(r.part, r.name, r.item, r.songs, r.occurrences, r.value) for r in found.collect()} == want
    assert plan(rollups.report(sums.current())).count("FileScan parquet") == len(sums.commits()) == 2


def test_decimal_sums_are_those_of_casts(spark):
    from pyspark.sql import functions as F

    from staveframe.functions.scalars import decimal_sum

    odd = [0.0, -0.0, 0.1, 0.07, 1e-9, 4.9e-9, 5e-9, 5.1e-9, -5e-9, 1.000000005, -1.000000005, 2.675, 10995.11627776, 10995.11627775, 12345.678901235, -12345.678901235, 1e15 + 0.1, 3e19, 50.0, -7.123456789, None]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(odd)] + [(99, None)], "k long, x double").union(spark.range(2000).select(F.lit(100).cast("long"), F.rand(3) * F.pow(F.lit(10.0), F.col("id") % 9 - 3) * F.when(F.col("id") % 2 == 0, -1).otherwise(1)))
    cast = F.coalesce(F.sum(F.col("x").cast("decimal(28,8)")), F.lit(0)).cast("decimal(28,8)")
    assert frame.groupBy("k").agg(decimal_sum(F.col("x")).alias("a"), cast.alias("b")).where("a <> b OR a IS NULL").collect() == []
    many = spark.range(1 << 20).select(F.lit(10995.0).alias("x"))
    assert str(many.agg(decimal_sum(F.col("x"))).first()[0]) == "11529093120.00000000"


def test_candidates_are_screened_in_arrays(spark):
    """No lambda runs for a candidate, only sums leave the map, and labels go on from batch to batch; nulls as in SQL."""
    from pyspark.sql import functions as F

    from staveframe.operators import calibration as C
    from staveframe.plans.roles import judged

    roots, windows = [0, 0, 9, 5, None], judged(spark, SMALL)
    told = plan(C.screened(windows, C.candidates(spark, 7, 20), "user_id", roots))
    assert told.count("MapInArrow") == 1 and "Generate" not in told and told.count("Sort [user_id") == 2  # of the numbers and of the order of places
    one = windows.agg(F.min("user_id")).first()[0]
    odd = windows.where((F.col("user_id") == one) & (F.col("place") < 5)).withColumns({"user_id": F.lit(None).cast("long"), "rules": F.when(F.col("place") % 2 == 0, F.array(F.lit(None).cast("double"), F.lit(0.4)))})
    nulls = {c: F.lit(None).cast(windows.schema[c].dataType) for c in ("wanted", "margin", "flicker", "agrees", "full_mix", "confidence")}
    windows = windows.unionByName(odd).unionByName(windows.where((F.col("user_id") == one) & (F.col("place") < 3)).withColumns({"user_id": F.lit(-5), **nulls}))
    want = None
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = C.screened(windows, C.candidates(spark, 7, 20), "user_id", roots)
            got = {(r.id, round(r.detailed, 9), round(r.root, 9), round(r.change_rate, 9)) for r in found.collect()}
            engines = {(r.user_id, r.engine, r.seconds, r.detailed, r.root, r.regions, r.differs, r.learned) for r in C.compared(windows, "user_id", roots).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = want or (got, engines)
        assert (got, engines) == want and len(got) == 26
    of_null = {e: (seconds, regions) for user, e, seconds, _, _, regions, _, _ in want[1] if user is None}
    assert set(of_null.values()) == {(2.5, 5)}  # every other window has no label
