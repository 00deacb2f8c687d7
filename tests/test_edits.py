"""Edits of regions one by one."""

from staveframe.operators.edits import edited


def test_edits(spark):
    given = [(k, s, s + 2.0, name, None) for k in (1, 2) for s, name in ((0.0, "C"), (2.0, "G"), (4.0, "Am"))] + [(3, 0.0, 1.0, "F", True)]
    regions = spark.createDataFrame(given, "k int, start double, end double, label string, locked boolean").repartition(3)
    log = [
        (1, 1, 1, "split", None, 3.0, None), (1, 2, 2, "apply", "Em", None, True), (1, 3, 0, "merge-next", None, None, None), (1, 4, 0, "merge-previous", None, None, None), (1, 5, 9, "no-chord", None, None, None), (1, 6, None, "apply", "D", None, None),
        (2, 1, 0, "split", None, 0.1, None), (2, 2, 0, "split", None, 1.95, None), (2, 3, 2, "no-chord", None, None, None), (2, 4, 2, "merge-previous", None, None, None), (2, 5, 0, "apply", None, None, True), (2, 6, 1, "merge-next", None, None, None), (2, 7, -1, "split", None, 1.0, None), (2, 8, 0, "turn", "B", 1.0, True),
        (4, 1, 0, "apply", "C", None, None),
    ]
    told = edited(regions, spark.createDataFrame(log, "k int, seq int, place int, action string, label string, at double, locked boolean"), "k").orderBy("k", "place").collect()
    assert [tuple(r) for r in told] == [
        (1, 0, 0.0, 3.0, "C", True), (1, 1, 3.0, 4.0, "Em", True), (1, 2, 4.0, 6.0, "Am", False),
        (2, 0, 0.0, 2.0, "C", False), (2, 1, 2.0, 6.0, "N", True), (3, 0, 0.0, 1.0, "F", True),
    ]
    assert edited(regions.limit(0), spark.createDataFrame(log, "k int, seq int, place int, action string, label string, at double, locked boolean"), "k").count() == 0
