"""Edits of a track's regions, replayed from a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveframe.operators.folds import ordered_fold

# Fixed value: a part that a split leaves is longer than this, in the unit of the times.
LEAST_PART = 0.1


def edited(regions: DataFrame, log: DataFrame, key: str, least: float = LEAST_PART) -> DataFrame:
    """``key, place, start, end, label, locked`` of the regions ``(key, start, end, label, locked)`` after the edits ``(key, seq, place, action,
    label, at, locked)`` in the order of ``seq``; ``place`` counts from 0 in the list as it is when its turn comes.

    ``apply`` gives a region its label and lock; ``no-chord`` gives N, locked; ``split`` cuts at ``at`` and locks both parts, unless
    either would be ``least`` long or less; ``merge-previous`` and ``merge-next`` take in a neighbour, its lock too. An edit of
    a place that isn't there, of a neighbour that isn't, an ``apply`` without a label and an unknown action change nothing.
    Edits of one ``seq`` go by place, action, label and at. A task holds one track's regions; its log is streamed.
    """
    cast = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    start = regions.select(key, F.lit(0).alias("side"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "label", cast("locked"))
    changes = log.select(key, F.lit(1).alias("side"), F.col("seq").cast("long").alias("seq"), F.col("place").cast("long").alias("place"), "action", "label", F.col("at").cast("double").alias("at"), cast("locked"))
    both = start.unionByName(changes, allowMissingColumns=True)

    def step(held: list, row: dict) -> list:
        if row["side"] == 0:
            held.append([row["start"], row["end"], row["label"], row["locked"]])
            return []
        k, action = row["place"], row["action"]
        if k is None or not 0 <= k < len(held):
            return []
        one = held[k]
        if action == "no-chord" or action == "apply" and row["label"]:
            one[2], one[3] = ("N", True) if action == "no-chord" else (row["label"], row["locked"])
        elif action == "split" and row["at"] is not None and one[0] + least < row["at"] < one[1] - least:
            held[k : k + 1] = [[one[0], row["at"], one[2], True], [row["at"], one[1], one[2], True]]
        elif action == "merge-previous" and k > 0:
            held[k - 1 : k + 1] = [[held[k - 1][0], one[1], one[2], one[3] or held[k - 1][3]]]
        elif action == "merge-next" and k + 1 < len(held):
            held[k : k + 2] = [[one[0], held[k + 1][1], one[2], one[3] or held[k + 1][3]]]
        return []

    def begin(owner):
        return {"owner": owner, "held": []}

    def finish(state):
        return [{key: state["owner"], "place": k, "start": a, "end": b, "label": label, "locked": locked} for k, (a, b, label, locked) in enumerate(state["held"])]

    kind = regions.schema[key].dataType.simpleString()
    return ordered_fold(both, key, ["side", "start", "end", "seq", "place", "action", "label", "at"], begin, lambda state, row: step(state["held"], row), finish, f"{key} {kind}, place long, start double, end double, label string, locked boolean")
