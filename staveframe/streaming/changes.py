"""Confirmation of label changes as windows come, in a stream and over tables.

A track has a current label. Other labels gather evidence that decays; one that has gathered enough, and has led for
long enough, becomes the label, from a boundary on that lies before the window that confirmed it. The state of a track
is a few numbers for each rival label and the windows around the places where a boundary can come to lie, so it does
not grow with the track. A window is judged once the next ``AHEAD`` have come, or the stream's watermark has passed it.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from staveframe.operators.folds import ordered_fold

# Margin, windows in a row, least confidence, seventh evidence and gathered evidence of a change;
# decays while the current label still wins and while it does not, and evidence that is forgotten.
MARGIN, NEEDED, CONFIDENCE, SEVENTH, ENOUGH = 0.01, 2, 0.16, 0.1, 0.045
HELD_DECAY, LOST_DECAY, FORGOTTEN = 0.32, 0.68, 0.002
# Weights of beat and confidence, of the lead, of a bass attack and of the decoded path; a strong beat;
# bass confidence; the same for the place of a boundary, and windows looked at for the final quality.
BEAT, BEAT_WEIGHT, SURE, LEAD, BASS, DECODED, STRONG, BASS_SURE = 0.85, 0.3, 0.65, 0.12, 0.018, 0.003, 0.86, 0.22
FIT_BASS, FIT_BEAT, FIT_AWAY, FIT_LATER, AHEAD = 0.025, 0.012, 0.006, 0.004, 4
NONE = "N"
#: Endings of the labels that add a tone to a triad.
EXTENDED = ("7", "add9")

FIELDS = "best string, second string, best_score double, margin double, confidence double, strength double, scores array<double>, sevenths array<double>, seventh double, bass_root string, bass_confidence double, passing boolean, decoded string"
COLUMNS = [f.split()[0] for f in FIELDS.split(", ")]
DECISION = "from_label string, to_label string, evidence_from long, boundary long, evidence double, supports long"


@lru_cache(maxsize=4096)
def root(label: str | None) -> str | None:
    """The root of a plain label, null for none."""
    return None if not label or label == NONE else label[:2] if label[1:2] == "#" else label[:1]


class Track:
    """One track. Windows come by ``add`` in any order; ``ready`` judges those that can be judged, in order of place."""

    def __init__(self, names: list[str], held: dict | None = None):
        self.names, self.at = names, {n: k for k, n in reversed(list(enumerate(names)))}
        self.held = held or {"first": None, "now": None, "current": None, "departure": None, "boundary": None, "rivals": {}, "windows": {}}
        self.held["windows"] = {int(k): v for k, v in self.held["windows"].items()}

    def add(self, place: int, window: dict) -> bool:
        """False for a window whose turn has gone by, or that is there already."""
        late = self.held["now"] is not None and place <= self.held["now"]
        if late or place in self.held["windows"]:
            return False
        self.held["windows"][place] = window
        return True

    def ready(self, until: int | None = None) -> Iterator[tuple[int, str, dict | None]]:
        """``place, label, decision or none`` of the windows that have all that follows, and of those up to ``until``."""
        while True:
            windows, now = self.held["windows"], self.held["now"]
            if now is not None:
                if now + 1 in windows and now + 1 + AHEAD in windows and all(p in windows for p in range(now + 2, now + 1 + AHEAD)):
                    yield (now + 1, *self._judge(now + 1))
                    continue
                if until is None:
                    return
            waiting = sorted(p for p in self.held["windows"] if self.held["now"] is None or p > self.held["now"])
            if not waiting:
                return
            place, following = waiting[0], self.held["now"] is None or waiting[0] == self.held["now"] + 1
            whole = following and len(waiting) > AHEAD and waiting[AHEAD] == place + AHEAD
            if not whole and (until is None or place > until):
                return
            yield (place, *self._judge(place))

    def _score(self, window: dict, name: str) -> float:
        at = self.at.get(name)
        value = None if at is None else window["scores"][at]
        return -1.0 if value is None else value

    @staticmethod
    def _attacked(window: dict, name: str) -> bool:
        own = root(name)
        return own is not None and root(window["bass_root"]) == own and (window["bass_confidence"] or 0) >= BASS_SURE and not window["passing"]

    def _seventh(self, window: dict, name: str) -> float:
        each = window["sevenths"]
        value = each[self.at[name]] if each is not None else None
        return value if value is not None else (window["seventh"] or 0) if window["best"] == name else 0

    def _judge(self, place: int) -> tuple[str, dict | None]:
        held, window = self.held, self.held["windows"][place]
        held["now"] = place
        if held["current"] is None:
            held["first"], held["current"] = place, window["decoded"]
            return held["current"], None
        current, rivals = held["current"], held["rivals"]
        base = self._score(window, current)
        wins = window["best"] == current or base >= window["best_score"] - MARGIN * 0.5
        held["departure"] = None if wins else place if held["departure"] is None else held["departure"]
        for name in list(rivals):
            r = rivals[name]
            r["evidence"] *= HELD_DECAY if wins else LOST_DECAY
            if name != window["best"]:
                r["row"] = 0
            if place - r["last"] > 1:
                r["supports"] = max(0, r["supports"] - 1)
            if r["evidence"] < FORGOTTEN:
                del rivals[name]
        seen = (window["best"], window["second"], window["decoded"])
        near = {root(window["best"]), root(window["second"])} - {None}
        attacked = root(window["bass_root"]) if (window["bass_confidence"] or 0) >= BASS_SURE and not window["passing"] else None
        for name in self.names:
            if name == current or not (name in seen or root(name) in near or (attacked is not None and attacked == root(name))):
                continue
            gain = self._gain(window, name, current, base)
            if gain > 0:
                r = rivals.setdefault(name, {"evidence": 0.0, "first": place, "supports": 0, "last": place, "tops": 0, "row": 0})
                r["evidence"], r["supports"], r["last"] = r["evidence"] + gain, r["supports"] + 1, place
                if name == window["best"]:
                    r["tops"], r["row"] = r["tops"] + 1, r["row"] + 1
        chosen = [n for n, r in rivals.items() if r["evidence"] >= ENOUGH and r["tops"] >= 1 and (r["row"] >= NEEDED or self._at_once(window, n, r))]
        decision = None
        if chosen:
            name = min(chosen, key=lambda n: (-rivals[n]["row"], -rivals[n]["tops"], -rivals[n]["evidence"]))  # the first of equals
            decision = self._accepted(place, name, rivals[name])
        self._forget(place)
        return held["current"], decision

    def _gain(self, window: dict, name: str, current: str, base: float) -> float:
        """What a window adds to the evidence of a name that it shows: as a label, by the root or by the bass."""
        own = root(name)
        if own is not None and own == root(current) and not (name.endswith(EXTENDED) and self._seventh(window, name) >= SEVENTH):
            return 0.0
        attacked = self._attacked(window, name)
        ahead = self._score(window, name) - base
        if ahead < -MARGIN:
            return 0.0
        fit = max(0.0, ahead - MARGIN * 0.25) * (BEAT + window["strength"] * BEAT_WEIGHT) * (SURE + window["confidence"])
        lead = max(0.0, window["margin"]) * LEAD if name == window["best"] else 0.0
        bass = BASS * (window["bass_confidence"] or 0) if attacked else 0.0
        return fit + lead + bass + (DECODED if window["decoded"] == name else 0.0)

    def _at_once(self, window: dict, name: str, rival: dict) -> bool:
        sure = window["confidence"] >= CONFIDENCE and window["strength"] >= STRONG and window["margin"] >= MARGIN * 0.75
        return rival["supports"] >= 1 and name == window["best"] and sure and self._attacked(window, name)

    def _accepted(self, place: int, name: str, rival: dict) -> dict:
        held = self.held
        since = rival["first"] if held["departure"] is None else min(held["departure"], rival["first"])
        final = name
        if root(name) is not None:
            ahead = [held["windows"][p]["decoded"] for p in range(place, place + AHEAD + 1) if p in held["windows"]]
            final = next((d for d in ahead if root(d) == root(name)), name)
        least = held["first"] if held["boundary"] is None else held["boundary"]
        spots = [p for p in (since - 1, since, since + 1) if least < p <= place]
        boundary = max(spots, key=lambda p: self._fit(p, held["current"], final, since)) if spots else max(least + 1, since)
        told = {"from_label": held["current"], "to_label": final, "evidence_from": since, "boundary": boundary, "evidence": rival["evidence"], "supports": rival["supports"]}
        held.update(current=final, boundary=boundary, departure=None, rivals={})
        return told

    def _fit(self, place: int, before: str, after: str, since: int) -> float:
        windows = self.held["windows"]

        def apart(places: range, one: str, other: str) -> float:
            gaps = [self._score(windows[p], one) - self._score(windows[p], other) for p in places if p in windows]
            return sum(gaps) / len(gaps) if gaps else 0.0

        at = windows.get(place)
        bass = FIT_BASS * (at["bass_confidence"] or 0) if at and self._attacked(at, after) else 0.0
        beat = (at["strength"] if at else 0.0) * FIT_BEAT
        away = abs(place - since) * FIT_AWAY + (FIT_LATER if place > since else 0.0)
        return apart(range(place - 2, place), before, after) + apart(range(place, place + 2), after, before) + bass + beat - away

    def _forget(self, place: int) -> None:
        """Keeps the windows that a boundary can still be judged by."""
        held = self.held
        anchors = [r["first"] for r in held["rivals"].values()] + ([held["departure"]] if held["departure"] is not None else [])
        for p in [p for p in held["windows"] if p < place - 3 and not any(a - 3 <= p <= a + 2 for a in anchors)]:
            del held["windows"][p]


def decisions(windows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``key, place, label`` of a track's first window, and a row with the decision too for each window that confirms a
    change: ``from_label, to_label, evidence_from, boundary`` (places)``, evidence, supports``.

    ``windows``: ``key, place`` (whole numbers, one by one) and :data:`FIELDS`; ``scores`` and ``sevenths`` go with
    ``names``, which has N for no chord. Null scores count as -1. Repeated places count once, the first that comes.
    """

    def begin(_):
        return {"track": Track(names), "first": True}

    def told(state, owner, until=None):
        out = []
        for place, label, decision in state["track"].ready(until):
            if decision or state["first"]:
                out.append({key: owner, "place": place, "label": label, **(decision or dict.fromkeys(d.split()[0] for d in DECISION.split(", ")))})
            state["first"] = False
        return out

    def step(state, row):
        state["owner"], state["last"] = row[key], row["place"]
        state["track"].add(row["place"], {c: row[c] for c in COLUMNS})
        return told(state, row[key])

    def finish(state):
        return told(state, state["owner"], state["last"])

    rows = windows.select(key, "place", *COLUMNS).where(F.col("place").isNotNull())
    return ordered_fold(rows, key, ["place"], begin, step, finish, f"{key} {windows.schema[key].dataType.simpleString()}, place long, label string, {DECISION}")


def confirmer(key: str, names: list[str]):
    """The step of :func:`tracks.whole_tracks` that adds ``final``, the label of :func:`confirmed`."""

    def step(table: pa.Table, cuts: list[int]) -> pa.Table:
        rows, places, out = list(zip(*[table[c].to_pylist() for c in COLUMNS], strict=True)), table["place"].to_pylist(), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            track, at, found = Track(names), [], []

            def note(until=None):
                for place, label, decision in track.ready(until):  # noqa: B023
                    if decision or not at:  # noqa: B023
                        at.append(decision["boundary"] if decision else place)  # noqa: B023
                        found.append(label)  # noqa: B023

            for k in range(a, b):
                if places[k] is not None:
                    track.add(places[k], dict(zip(COLUMNS, rows[k], strict=True)))
                    note()
            if places[b - 1] is not None:
                note(places[b - 1])
            out += [None if p is None else found[bisect_right(at, p) - 1] for p in places[a:b]]  # boundaries only grow
        return table.append_column("final", pa.array(out, pa.string()))

    return step


def confirmed(windows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``key, place, label, boundary, confirmed`` of every window: the label that the last decision with a boundary no
    later than the window gave it, and the places of that boundary and of its confirmation (null before the first change)."""
    found = decisions(windows, key, names).select(key, F.coalesce("boundary", "place").alias("at"), F.struct("label", "boundary", F.when(F.col("boundary").isNotNull(), F.col("place")).alias("confirmed")).alias("d"))
    both = windows.select(key, F.col("place").alias("at"), F.lit(None).cast(found.schema["d"].dataType).alias("d"), F.lit(1).alias("side")).unionByName(found.withColumn("side", F.lit(0)))
    last = F.last("d", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "side"))
    return both.withColumn("d", last).where("side = 1").select(key, F.col("at").alias("place"), "d.label", "d.boundary", "d.confirmed")


class _Processor(StatefulProcessor):
    def __init__(self, key: str, names: list[str], patience: int):
        self.key, self.names, self.patience = key, names, patience

    def init(self, handle):
        self.handle, self.value = handle, handle.getValueState("track", "held string")

    def _told(self, name, track, until=None):
        """Labels as they are settled; where a boundary is dated back, those given before are taken back."""
        out = []
        for place, label, decision in track.ready(until):
            if decision:
                for p in range(decision["boundary"], place):
                    out += [(name, p, decision["from_label"], -1), (name, p, label, 1)]
            out.append((name, place, label, 1))
        return pd.DataFrame(out, columns=[self.key, "place", "label", "sign"])

    def _stored(self):
        return Track(self.names, json.loads(self.value.get()[0])) if self.value.exists() else Track(self.names)

    def handleInputRows(self, key, rows, timerValues):
        track = self._stored()
        for batch in rows:
            for row in batch.to_dict("records"):
                window = {c: _plain(row[c]) for c in COLUMNS} | {"at": int(row["at"].timestamp() * 1000)}
                track.add(int(row["place"]), window)
        out = self._told(key[0], track)
        waiting = [w["at"] for p, w in track.held["windows"].items() if track.held["now"] is None or p > track.held["now"]]
        if waiting and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(max(min(waiting), timerValues.getCurrentWatermarkInMs()) + self.patience)
        self.value.update((json.dumps(track.held),))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        track, mark = self._stored(), timerValues.getCurrentWatermarkInMs()
        due = [p for p, w in track.held["windows"].items() if w["at"] <= mark]
        out = self._told(key[0], track, max(due, default=None))
        left = [w["at"] for p, w in track.held["windows"].items() if p > track.held["now"]]
        if left:
            self.handle.registerTimer(max(min(left), mark) + self.patience)
        self.value.update((json.dumps(track.held),))
        yield out

    def close(self):
        pass


def _plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    return [_plain(v) for v in value] if isinstance(value, list) else value


def confirmed_stream(windows: DataFrame, key: str, names: list[str], late: str, patience: int = 0) -> DataFrame:
    """``key, place, label, sign`` of a stream of windows with their time ``at``: labels as they are settled (sign 1), and
    for boundaries dated back the labels taken back (sign -1). What adds up to one for a place is its label: that of
    :func:`confirmed`, for tracks of which all windows came.

    Windows may come in any order within ``late``; those that come when their turn has gone by, and repeated ones, are left
    out. A window whose following ones stay away is judged ``patience`` milliseconds after the watermark has passed it,
    by those that are there. Needs the RocksDB state store; the state survives a restart from the checkpoint.
    """
    kind = windows.schema[key].dataType.simpleString()
    rows = windows.withWatermark("at", late).select(key, "place", "at", *COLUMNS).groupBy(key)
    return rows.transformWithStateInPandas(_Processor(key, names, patience), f"{key} {kind}, place long, label string, sign int", "append", "eventTime")
