"""Decoding in two passes: repeated sections of a track lend their labels of the first pass to the second."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveframe.operators import regions
from staveframe.operators import tracks as T
from staveframe.streaming import changes

# Lags are these many windows apart, up to sixteen bars; similarity of a repetition; weight and bound of
# what it adds, and the share of the margin that bounds it too.
BAR, BARS, ALIKE, WEIGHT, MOST, MARGIN_SHARE = 4, 16, 0.9, 0.035, 0.015, 0.5

#: Columns of the windows that some pass reads, besides the key.
USED = ("place", "start", "end", "scores", "strength", "uncertain", "confidence", "margin", "bass_confidence", "root_strength", "tonic", "mode", "key_confidence", "adjustment", "chroma", *(c for c in changes.COLUMNS if c != "decoded"))
USED = tuple(dict.fromkeys(USED))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices, added up from the first column on."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def repeater(label: str, bounded: bool):
    """The step of :func:`tracks.whole_tracks` that :func:`repeats` takes: each lag is one pass over all tracks of a table."""
    above = lambda a, b: (a > b) | (np.isnan(a) & ~np.isnan(b))  # noqa: E731  # as Spark has it, NaN is above all numbers

    def step(table: pa.Table, cuts: list[int]) -> pa.Table:
        chroma, sizes = T.matrix(table["chroma"])
        inside = np.arange(chroma.shape[1]) < sizes[:, None]
        whole = ~(np.isnan(chroma) & inside).any(axis=1)  # NaN is no chroma, like null
        chroma = np.where(inside, chroma, 0.0)
        norm = _dot(chroma, chroma)
        sounds = whole & above(norm, np.zeros(len(norm)))
        place = np.arange(len(norm)) - np.repeat(cuts[:-1], np.diff(cuts))
        best, lag = np.zeros(len(norm)), np.zeros(len(norm), dtype=np.int64)
        for back in range(BAR, BAR * BARS + 1, BAR):
            i = np.flatnonzero((place >= back) & sounds)
            i = i[sounds[i - back] & (sizes[i] == sizes[i - back])]
            alike = _dot(chroma[i], chroma[i - back]) / np.sqrt(norm[i] * norm[i - back])
            more = above(alike, best[i])
            best[i[more]], lag[i[more]] = alike[more], back
        bonus = WEIGHT * best
        if bounded:
            margin = table["margin"].cast(pa.float64()).fill_null(float("nan")).to_numpy()
            bonus = np.fmin(bonus, np.fmax(0.0, np.fmin(MOST, margin * MARGIN_SHARE)))
        named = table[label].take(pa.array(np.arange(len(lag)) - lag))
        chord = pc.fill_null(pc.not_equal(named, changes.NONE), False).to_numpy()
        use = ~(best < ALIKE) & chord & above(bonus, np.zeros(len(bonus)))
        prior = pc.subtract(table["place"].cast(pa.int64()), pa.array(lag))
        for name, x in (("prior", prior), ("prior_label", named), ("bonus", pa.array(bonus))):
            table = table.append_column(name, pc.if_else(pa.array(use), x, pa.scalar(None, x.type)))
        return table

    return step


def reinforcer(names: list[str]):
    """The step of :func:`tracks.whole_tracks` that adds the bonus of :func:`repeater` to the ``scores``."""

    def step(table: pa.Table, cuts: list[int]) -> pa.Table:
        kind = table.schema.field("scores").type
        scores = table["scores"].combine_chunks()
        sizes = scores.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        values = scores.flatten().cast(pa.float64())
        number, null = values.fill_null(-1.0).to_numpy().copy(), values.is_null().to_numpy(zero_copy_only=False).copy()
        at = pc.index_in(table["prior_label"], pa.array(names, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        rows = np.flatnonzero((at >= 0) & (at < sizes))
        rows = rows[table["prior_label"].is_valid().to_numpy()[rows]]
        spots = (ends - sizes + at)[rows]
        number[spots] += table["bonus"].fill_null(0.0).to_numpy()[rows]
        null[spots] = False
        given = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(number, mask=null), mask=scores.is_null())
        return table.set_column(table.schema.get_field_index("scores"), "scores", given.cast(kind)).drop_columns(["prior", "prior_label", "bonus"])

    return step


def _schema(windows: DataFrame, columns: list[str], *more: str) -> str:
    return ", ".join([*(f"`{c}` {windows.schema[c].dataType.simpleString()}" for c in columns), *more])


def repeats(windows: DataFrame, key: str, label: str, bounded: bool = True) -> DataFrame:
    """Windows ``(key, place, chroma, margin, …)`` with ``prior, prior_label, bonus``: of the windows a whole number of bars
    before, up to sixteen, the most similar one (the nearest of equals), if it is similar enough and has a chord.

    The lags are offsets in the track, so each row meets sixteen others and no pairs are formed. Places must
    be whole and without gaps. ``bounded`` limits the bonus by half the margin and a most; the rest has a bonus of null.
    """
    return T.whole_tracks(windows, key, [repeater(label, bounded)], _schema(windows, windows.columns, "prior long", "prior_label string", "bonus double"))


def reinforced(windows: DataFrame, key: str, names: list[str], label: str, bounded: bool = True) -> DataFrame:
    """The windows with the bonus of :func:`repeats` in their ``scores``; a score that is null counts as -1 before."""
    return T.whole_tracks(windows, key, [repeater(label, bounded), reinforcer(names)], _schema(windows, windows.columns))


def smoothed(windows: DataFrame, key: str, names: list[str], roots: list[int], reduced: bool = True) -> DataFrame:
    """Regions of a track's windows (see :func:`tracks.decoded_windows`, :data:`changes.FIELDS` and ``chroma``): decoded,
    reinforced and decoded again; labels by confirmed changes, or without ``reduced`` by supported ones; cleaned up."""
    # All passes over a track run while it is at hand: each of their own would shuffle the wide rows once more.
    given = windows.select(key, *[c for c in USED if c in windows.columns])
    kept = [c for c in given.columns if c not in ("label", "stable", "final")]
    last = [c for c in kept if c != "chroma"]
    steps = [T.decoder(names, roots, kept), repeater("decoded", reduced), reinforcer(names), lambda t, _: t.drop_columns(["decoded", "label"]), T.decoder(names, roots, last)]
    if reduced:  # windows without a key or a place are of no track
        given = given.where(F.col(key).isNotNull() & F.col("place").isNotNull())
        steps.append(changes.confirmer(key, names))
    else:
        steps.append(lambda t, _: t.append_column("final", t["label"]))
    found = T.whole_tracks(given, key, [*steps, regions.labeller(key, names, "final")], regions.labelled_schema(given, key))
    return regions.cleaned(found, key, names, reduced)
