"""Grouped maps: the kernels applied to every track. A track's rows meet in one task; tracks are independent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staveframe.functions import labels as L
from staveframe.operators import decoders, kernels
from staveframe.operators.folds import arrow_schema, whole_keys


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _both(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], run, schema: str) -> DataFrame:
    """``run(a, b)`` on the rows of both sides for every value of the keys on either side; a side may have no rows."""
    sides = left.select(*keys, *columns, F.lit(0).alias("side")).unionByName(right.select(*keys, *columns, F.lit(1).alias("side")))
    return sides.groupBy(*keys).applyInPandas(lambda g: run(g[g["side"] == 0], g[g["side"] == 1]), schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows as frames that never end within a group of the keys, and where the groups begin and end in each."""
    waiting: list[pa.RecordBatch] = []
    for batch in _and_none(batches):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < 10_000:
                continue
        if not waiting:
            continue
        frame = pa.Table.from_batches(waiting).to_pandas()
        codes = np.stack([pd.factorize(frame[k])[0] for k in keys])
        cuts = np.r_[0, np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1, len(frame)]
        if batch is None:
            yield frame, cuts
        elif len(cuts) > 2:
            yield frame.iloc[: cuts[-2]], cuts[:-1]
            waiting = [pa.Table.from_batches(waiting).slice(cuts[-2]).combine_chunks().to_batches()[0]]


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _paired(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], order: list[str], run, schema: str) -> DataFrame:
    """``run(frame, groups)`` on many whole groups at once, where ``groups`` gives begin, end of the left side and end of
    each: for operators with very many small groups."""
    sides = left.select(*keys, *columns, F.lit(0).alias("side")).unionByName(right.select(*keys, *columns, F.lit(1).alias("side")))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, cuts in _whole_groups(batches, keys):
            side = frame["side"].to_numpy()
            groups = [(a, a + int(np.searchsorted(side[a:b], 1)), b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield from pa.Table.from_pandas(run(frame, groups), preserve_index=False).to_batches()

    return whole_keys(sides, *keys).sortWithinPartitions(*keys, "side", *order).mapInArrow(go, schema)


def _cuts(table: pa.Table, keys: list[str]) -> list[int]:
    """Where the groups of sorted rows begin and end; nulls are equal."""
    n, apart = table.num_rows, np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for k in keys:
        column = table[k].combine_chunks()
        a, b = column.slice(1), column.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), True)
        apart |= pc.and_(differ, pc.invert(pc.and_(a.is_null(), b.is_null()))).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(apart) + 1).tolist(), n]


def whole_tables(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted rows as tables that never end within a group of the keys, and where the groups begin and end in each."""
    waiting, n = [], 0
    for batch in _and_none(batches):
        if batch is not None and batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
        if not waiting or (batch is not None and (n < 10_000 or all(waiting[-1][k][-1].as_py() == waiting[0][k][0].as_py() for k in keys))):  # one group alone so far
            continue
        table = pa.Table.from_batches(waiting)
        cuts = _cuts(table, list(keys))
        end = n if batch is None else cuts[-2]
        if end:
            yield table.slice(0, end).combine_chunks(), cuts if batch is None else cuts[:-1]
            waiting = table.slice(end).combine_chunks().to_batches()
            n -= end


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of numbers, as long as the longest, and their lengths (0 for null); NaN at their ends and for nulls."""
    sizes = column.combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full((len(sizes), int(sizes.max(initial=0))), np.nan)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = pc.list_flatten(column).cast(pa.float64()).fill_null(float("nan")).to_numpy()
    return out, sizes


def _each_track(rows: DataFrame, key: str, order: list, run, schema: str) -> DataFrame:
    """``run(columns)`` on the sorted rows of each key: lists by the name of the column, and as such its result."""
    target = arrow_schema(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_tables(batches, key):
            columns = {c: table[c].to_pylist() for c in table.column_names}
            out: dict[str, list] = {c: [] for c in target.names}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for c, values in run({c: x[a:b] for c, x in columns.items()}).items():
                    out[c] += values
            yield pa.RecordBatch.from_pydict(out, schema=target)

    return whole_keys(rows, key).sortWithinPartitions(key, *order).mapInArrow(go, schema)


def whole_tracks(rows: DataFrame, key: str, steps: list, schema: str) -> DataFrame:
    """``step(table, cuts)`` for each of the steps in turn, on tables of many whole tracks in order of ``place`` that begin and
    end at ``cuts``: one shuffle for all steps. All but the last keep the rows as they are and give columns more or other ones."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_tables(batches, key):
            for step in steps:
                table = step(table, cuts)
            yield from table.to_batches()

    return whole_keys(rows, key).sortWithinPartitions(key, "place").mapInArrow(go, schema)


def _clusters(notes: DataFrame, key: str, tolerance: float) -> tuple[DataFrame, list]:
    """Notes with the anchor of their onset cluster, and the order in which :func:`_grouped` wants them."""
    micro = 1_000_000
    from staveframe.operators.sequences import anchored_clusters

    whole = anchored_clusters(notes.select(key, "id", F.round(F.col("at") * micro).cast("long").alias("at"), F.col("at").alias("start"), "end", "midi", "score"), key, int(tolerance * micro))
    return whole, ["anchor", *(F.col(c).asc_nulls_last() for c in ("start", "midi", "id"))]


def _grouped(g: dict[str, list]) -> list[list[tuple]]:
    """A track's clusters of notes ``(start, end, midi, score, id)``; null numbers as NaN."""
    number = lambda c: [float("nan") if x is None else x for x in g[c]]
    out: list[list[tuple]] = []
    last = None
    for anchor, *note in zip(g["anchor"], number("start"), number("end"), number("midi"), number("score"), g["id"], strict=True):
        if not out or anchor != last:
            out.append([])
            last = anchor
        out[-1].append(tuple(note))
    return out


def viterbi_labels(frames: DataFrame, key: str, labels: list[str], penalty: float = 4.0) -> DataFrame:
    """``key, place, label``: the best path through ``scores array<double>`` (one for each of ``labels``) of frames ``(key, place)``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        path = kernels.viterbi(np.stack(group["scores"].to_numpy()).astype(float), penalty)
        return pd.DataFrame({key: group[key].to_numpy(), "place": group["place"].to_numpy(), "label": [labels[s] for s in path]})

    return frames.select(key, "place", "scores").groupBy(key).applyInPandas(run, f"{key} {_type(frames, key)}, place {_type(frames, 'place')}, label string")


def greedy_matches(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """``keys, left_id, right_id``: one-to-one pairs of ``(keys, id, at)`` within the tolerance, taken in order of ``at``."""

    def run(frame: pd.DataFrame, groups: list[tuple[int, int, int]]) -> pd.DataFrame:
        at, i, j = frame["at"].to_numpy(float), [], []
        for a, m, b in groups:
            for p, q in kernels.greedy_match(at[a:m], at[m:b], tolerance):
                i.append(a + p)
                j.append(m + q)
        ids = frame["id"].to_numpy(np.int64)
        return frame.iloc[i][keys].assign(left_id=ids[np.array(i, dtype=np.int64)], right_id=ids[np.array(j, dtype=np.int64)])

    schema = ", ".join(f"{k} {_type(left, k)}" for k in keys) + ", left_id long, right_id long"
    return _paired(left, right, keys, ["id", "at"], ["at", "id"], run, schema)


def boundary_scores(left: DataFrame, right: DataFrame, key: str, tolerances: list[float]) -> DataFrame:
    """``key, tolerance, precision, recall, f1`` of the marks on the right against those on the left, matched greedily."""

    def run(frame: pd.DataFrame, groups: list[tuple[int, int, int]]) -> pd.DataFrame:
        at, owner, out = frame["at"].to_numpy(float), frame[key].to_numpy(), []
        for a, m, b in groups:
            for tolerance in tolerances:
                n = len(kernels.greedy_match(at[a:m], at[m:b], tolerance))
                p, r = n / (b - m) if b > m else 0.0, n / (m - a) if m > a else 0.0
                out.append((owner[a], float(tolerance), p, r, 2 * p * r / (p + r) if p + r else 0.0))
        return pd.DataFrame(out, columns=[key, "tolerance", "precision", "recall", "f1"])

    return _paired(left, right, [key], ["at"], ["at"], run, f"{key} {_type(left, key)}, tolerance double, precision double, recall double, f1 double")


def sequence_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, place, left_place, right_place, cost``: the cheapest alignment of two sequences of chord labels ``(key,
    place, label)``, where a wrong label costs by how far it is from the right one. Labels that can't be read are told
    apart by their text, and stand as far from others as no chord does."""
    read = L.strict(F.col("label"))
    coded = lambda side: side.select(key, "place", "label", read.alias("c")).select(
        key, "place", F.coalesce("c.root", F.lit(-1)).alias("root"), F.coalesce(F.col("c.quality").isin(*L.MINOR_LIKE), F.lit(False)).cast("int").alias("minor"),
        F.coalesce(F.regexp_replace("c.symbol", "/.*", ""), F.concat(F.lit("?"), "label")).alias("symbol"),
    )

    def run(frame: pd.DataFrame, groups: list[tuple[int, int, int]]) -> pd.DataFrame:
        codes = np.stack([frame["root"].to_numpy(), frame["minor"].to_numpy(), pd.factorize(frame["symbol"])[0]], axis=1)
        owner, parts = frame[key].to_numpy(), []
        for a, m, b in groups:
            costs = decoders.label_costs(codes[a:m], codes[m:b]) if m > a and b > m else np.zeros((m - a, b - m))
            pairs = decoders.align(costs)
            cost = [decoders.GAP_COST if i is None or j is None else float(costs[i, j]) for i, j in pairs]
            parts.append(pd.DataFrame({key: owner[a], "place": np.arange(len(pairs)), "left_place": pd.array([i for i, _ in pairs], "Int64"), "right_place": pd.array([j for _, j in pairs], "Int64"), "cost": cost}))
        return pd.concat(parts)

    return _paired(coded(left), coded(right), [key], ["place", "root", "minor", "symbol"], ["place"], run, f"{key} {_type(left, key)}, place long, left_place long, right_place long, cost double")


def label_decoder(rows: DataFrame, key: str, decide) -> DataFrame:
    """``key, place, label`` where ``decide(group)`` gives the labels of a track's rows in order of ``place``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        return pd.DataFrame({key: group[key].to_numpy(), "place": group["place"].to_numpy(), "label": decide(group)})

    return rows.groupBy(key).applyInPandas(run, f"{key} {_type(rows, key)}, place {_type(rows, 'place')}, label string")


def hysteresis(rows: DataFrame, key: str, needed: int = 2) -> DataFrame:
    """Labels that change only after ``needed`` windows support the new one; rows ``(key, place, observed, decoded)``."""
    return label_decoder(rows, key, lambda g: kernels.hysteresis(g["observed"].tolist(), g["decoded"].tolist(), needed))


def confirmed(rows: DataFrame, key: str, decay: float = 0.6, lead: float = 0.15, needed: int = 2) -> DataFrame:
    """Labels decided as windows come, from ``candidates map<string,double>`` of rows ``(key, place)``."""
    return label_decoder(rows, key, lambda g: kernels.confirmed_changes([dict(x) for x in g["candidates"]], decay, lead, needed))


def settled(runs: DataFrame, key: str, least: float) -> DataFrame:
    """Runs ``(key, place, label, length)`` relabelled until none is shorter than ``least``."""
    return label_decoder(runs, key, lambda g: kernels.settle_short(g["label"].tolist(), g["length"].tolist(), least))


def absorbed(regions: DataFrame, key: str, least: float) -> DataFrame:
    """Regions ``(key, start, end, label)`` of which the short ones have joined those before them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start", kind="stable")
        out = kernels.absorb_short(list(zip(group["start"], group["end"], group["label"], strict=True)), least)
        return pd.DataFrame({key: [group[key].iloc[0]] * len(out), "start": [x[0] for x in out], "end": [x[1] for x in out], "label": [x[2] for x in out]})

    return regions.select(key, "start", "end", "label").groupBy(key).applyInPandas(run, f"{key} {_type(regions, key)}, start {_type(regions, 'start')}, end {_type(regions, 'end')}, label string")


def packed_rows(items: DataFrame, key: str, room: float) -> DataFrame:
    """``key, place, row``: the row of each item ``(key, place, width)``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        return pd.DataFrame({key: group[key].to_numpy(), "place": group["place"].to_numpy(), "row": kernels.row_packing(group["width"].astype(float).tolist(), room)})

    return items.select(key, "place", "width").groupBy(key).applyInPandas(run, f"{key} {_type(items, key)}, place {_type(items, 'place')}, row int")


def bootstrap_means(values: DataFrame, key: str, seed: int, rounds: int = 2000) -> DataFrame:
    """``key, mean, low, high, n`` of the finite values ``(key, id, value)`` of each metric, in order of ``id``. For track
    metrics: a metric's values meet in one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        xs = group.sort_values("id", kind="stable")["value"].to_numpy(float)
        xs = xs[np.isfinite(xs)]
        low, high = kernels.bootstrap_interval(xs, seed, rounds) or (None, None)
        return pd.DataFrame({key: [group[key].iloc[0]], "mean": [xs.mean() if len(xs) else None], "low": [low], "high": [high], "n": [len(xs)]})

    return values.select(key, "id", "value").groupBy(key).applyInPandas(run, f"{key} {_type(values, key)}, mean double, low double, high double, n long")


def lead_voices(notes: DataFrame, key: str, tolerance: float, least: float = 0.42, high: float = 0.78, companions: bool = True) -> DataFrame:
    """``key, id``: the notes ``(key, id, at, end, midi, score)`` of the lead voice through onset clusters, with companions
    if wanted; times in seconds."""
    whole, order = _clusters(notes, key, tolerance)

    def run(g: dict[str, list]) -> dict[str, list]:
        clusters = _grouped(g)
        chosen = decoders.lead_voice([[x[:4] for x in c] for c in clusters], least, high, companions)
        return {key: g[key][:1] * len(chosen), "id": [clusters[c][k][4] for c, k in chosen]}

    return _each_track(whole, key, order, run, f"{key} {_type(notes, key)}, id {_type(notes, 'id')}")


def _positions(midi: int, most: int) -> list[tuple[int, int]]:
    from staveframe.functions.scalars import STANDARD_TUNING

    return [(6 - k, midi - o) for k, o in enumerate(STANDARD_TUNING) if 0 <= midi - o <= most]


def fretted(notes: DataFrame, key: str, most: int = 20) -> DataFrame:
    """``key, place, string, fret`` of notes ``(key, place, at, end, midi)``, times in seconds, along the cheapest path of
    positions; notes without a position are left out."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        choices = [np.array(_positions(m, most)) for m in group["midi"].tolist()]
        held = np.array([len(c) > 0 for c in choices], dtype=bool)
        group = group[held]
        path = decoders.fret_path(group["at"].to_numpy(float), group["end"].to_numpy(float), [c for c in choices if len(c)])
        return pd.DataFrame({key: group[key].to_numpy(), "place": group["place"].to_numpy(), "string": [s for s, _ in path], "fret": [f for _, f in path]})

    return notes.select(key, "place", "at", "end", "midi").groupBy(key).applyInPandas(run, f"{key} {_type(notes, key)}, place {_type(notes, 'place')}, string long, fret long")


def chord_shapes(notes: DataFrame, key: str, tolerance: float = 0.045) -> DataFrame:
    """``key, id, string, fret`` of notes ``(key, id, at, end, midi, score)`` that sound together in onset clusters, each
    cluster one shape of the hand; notes that make a shape unplayable are left out."""
    whole, order = _clusters(notes, key, tolerance)

    def run(g: dict[str, list]) -> dict[str, list]:
        found = decoders.chord_shapes(_grouped(g), lambda midi: _positions(midi, 20))
        return {key: g[key][:1] * len(found), "id": [i for i, _, _ in found], "string": [s for _, s, _ in found], "fret": [f for _, _, f in found]}

    return _each_track(whole, key, order, run, f"{key} {_type(notes, key)}, id {_type(notes, 'id')}, string long, fret long")


def decoded_windows(windows: DataFrame, key: str, labels: list[str], roots: list[int], keep: list[str] | None = None) -> DataFrame:
    """``key, place, decoded, label``: the duration-aware best path through a track's windows, and the same with changes
    only where they are supported. ``roots`` has the root of each label, -1 for no chord;
    ``keep`` names other columns of the windows to return than the first two.

    Windows: ``key, place, start, end, scores`` (one for each label), ``strength, uncertain, confidence, margin,
    bass_confidence, root_strength, tonic, mode, key_confidence, adjustment``; a null tonic is no key.
    """
    kept = [key, "place"] if keep is None else keep
    schema = ", ".join([*(f"`{c}` {_type(windows, c)}" for c in kept), "decoded string", "label string"])
    return whole_tracks(windows, key, [decoder(labels, roots, kept)], schema)


def decoder(labels: list[str], roots: list[int], kept: list[str]):
    """The step of :func:`whole_tracks` that :func:`decoded_windows` takes."""
    of = np.array(roots)
    none = int(np.flatnonzero(of < 0)[0])

    def step(table: pa.Table, cuts: list[int]) -> pa.Table:
        number = lambda c: table[c].cast(pa.float64()).fill_null(0.0).to_numpy()
        scores = table["scores"].combine_chunks()
        if pc.any(pc.not_equal(pc.fill_null(pc.list_value_length(scores), -1), len(labels))).as_py():
            raise ValueError(f"scores need {len(labels)} elements, one for each label")
        keys = [None if t is None else (int(t), m, float(c)) for t, m, c in zip(table["tonic"].to_pylist(), table["mode"].to_pylist(), table["key_confidence"].to_pylist(), strict=True)]
        w = decoders.Windows(
            number("start"), number("end"), scores.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(labels)), number("strength"), table["uncertain"].fill_null(False).to_numpy().astype(bool), number("confidence"), number("margin"),
            np.stack([number("bass_confidence"), number("root_strength")], axis=1), keys, number("adjustment"),
        )
        path = decoders.lasting_paths(w, np.array(cuts), of)
        stable: list[int] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            one = replace(w, scores=w.scores[a:b], confidence=w.confidence[a:b], margin=w.margin[a:b])
            stable += decoders.supported_changes(one, path[a:b], none).tolist()
        out = table.select(kept)
        for name, ks in (("decoded", path.tolist()), ("label", stable)):
            out = out.append_column(name, pa.array([labels[k] for k in ks], pa.string()))
        return out

    return step


def beat_grids(frames: DataFrame, key: str, rate: float) -> DataFrame:
    """``key, bpm, phase`` from the levels ``(key, place, level)`` of each track, ``rate`` a second; null without beats."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = decoders.beat_grid(group.sort_values("place")["level"].to_numpy(float), rate)
        return pd.DataFrame({key: [group[key].iloc[0]], "bpm": [found and found[0]], "phase": [found and found[1]]}).astype({"bpm": "float64", "phase": "float64"})

    return frames.select(key, "place", "level").groupBy(key).applyInPandas(run, f"{key} {_type(frames, key)}, bpm double, phase double")


def tcn(frames: DataFrame, key: str, weights: dict) -> DataFrame:
    """``key, place, root, quality, nochord, boundary`` of a convolution network over ``x array<double>`` of frames ``(key, place)``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        out = kernels.tcn_forward(np.stack(group["x"].to_numpy()).astype(float), weights)
        return pd.DataFrame({key: group[key].to_numpy(), "place": group["place"].to_numpy(), "root": list(out["root"]), "quality": list(out["quality"]), "nochord": out["nochord"][:, 0], "boundary": out["boundary"][:, 0]})

    return frames.select(key, "place", "x").groupBy(key).applyInPandas(run, f"{key} {_type(frames, key)}, place {_type(frames, 'place')}, root array<double>, quality array<double>, nochord double, boundary double")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``place``, from 0, by ``at`` and ``id`` within a key."""
    return rows.withColumn("place", (F.row_number().over(W.partitionBy(key).orderBy("at", "id")) - 1).cast("long"))
