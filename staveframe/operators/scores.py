"""Scores, roll-ups, choices among candidates, splits and set checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staveframe.functions.scalars import cosine, hash_split, safe_div, softmax, title_key, total
from staveframe.operators.folds import whole_keys
from staveframe.operators.tracks import matrix, whole_tables


def weighted_ratios(rows: DataFrame, keys: list[str], part: Column, whole: Column) -> DataFrame:
    """``keys, part, whole, ratio``: the ratio of sums (not the mean of ratios); 0 where the whole is 0."""
    return rows.groupBy(*keys).agg(F.sum(part).alias("part"), F.sum(whole).alias("whole")).withColumn("ratio", safe_div(F.col("part"), F.col("whole")))


def quantiles(rows: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Exact quantiles by linear interpolation, as columns ``q<percent>``, and the median, 0 for a key without values."""
    each = [F.percentile(value, p).alias(f"q{round(100 * p)}") for p in points]
    return rows.groupBy(*keys).agg(*each, F.coalesce(F.median(value), F.lit(0.0)).alias("median_or_zero"))


def reliability(points: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, n, confidence, accuracy`` of points ``(confidence, right)``, all bins, empty ones with zeros; the last is closed."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    got = points.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("right").cast("double")).alias("a"))
    every = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(got), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", F.lit(0.0)).alias("confidence"), F.coalesce("a", F.lit(0.0)).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """``ece``: the mean gap of confidence and accuracy, weighted by count."""
    return bins.agg(safe_div(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("n")).alias("ece"))


def grid_argmin(rows: DataFrame, keys: list[str], grid: list[float], loss) -> DataFrame:
    """``keys, choice, loss``: of the grid's values the one with the least mean ``loss(value)``; among equals that nearest
    to 1, then the smaller."""
    values = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("choice")
    mean = rows.select("*", values).groupBy(*keys, "choice").agg(F.avg(loss(F.col("choice"))).alias("loss"))
    best = F.min(F.struct(F.floor(F.col("loss") * 1e9 + 0.5).alias("l"), F.abs(F.col("choice") - 1).alias("d"), "choice", "loss")).alias("m")
    return mean.groupBy(*keys).agg(best).select(*keys, F.col("m.choice").alias("choice"), F.col("m.loss").alias("loss"))


def skyline(candidates: DataFrame, high: list[str], low: list[str]) -> DataFrame:
    """Candidates that no other is at least as good as in everything and better in something; those with a null or NaN aim
    are left out. Each partition keeps its own best points first, so that only these are compared with each other."""
    aims = [*high, *low]
    points = candidates.select(*[F.col(a).cast("double").alias(a) for a in aims]).where(" AND ".join(f"`{a}` IS NOT NULL AND NOT isnan(`{a}`)" for a in aims)).distinct()
    signs = np.array([1.0] * len(high) + [-1.0] * len(low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, len(aims)))
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(a)) for a in aims], axis=1) * signs if batch.num_rows else kept[:0]
            kept = _undominated(np.concatenate([kept, rows]))
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kept * signs).T], aims)

    best = points.mapInArrow(run, ", ".join(f"`{a}` double" for a in aims))
    other = best.select(*[F.col(a).alias(f"o_{a}") for a in aims])
    no_worse = [F.col(f"o_{a}") >= F.col(a) for a in high] + [F.col(f"o_{a}") <= F.col(a) for a in low]
    better = [F.col(f"o_{a}") != F.col(a) for a in aims]
    front = best.join(other, reduce(and_, no_worse) & reduce(or_, better), "left_anti")
    match = reduce(and_, [F.col(f"c.{a}").cast("double") == F.col(f"f.{a}") for a in aims])
    return candidates.alias("c").join(front.alias("f"), match, "left_semi")


def _undominated(rows: np.ndarray) -> np.ndarray:
    """Rows that none exceeds or equals in every column; equal rows once."""
    rows = np.unique(rows, axis=0)[::-1]  # a row can only be dominated by one before it
    kept = rows[:0]
    for a in range(0, len(rows), 256):
        part = rows[a : a + 256]
        for others in (kept[b : b + 4096] for b in range(0, len(kept), 4096)):
            part = part[~(others[None, :, :] >= part[:, None, :]).all(axis=2).any(axis=1)]
        inside = (part[None, :, :] >= part[:, None, :]).all(axis=2)
        np.fill_diagonal(inside, False)
        kept = np.concatenate([kept, part[~inside.any(axis=1)]])
    return kept


def within_limits(rows: DataFrame, candidate: str, limits: Column) -> DataFrame:
    """Candidates of which every row fulfils ``limits`` (null counts as fulfilled)."""
    return rows.groupBy(candidate).agg(F.bool_and(F.coalesce(limits, F.lit(True))).alias("ok")).where("ok").select(candidate)


def paired_difference(left: DataFrame, right: DataFrame, key: str, band: float = 1e-9, larger_is_better: bool = True) -> DataFrame:
    """Counts of keys in both ``(key, value)`` that have improved, tied and worsened, and the mean difference."""
    d = F.col("r") - F.col("l") if larger_is_better else F.col("l") - F.col("r")
    finite = lambda c: ~F.isnan(c) & F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    both = left.select(key, F.col("value").alias("l")).join(right.select(key, F.col("value").alias("r")), key).where(finite("l") & finite("r"))
    return both.agg(F.count("*").alias("n"), F.count_if(d > band).alias("improved"), F.count_if(F.abs(d) <= band).alias("tied"), F.count_if(d < -band).alias("worsened"), F.avg(F.col("r") - F.col("l")).alias("difference"))


def key_mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that are only on one side, or of which a column differs: ``key, reason``; empty means that the two may be joined."""
    a = left.select(key, F.lit(1).alias("in_l"), *[F.col(c).alias(f"l_{c}") for c in columns])
    b = right.select(key, F.lit(1).alias("in_r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    reason = F.when(F.col("in_l").isNull(), "only right").when(F.col("in_r").isNull(), "only left").when(differs, "differs")
    return a.join(b, key, "full_outer").select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with ``side``; empty for equal multisets."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def recurring(rows: DataFrame, group: str, song: str, seconds: str, least: int = 3) -> DataFrame:
    """Roll-up of error rows: ``group, songs, occurrences, seconds, is_recurring`` (found in ``least`` songs or more)."""
    return rows.groupBy(group).agg(F.count_distinct(song).alias("songs"), F.count("*").alias("occurrences"), F.sum(seconds).alias("seconds")).withColumn("is_recurring", F.col("songs") >= least)


def zero_filled(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``key, name, n, seconds`` summed over rows ``(key, name, n, seconds)``, with zeros for every name that a key lacks."""
    every = rows.select(key).distinct().select(key, F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    got = rows.groupBy(key, "name").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"))
    return every.join(got, [key, "name"], "left").select(key, "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def class_weights(rows: DataFrame, label: str, seconds: str) -> DataFrame:
    """``label, share, weight``: share of the time, and the inverse frequency with one added to each count."""
    each = rows.groupBy(label).agg(F.sum(seconds).alias("s"), F.count("*").alias("n"))
    whole = each.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.count("*").alias("kinds"))
    return each.join(F.broadcast(whole)).select(label, safe_div(F.col("s"), F.col("all_s")).alias("share"), (F.col("all_n") / (F.col("kinds") * (F.col("n") + 1))).alias("weight"))


def share_within(errors: DataFrame, key: str, most: float) -> DataFrame:
    """``key, share`` of the errors ``(key, error)`` that are finite and at most so large, among all of them, infinite ones too."""
    ok = F.coalesce(~F.isnan("error") & (F.abs(F.col("error")) <= most), F.lit(False))
    return errors.groupBy(key).agg(F.try_divide(F.count_if(ok), F.count("*")).alias("share"))


def tempo(beats: DataFrame, key: str) -> DataFrame:
    """``key, bpm``: 60 by the median positive step of the beats ``(key, at)`` in seconds; null with fewer than two."""
    step = F.col("at") - F.lag("at").over(W.partitionBy(key).orderBy("at"))
    return beats.select(key, step.alias("s")).groupBy(key).agg(F.try_divide(F.lit(60.0), F.median(F.when(F.col("s") > 0, F.col("s")))).alias("bpm"))


def label_recall(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, recall``: the share of a key's distinct labels on the left that it has on the right too."""
    a, b = (df.groupBy(key).agg(F.collect_set("label").alias(n)) for df, n in ((left, "l"), (right, "r")))
    shared = F.size(F.array_intersect("l", F.coalesce("r", F.array().cast("array<string>"))))
    return a.join(b, key, "left").select(key, safe_div(shared.cast("double"), F.size("l").cast("double")).alias("recall"))


def common_success(rows: DataFrame, key: str, engine: str, engines: list[str]) -> DataFrame:
    """Keys that every one of the engines has a row of."""
    return rows.where(F.col(engine).isin(engines)).groupBy(key).agg(F.count_distinct(engine).alias("n")).where(F.col("n") == len(engines)).select(key)


def leakage(rows: DataFrame, title: str, split: str) -> DataFrame:
    """``title_key, tracks, splits`` of titles that stand in more than one split once signs and brackets are gone."""
    named = rows.select(title_key(F.col(title)).alias("title_key"), split).where(F.col("title_key") != "")
    return named.groupBy("title_key").agg(F.count("*").alias("tracks"), F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def text_leakage(rows: DataFrame, text: str, split: str) -> DataFrame:
    """:func:`leakage` of whole texts, as ``text_key, tracks, splits``: the key is the SHA-256 of the text without signs and
    brackets, so that no text is shuffled. Null texts, and those of signs only, are left out."""
    named = rows.select(title_key(F.col(text)).alias("t"), split).where(F.col("t") != "").select(F.sha2("t", 256).alias("text_key"), split)
    return named.groupBy("text_key").agg(F.count("*").alias("tracks"), F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)

def assigned_splits(rows: DataFrame, artist: str, given: str, seed: int) -> DataFrame:
    """``artist, split, conflict``: a split given for any of an artist's rows holds for all, test before validation before
    development; without one it goes by hash of the artist."""
    named = rows.select(F.lower(F.trim(F.regexp_replace(artist, r"\s+", " "))).alias("artist"), F.col(given).alias("given"))
    sets = named.groupBy("artist").agg(F.collect_set("given").alias("s"))
    order = F.when(F.array_contains("s", "test"), "test").when(F.array_contains("s", "validation"), "validation").when(F.array_contains("s", "development"), "development")
    return sets.select("artist", F.coalesce(order, hash_split(F.col("artist"), seed)).alias("split"), (F.size("s") > 1).alias("conflict"))


def folds_check(rows: DataFrame, performer: str, fold: str, track: str) -> DataFrame:
    """Violations of leave-one-out folds: performers held out not once, and tracks of which captures are in several folds."""
    a = rows.groupBy(F.col(performer).cast("string").alias("name")).agg(F.count_distinct(fold).alias("n")).where("n <> 1").withColumn("kind", F.lit("performer"))
    b = rows.groupBy(F.col(track).cast("string").alias("name")).agg(F.count_distinct(fold).alias("n")).where("n <> 1").withColumn("kind", F.lit("track"))
    return a.unionByName(b)


def template_ranks(rows: DataFrame, templates: DataFrame, vector: str = "vector") -> DataFrame:
    """``id, best, second, score, margin`` of rows ``(id, vector)`` against templates ``(place, name, vector)``, a small table
    (at most some hundred rows) that goes to every task as one array; the earlier template wins ties."""
    packed = templates.agg(F.array_sort(F.collect_list(F.struct("place", "name", F.col("vector").alias("t")))).alias("ts"))
    scored = rows.crossJoin(F.broadcast(packed)).select("id", F.array_sort(F.transform("ts", lambda t: F.struct((-F.floor(cosine(F.col(vector), t["t"]) * 1e9 + 0.5) / 1e9).alias("s"), t["place"].alias("place"), t["name"].alias("name")))).alias("r"))
    a, b = F.col("r")[0], F.get("r", F.lit(1))
    return scored.select("id", a["name"].alias("best"), b["name"].alias("second"), (-a["s"]).alias("score"), (b["s"] - a["s"]).alias("margin"))


def fused(rows: DataFrame, weight: Column, temperature: float = 0.12) -> DataFrame:
    """``id, label, score``: the best of the candidates of rows ``(id, rules map, learned map)`` by a weighted sum of the two
    softmax-scaled scores; the alphabetically first wins ties."""
    names = F.array_sort(F.map_keys("rules"))
    a = F.transform(names, lambda n: F.element_at("rules", n))
    b = F.transform(names, lambda n: F.coalesce(F.try_element_at("learned", n), F.lit(0.0)))
    mixed = F.zip_with(softmax(a, temperature), softmax(b, temperature), lambda x, y: (1 - weight) * x + weight * y)
    best = F.array_min(F.zip_with(names, mixed, lambda n, s: F.struct((-s).alias("s"), n.alias("n"))))
    return rows.where(F.size("rules") > 0).select("id", best.alias("m")).select("id", F.col("m.n").alias("label"), (-F.col("m.s")).alias("score"))


#: A frame is heard from this level on, and from this share of the loudest frame's.
HEARD, HEARD_SHARE = 0.004, 0.15
MEDIAN, MEAN = 0.35, 0.65


def robust_mean(frames: DataFrame, keys: list[str], vector: str = "vector", level: str = "level") -> DataFrame:
    """``keys, chroma``: 0.35 of the median and 0.65 of the level-weighted mean of each element, over frames with a level of
    0.004 and 0.15 of the loudest or more (over all, if none has), made to add up to 1. Without any level the mean is plain.

    Arrow tables of many whole groups are worked out at once; a group's frames meet in memory, as its median asks for."""
    target = ", ".join([*(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys), "chroma array<double>"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_tables(batches, *keys):
            begins = np.array(cuts[:-1])
            group = np.repeat(np.arange(len(begins)), np.diff(cuts))
            loud = table["level"].cast(pa.float64()).fill_null(float("nan")).to_numpy()
            peak = np.fmax.reduceat(loud, begins)[group]
            kept = np.flatnonzero(((loud >= np.fmax(HEARD, HEARD_SHARE * peak)) & ~np.isnan(peak)) | (peak < HEARD))
            xs, sizes = matrix(table["vector"].take(pa.array(kept)))
            kept, xs, sizes = kept[sizes > 0], xs[sizes > 0], sizes[sizes > 0]
            if len(kept):
                found = np.r_[0, np.flatnonzero(np.diff(group[kept])) + 1]
                yield from pa.table({k: table[k].take(pa.array(kept[found])) for k in keys} | {"chroma": _robust(xs, sizes, loud[kept], found)}).to_batches()

    rows = frames.select(*keys, F.col(level).alias("level"), F.col(vector).alias("vector"))
    return whole_keys(rows, *keys).sortWithinPartitions(*keys).mapInArrow(go, target)


def _robust(xs: np.ndarray, sizes: np.ndarray, loud: np.ndarray, begins: np.ndarray) -> pa.ListArray:
    """:func:`robust_mean` of the rows of numbers of groups that begin at these places; NaN is null."""
    n, group = np.diff(np.r_[begins, len(xs)]), np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(xs)]))
    out, longest = np.full((len(begins), xs.shape[1]), np.nan), np.maximum.reduceat(sizes, begins)
    for j in range(xs.shape[1]):
        x, there = xs[:, j], ~np.isnan(xs[:, j])
        many = np.add.reduceat(there.astype(np.int64), begins)
        ranked = x[np.lexsort((x, group))]  # NaN last
        low, high = ranked[begins + np.maximum(0, many - 1) // 2], ranked[begins + np.minimum(many // 2, n - 1)]
        weight = np.add.reduceat(np.where((sizes > j) & ~np.isnan(loud), loud, 0.0), begins)
        summed = np.add.reduceat(np.where(there & ~np.isnan(loud), x * loud, 0.0), begins)
        plain = np.add.reduceat(np.where(there, x, 0.0), begins) / np.maximum(1, many)
        mean = np.where(weight > 0, summed / np.where(weight > 0, weight, 1.0), plain)
        out[:, j] = np.where(many > 0, MEDIAN * (0.5 * low + 0.5 * high) + MEAN * mean, np.nan)
    whole = np.zeros(len(out))
    for j in range(out.shape[1]):
        whole += np.where(longest > j, out[:, j], 0.0)
    none = (whole == 0) | np.isnan(whole)
    shares = np.where(none[:, None], 0.0, out / np.where(none, 1.0, whole)[:, None])
    told = shares[np.arange(out.shape[1]) < longest[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(longest)], pa.int32()), pa.array(told))
