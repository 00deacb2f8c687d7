"""Candidate settings drawn from a seed, and their screening on all windows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staveframe.functions.scalars import half_up, safe_div
from staveframe.operators import metrics as M
from staveframe.operators import tracks as T
from staveframe.operators.folds import arrow_schema

# The step of the generator, the settings that candidates start from, and what the drawn ones choose from.
STEP = 0x6D2B79F5
BASE = {"learned_weight": 0.35, "boundary_weight": 0.25, "bass_weight": 0.25, "least_learned": 0.6, "most_entropy": 0.75, "protected": 0.72, "most_guitar": 0.55}
NAMED = [
    ("current-adaptive", {}, True, "none", 0), ("fixed-current-weight", {}, False, "none", 1), ("adaptive-without-rule-protection", {"protected": 0.89}, True, "none", 1),
    ("adaptive-without-entropy-suppression", {"most_entropy": 1.0}, True, "none", 1), ("adaptive-temperature-calibrated", {}, True, "temperature", 1), ("chord-evidence-only", {"boundary_weight": 0.0, "bass_weight": 0.0}, True, "none", 1),
]
BOUNDARIES, BASSES, DRAWS, TEMPERED = (0.0, 0.1, 0.25), (0.0, 0.15, 0.25), 8, 0.25
#: Engines that are compared: id, other settings, adaptive, calibration, share of the rules, weight of the learned side where it is fixed.
ENGINES = [
    ("rule-only", {}, False, "none", 1.0, 0.0), ("learned-only", {}, False, "none", 0.0, 1.0), ("observation-hybrid", {}, True, "none", 1.0, None), ("hybrid-without-adaptive-weighting", {}, False, "none", 1.0, None),
    ("hybrid-without-rule-protection", {"protected": 0.89}, True, "none", 1.0, None), ("hybrid-without-entropy-suppression", {"most_entropy": 1.0}, True, "none", 1.0, None), ("hybrid-temperature-calibrated", {}, True, "temperature", 1.0, None),
]
ROOT_SHARE, CHANGE_SHARE = 0.25, 0.02
WORD = 1 << 32


def _times(a: Column, b: Column) -> Column:
    """The product of two 32-bit words, as a word."""
    return (a * F.pmod(b, F.lit(65536)) + F.pmod(a * F.shiftright(b, 16), F.lit(65536)) * 65536) % WORD


def draw(seed: Column, nth: Column) -> Column:
    """The ``nth`` number (from 0) of the seeded generator, at least 0 and below 1. The generator's state only counts on by a
    fixed step, so every number follows from its place alone, in any order and on any machine."""
    bits = lambda x: F.transform(F.array(x), lambda v: v)[0]
    a = bits(F.pmod(seed + (nth + 1) * STEP, F.lit(WORD)))
    mix = lambda v, shift, add: _times(v.bitwiseXOR(F.shiftright(v, shift)), v.bitwiseOR(F.lit(add).cast("long")))
    once = F.transform(F.array(a), lambda v: mix(v, 15, 1))
    twice = F.transform(once, lambda v: v.bitwiseXOR((v + mix(v, 7, 61)) % WORD))
    return F.transform(twice, lambda v: v.bitwiseXOR(F.shiftright(v, 14)) / F.lit(float(WORD)))[0]


def candidates(spark: SparkSession, seed: int, drawn: int) -> DataFrame:
    """``place, id, complexity, adaptive, calibration`` and the settings: the named candidates, and so many drawn ones."""
    kinds = "place long, id string, complexity int, adaptive boolean, calibration string, " + ", ".join(f"{k} double" for k in BASE)
    named = spark.createDataFrame([(k, name, level, adaptive, kind, *({**BASE, **other}).values()) for k, (name, other, adaptive, kind, level) in enumerate(NAMED)], kinds)
    rows = spark.range(drawn).withColumn("r", F.array(*[draw(F.lit(seed).cast("long"), F.col("id") * DRAWS + d) for d in range(DRAWS)]))
    r = lambda d: F.col("r")[d]
    weight = half_up(0.35 + r(0) * 0.5, 3)
    pick = lambda options, x: F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(x * len(options)) + 1).cast("int"))
    told = rows.select(
        (F.col("id") + len(NAMED)).alias("place"), F.concat(F.lit("random-"), F.lpad((F.col("id") + 1).cast("string"), F.greatest(F.lit(2), F.length((F.col("id") + 1).cast("string"))), F.lit("0"))).alias("id"), F.lit(2).alias("complexity"), F.lit(True).alias("adaptive"),
        F.when(r(7) < TEMPERED, "temperature").otherwise("none").alias("calibration"), weight.alias("learned_weight"), pick(BOUNDARIES, r(2)).alias("boundary_weight"), pick(BASSES, r(3)).alias("bass_weight"),
        half_up(0.35 + r(4) * 0.27, 3).alias("least_learned"), half_up(0.7 + r(5) * 0.29, 3).alias("most_entropy"), half_up(0.68 + r(6) * 0.2, 3).alias("protected"), half_up(F.greatest(weight, 0.5 + r(1) * 0.4), 3).alias("most_guitar"),
    )
    return named.unionByName(told)


#: What the labels of a window rest on.
READ = ("seconds", "wanted", "rules", "learned", "temperature", "frames", "top", "entropy", "margin", "confidence", "agrees", "flicker", "full_mix")
SUMS = "k int, seconds double, n long, d double, r double, begins long, changes long, differs double, used long"


def tempered(p: np.ndarray, inside: np.ndarray, temperature: np.ndarray) -> np.ndarray:
    """Rows of probabilities to the power of 1 / temperature, made to add up to 1; NaN where a row has no element."""
    raised = np.where(inside, np.fmax(p, 1e-12) ** (1 / temperature)[:, None], 0.0)
    whole = np.zeros(len(p))
    for x in raised.T:
        whole = whole + x
    return np.where(inside, raised, np.nan) / whole[:, None]


def _weights(w: dict[str, np.ndarray], settings: dict) -> np.ndarray:
    """The weights of windows' learned sides under one candidate's settings: the steps of :func:`metrics.gates` in their
    order. Null is NaN here, which comparisons refuse and ``fmin`` and ``fmax`` pass over, as SQL does with null."""
    clamp = lambda x: np.fmax(np.fmin(x, 1.0), 0.0)
    start, heard = settings["learned_weight"], w["frames"] > 0
    if not settings["adaptive"]:
        return np.where(heard, start, 0.0)
    least, most, protected = settings["least_learned"], settings["most_entropy"], settings["protected"]
    top, entropy, confidence = w["top"], w["entropy"], w["confidence"]
    ambiguous, unsure = 1 - clamp(w["margin"] / 0.1), 1 - clamp(confidence / protected)
    room, by_margin = 0.35 + 0.65 * (ambiguous + unsure) / 2, 0.675 + 0.325 * ambiguous
    out = np.where(heard & (top >= least) & (entropy < most), start, 0.0)
    out = np.where(out == 0, 0.0, out * (0.35 + 0.65 * clamp((top - least) / (1 - least))) * clamp((most - entropy) / most) * by_margin * (room / by_margin))
    out = out * np.where(confidence <= protected, 1.0, clamp((M.RULE_TOP - confidence) / (M.RULE_TOP - protected))) * np.where(w["agrees"], 1.1, 1.0) * w["flicker"]
    return np.fmin(np.fmax(out, 0.0), np.where(w["full_mix"], M.MOST_FULL_MIX, settings["most_guitar"]))


def _sums(windows: DataFrame, key: str, roots: list[int | None], listed: list[dict], by_key: bool) -> DataFrame:
    """:data:`SUMS` of every candidate ``k`` in parts, by key or not: ``d`` and ``r`` the seconds with the wanted label and root,
    ``begins`` and ``changes`` the windows with another label than the one before, with or without the first of a track,
    ``differs`` the seconds with another label than the first candidate's, ``used`` the windows with a weight.

    A window of Spark deals the tracks and puts them in order, then a map works out a batch of windows at once, one candidate
    after the other. It holds one batch and the labels of the row before, and hands on sums alone. NaN counts as null.
    """
    of_track = Window.partitionBy(key).orderBy("place")
    rows = windows.withColumn("_first", F.lag(F.lit(True)).over(of_track).isNull()).sortWithinPartitions(key, "place")  # sorted already
    root = np.array([np.iinfo(np.int64).min if r is None else r for r in (None, *roots)])
    schema = (f"`{key}` {windows.schema[key].dataType.simpleString()}, " if by_key else "") + SUMS
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            flag = lambda c: batch[c].fill_null(False).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            number = lambda c: batch[c].cast(pa.float64()).fill_null(float("nan")).to_numpy()  # noqa: B023, E731
            w = {c: number(c) for c in ("frames", "top", "entropy", "margin", "confidence", "flicker")} | {c: flag(c) for c in ("agrees", "full_mix")}
            (rules, _), (learned, sizes) = (T.matrix(pa.chunked_array([batch[c]])) for c in ("rules", "learned"))
            size = max(rules.shape[1], learned.shape[1], 1)
            rules, learned = (np.pad(x, ((0, 0), (0, size - x.shape[1])), constant_values=np.nan) for x in (rules, learned))
            warm = tempered(learned, np.arange(size) < sizes[:, None], number("temperature"))
            seconds, wanted, first = np.nan_to_num(number("seconds")), batch["wanted"].cast(pa.int64()).fill_null(0).to_numpy(), flag("_first")
            last = np.zeros(len(listed), dtype=np.int64) if last is None else last
            cuts = np.flatnonzero(first | (np.arange(len(first)) == 0)) if by_key else np.array([0])
            total = lambda x: np.add.reduceat(x, cuts)  # noqa: B023, E731
            base, parts = None, []
            for k, settings in enumerate(listed):
                weight = _weights(w, settings) if settings.get("fixed") is None else np.full(len(first), settings["fixed"])
                mixed = settings.get("rule_share", 1.0) * rules + weight[:, None] * (warm if settings["calibration"] == "temperature" else learned)
                none = np.isnan(mixed)
                found = np.where(none.all(axis=1), 0, np.where(none, -np.inf, mixed).argmax(axis=1) + 1)
                base = found if base is None else base
                before = np.r_[last[k], found[:-1]]
                last[k] = found[-1]
                changed, told = (found != before) & ~first, (found > 0) & (before > 0)
                right, near = (found > 0) & (found == wanted), root[found] == root[wanted]
                if by_key:
                    near &= wanted != 0
                differs = (found != base) & (found > 0) & (base > 0)
                of_k = [total(seconds), total(np.ones(len(first), np.int64)), total(seconds * right), total(seconds * near), total((first | changed | ~told).astype(np.int64)), total((changed & told).astype(np.int64)), total(seconds * differs), total((weight > 0).astype(np.int64))]
                parts.append(pa.RecordBatch.from_arrays([*([batch[key].take(pa.array(cuts))] if by_key else []), pa.array(np.full(len(cuts), k, np.int32)), *map(pa.array, of_k)], schema=target))
            yield from parts

    return rows.select(key, *READ, "_first").mapInArrow(run, schema)


def compared(windows: DataFrame, key: str, roots: list[int | None], engines=ENGINES) -> DataFrame:
    """``key, engine, seconds, detailed, root, regions, differs, learned, gain, rank`` of every key and engine over windows as
    :func:`screened` takes them. The first engine is what the others are measured by.

    ``detailed`` and ``root`` are the shares of the time with the wanted label and with its root, ``regions`` the stretches
    of equal labels, ``differs`` the seconds with another label than the first engine's, ``learned`` the share of windows in
    which the learned side has a weight, ``gain`` the share of the wanted label beyond the first engine's; ranks go by
    ``detailed``, ties by the order of the engines. A wanted label that is null is never met. An empty table gives no rows.

    The windows are read once for all engines (see :func:`_sums`), and what is shuffled after them are sums by key and engine.
    """
    listed = [{**BASE, **other, "adaptive": adaptive, "calibration": kind, "rule_share": share, "fixed": fixed} for _, other, adaptive, kind, share, fixed in engines]
    sums = _sums(windows, key, roots, listed, True).groupBy(key, "k").agg(*[F.sum(c).alias(c) for c in ("seconds", "n", "d", "r", "differs", "used")], F.sum("begins").alias("regions"))
    shares = sums.select(key, "k", "seconds", safe_div(F.col("d"), F.col("seconds")).alias("detailed"), safe_div(F.col("r"), F.col("seconds")).alias("root"), "regions", "differs", safe_div(F.col("used").cast("double"), F.col("n").cast("double")).alias("learned"))
    of_key = Window.partitionBy(key)
    gain = F.col("detailed") - F.max(F.when(F.col("k") == 0, F.col("detailed"))).over(of_key)
    name = F.element_at(F.array(*[F.lit(e[0]) for e in engines]), F.col("k") + 1)
    return shares.select(key, name.alias("engine"), "seconds", "detailed", "root", "regions", "differs", "learned", gain.alias("gain"), F.row_number().over(of_key.orderBy(F.desc("detailed"), "k")).alias("rank"))


def screened(windows: DataFrame, settings: DataFrame, key: str, roots: list[int | None]) -> DataFrame:
    """``id, detailed, root, change_rate, score`` of every candidate over all windows ``(key, place, seconds, wanted, rules, learned,
    temperature, frames, top, entropy, margin, confidence, agrees, flicker, full_mix)``; ``wanted`` is a place in the arrays, from 1.

    The windows are read once (see :func:`_sums`), and what is shuffled after them are sums by candidate. The candidates are a
    list on the driver, as many as were asked for.
    """
    listed = [row.asDict() for row in settings.orderBy("place").collect()]
    sums = _sums(windows, key, roots, listed, False).groupBy("k").agg(F.sum("seconds").alias("all"), *[F.sum(c).alias(c) for c in ("n", "d", "r", "changes")])
    share = [safe_div(F.col("d"), F.col("all")), safe_div(F.col("r"), F.col("all")), safe_div(F.col("changes").cast("double"), F.col("n").cast("double"))]
    scored = sums.select("k", share[0].alias("detailed"), share[1].alias("root"), share[2].alias("change_rate"), (share[0] + share[1] * ROOT_SHARE - share[2] * CHANGE_SHARE).alias("score"))
    names = windows.sparkSession.createDataFrame([(k, row["id"]) for k, row in enumerate(listed)], "k int, id string")
    return names.join(scored, "k").drop("k")
