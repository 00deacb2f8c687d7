"""Learned evidence beside rules: checks of its form, key estimation, mismatch classes, gates, fallbacks and decisions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staveframe.functions.labels import SHARPS
from staveframe.functions.scalars import clamp, entropy, rolled, total
from staveframe.operators.tracks import matrix

# Limits of the contract, and profiles of the two modes from the tonic on.
MOST_FRAMES, MOST_SECONDS, BINS, SUM_ERROR = 200_000, 1_800, 12, 0.001
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
EXTENSIONS = ("7", "maj7", "min7", "add9", "6", "min6")


def _finite(xs: Column) -> Column:
    return F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _rising(xs: Column) -> Column:
    return F.forall(F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.size(xs)), lambda a, b: b > a), lambda ok: F.coalesce(ok, F.lit(True)))


def response_problems(responses: DataFrame) -> DataFrame:
    """``id, problem`` of responses ``(id, times, root, quality, nochord)`` that break the contract: lengths, finite and rising
    times, rows of twelve and three shares that add up to 1, probabilities within 0 and 1."""
    shares = lambda c, k: F.forall(c, lambda r: (F.size(r) == k) & _finite(r) & (F.abs(total(r) - 1) <= SUM_ERROR))
    n = F.size("times")
    checks = {
        "frames": (n > 0) & (n <= MOST_FRAMES), "times": _finite(F.col("times")) & _rising(F.col("times")), "seconds": F.array_max("times") - F.array_min("times") <= MOST_SECONDS,
        "lengths": (F.size("root") == n) & (F.size("quality") == n) & (F.size("nochord") == n), "root": shares("root", BINS), "quality": shares("quality", 3), "nochord": F.forall("nochord", lambda p: (p >= 0) & (p <= 1)),
    }
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return responses.select("id", F.explode(found).alias("problem"))


MODES = ("major", "minor")
#: The profiles of the 24 keys, each mode of a tonic in turn, from C on.
PROFILES = np.array([[values[(p - tonic) % 12] / sum(values) for p in range(12)] for tonic in range(12) for values in (MAJOR, MINOR)])


def key_estimate(chroma: Column) -> Column:
    """``struct(name, confidence)`` of the likeliest of the 24 keys of a chroma array, the first of equals from
    C major and C minor on; null without energy."""

    @F.arrow_udf("name string, confidence double")
    def estimated(column: pa.Array) -> pa.Array:
        xs, sizes = matrix(pa.chunked_array([column]))
        whole = np.where(np.arange(xs.shape[1]) < sizes[:, None], xs, 0.0).sum(axis=1)
        scores = np.zeros((len(xs), len(PROFILES)))
        for p in range(min(12, xs.shape[1])):
            scores += np.where(p < sizes, xs[:, p], 0.0)[:, None] * PROFILES[:, p]
        found, place = ~np.isnan(scores).any(axis=1) & (whole > 0), np.arange(len(xs))
        scores[~found] = 0.0
        first = np.argmax(scores, axis=1)
        top = scores[place, first]
        scores[place, first] = -np.inf
        with np.errstate(invalid="ignore"):
            lead = np.clip((top - scores.max(axis=1)) / 0.018, 0.0, 1.0)  # NaN between infinite ones
        return pa.StructArray.from_arrays([pa.array([f"{SHARPS[k // 2]} {MODES[k % 2]}" for k in first], pa.string()), pa.array(lead, mask=np.isnan(lead))], ["name", "confidence"], mask=pa.array(~found))

    return estimated(chroma)


def pitch_turned(chroma: Column, semitones: int) -> Column:
    """A chroma array as if the sound were so many semitones higher."""
    return rolled(chroma, semitones)


def mismatch_class(reference: Column, detected: Column, bass_root: Column, margin: Column, near_boundary: Column, bass_support: Column) -> Column:
    """Name of the first kind of error that fits two strict labels (structs of root and quality); null where they agree."""
    r, d = reference, detected
    distance = F.pmod(d["root"] - r["root"], F.lit(12))
    minor = lambda x: x["quality"].isin("min", "min7", "min6", "dim")
    more = lambda x: F.coalesce(x["quality"].isin(*EXTENSIONS), F.lit(False))
    relative = (minor(r) & ~minor(d) & (distance == 3)) | (~minor(r) & minor(d) & (distance == 9))
    heard = F.coalesce(bass_root == r["root"], F.lit(False))
    return (
        F.when(r["symbol"].eqNullSafe(d["symbol"]), F.lit(None).cast("string")).when(r["root"].isNull(), "missed N").when(d["root"].isNull() & heard, "bass root ignored").when(d["root"].isNull(), "false N")
        .when(F.coalesce(near_boundary, F.lit(False)), "boundary snapped to wrong beat").when((r["root"] == d["root"]) & ~more(r) & more(d), "transient seventh detected").when((r["root"] == d["root"]) & more(r) & ~more(d), "seventh omitted")
        .when((r["root"] == d["root"]) & (F.coalesce(margin, F.lit(1.0)) < 0.12), "weak third caused major/minor ambiguity").when(r["root"] == d["root"], "wrong chord quality").when(relative, "relative major/minor confusion")
        .when(heard, "bass root ignored").when(F.coalesce(bass_support, F.lit(False)), "lead melody contaminated harmony").otherwise("wrong root")
    )


def gated_weight(base: float, most: float, stages: list[tuple[str, Column]]) -> Column:
    """``struct(weight, trace)``: a weight that passes through named factors in turn, with each stage's value before and after."""
    start = F.struct(F.lit(min(base, most)).alias("weight"), F.array().cast("array<struct<stage:string,before:double,after:double>>").alias("trace"))
    factors = F.array(*[F.struct(F.lit(name).alias("stage"), F.coalesce(factor.cast("double"), F.lit(0.0)).alias("f")) for name, factor in stages])
    step = lambda s, x: F.struct((s["weight"] * clamp(x["f"])).alias("weight"), F.array_append(s["trace"], F.struct(x["stage"].alias("stage"), s["weight"].alias("before"), (s["weight"] * clamp(x["f"])).alias("after"))).alias("trace"))
    return F.aggregate(factors, start, step)


def evidence_factor(shares: Column, least: float = 0.6, most_entropy: float = 0.75) -> Column:
    """1 for evidence that is sure enough, less for less: by its largest share and its entropy."""
    return F.when((F.array_max(shares) >= least) & (entropy(shares) <= most_entropy), 1.0).otherwise(clamp(F.array_max(shares) / least) * clamp((1 - entropy(shares)) / (1 - most_entropy)))


def with_fallback(rules: DataFrame, learned: DataFrame, key: str) -> DataFrame:
    """``key, label, engine, reason``: the learned label where it has come without error, else the rule's exactly."""
    joined = rules.select(key, F.col("label").alias("rule")).join(learned.select(key, F.col("label").alias("new"), "error"), key, "left")
    good = F.col("new").isNotNull() & F.col("error").isNull()
    return joined.select(key, F.when(good, F.col("new")).otherwise(F.col("rule")).alias("label"), F.when(good, "hybrid").otherwise("rules").alias("engine"), F.when(~good, F.coalesce("error", F.lit("no response"))).alias("reason"))


def recommendation(paired: DataFrame, fragmentation_slack: float = 0.02) -> DataFrame:
    """One word for each row ``(low, high, fragmentation_change, full_band)`` of paired results: promote, keep or hold back."""
    worse = (F.col("high") < 0) | (F.col("fragmentation_change") > fragmentation_slack)
    return paired.withColumn("advice", F.when(worse, "hold back").when((F.col("low") > 0) & (F.col("full_band") > 0), "promote").otherwise("keep"))
