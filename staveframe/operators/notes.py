"""Note cleanup: compositions of the sequence operators. Notes: ``track, id, at, end`` (seconds), ``midi, score``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staveframe.functions.scalars import clamp, fret_positions, safe_div
from staveframe.operators import sequences as S
from staveframe.operators.intervals import max_overlap

MICRO = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Bounds of the cleanup, in seconds and shares."""

    least_seconds: float = 0.08
    least_seconds_unsure: float = 0.11
    merge_gap: float = 0.08
    cluster: float = 0.04
    least_score: float = 0.42
    high_score: float = 0.78
    most_a_second: float = 9
    ghost_ratio: float = 0.52
    lead_voices: int = 2
    rhythm_voices: int = 5


# The presets.
PRESETS = {
    "clean": Settings(0.1, 0.13, 0.08, 0.045, 0.52, 0.82, 7, 0.58, 2, 4),
    "balanced": Settings(),
    "detailed": Settings(0.055, 0.08, 0.065, 0.035, 0.33, 0.74, 14, 0.45, 2, 6),
    "raw": Settings(0.03, 0.03, 0, 0.03, 0, 0.7, 1000, 0, 2, 6),
}
#: Tunings (lowest string first) and capos that are tried, the standard first.
SETUPS = [("Standard", (40, 45, 50, 55, 59, 64), 0), ("Drop D", (38, 45, 50, 55, 59, 64), 0), ("Eb standard", (39, 44, 49, 54, 58, 63), 0), *((f"Standard, capo {k}", (40, 45, 50, 55, 59, 64), k) for k in range(1, 6))]


def valid(raw: DataFrame) -> DataFrame:
    """Notes with finite times, a playable pitch and a length; starts are 0 at least, scores within 0 and 1."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    kept = raw.where(finite("at") & finite("end") & F.col("midi").between(40, 88) & (F.col("end") > F.col("at")))
    return kept.withColumns({"at": F.greatest("at", F.lit(0.0)), "score": F.coalesce(clamp(F.col("score")), F.lit(0.0))})


def in_micros(notes: DataFrame) -> DataFrame:
    """The same notes in whole microseconds, in which the window operators count."""
    whole = lambda c: F.floor(F.col(c) * MICRO + 0.5).cast("long")
    return notes.withColumns({"at": whole("at"), "end": whole("end")})


def cleaned(raw: DataFrame, s: Settings = PRESETS["balanced"]) -> DataFrame:
    """Valid notes, merged across small gaps of a pitch, without short ones (unless a coherent neighbour backs them), octave
    ghosts and crowds of unsure ones; onsets of a cluster are made equal. Times in microseconds."""
    notes = in_micros(valid(raw)).withColumn("pitch", F.concat_ws(":", "track", "midi"))
    gap = int(s.merge_gap * MICRO)
    if gap > 0:
        merged = S.gap_merge(notes.select("pitch", "id", "at", "end", "score"), "pitch", gap)
        notes = merged.select(F.split("pitch", ":")[0].alias("track"), F.split("pitch", ":")[1].cast("int").alias("midi"), F.col("start").alias("at"), "end", "score")
    else:
        notes = notes.select(F.col("track").cast("string").alias("track"), "midi", "at", "end", "score")
    notes = notes.withColumn("id", F.row_number().over(W.partitionBy("track").orderBy("at", "midi", "end")).cast("long"))
    backed = S.with_neighbour(notes.withColumn("level", F.col("midi").cast("double")), "track", int(0.22 * MICRO), 7.0, 0.9 * s.high_score).select("track", "id", F.lit(True).alias("backed"))
    length = (F.col("end") - F.col("at")) / MICRO
    needed = F.when(F.col("score") >= s.high_score, s.least_seconds).otherwise(s.least_seconds_unsure)
    notes = notes.join(backed, ["track", "id"], "left").where((length >= needed) | F.coalesce("backed", F.lit(False))).drop("backed")
    clustered = S.anchored_clusters(notes, "track", int(s.cluster * MICRO))
    alone = S.without_ghosts(clustered.withColumn("level", F.col("midi").cast("long")), ["track", "anchor"], (12, 24), s.ghost_ratio, s.high_score).drop("level")
    sure = S.density_filter(alone, "track", MICRO // 2, s.most_a_second, s.least_score, s.high_score)
    return sure.select("track", "id", F.col("anchor").alias("at"), F.greatest("end", F.col("anchor") + 20_000).alias("end"), "midi", "score")


def rhythm_voice(notes: DataFrame, chord_tones: DataFrame, most: int) -> DataFrame:
    """The best ``most`` notes of each onset by score, 0.24 for a tone of the chord that sounds (``track, id, is_tone``), and up
    to 0.2 for their length in seconds."""
    rank = F.col("score") + F.when(F.coalesce("is_tone", F.lit(False)), 0.24).otherwise(0.0) + F.least(F.lit(0.2), (F.col("end") - F.col("at")) / MICRO)
    ranked = notes.join(chord_tones, ["track", "id"], "left").withColumn("rank", F.row_number().over(W.partitionBy("track", "at").orderBy(rank.desc(), "midi")))
    return ranked.where(F.col("rank") <= most).select(*notes.columns)


def combined(lead: DataFrame, rhythm: DataFrame, most: int = 4) -> DataFrame:
    """Both voices without doubles of a start and pitch (the higher score stays), ``most`` notes at an onset."""
    both = rhythm.withColumn("voice", F.lit(0)).unionByName(lead.withColumn("voice", F.lit(1)))
    one = both.withColumn("k", F.row_number().over(W.partitionBy("track", "at", "midi").orderBy(F.desc("score"), "voice"))).where("k = 1")
    return one.withColumn("k", F.row_number().over(W.partitionBy("track", "at").orderBy(F.desc("score"), "midi"))).where(F.col("k") <= most).drop("k", "voice")


def diagnostics(notes: DataFrame, seconds: DataFrame) -> DataFrame:
    """``track, n, a_second, median_length, short, mean_score, unsure, polyphony`` of notes in microseconds, with the tracks'
    ``seconds``; tracks without notes are left out."""
    length = (F.col("end") - F.col("at")) / MICRO
    counts = notes.groupBy("track").agg(F.count("*").alias("n"), F.median(length).alias("median_length"), F.count_if(length < 0.1).alias("short"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") < 0.5).alias("unsure"))
    voices = max_overlap(notes.select("track", F.col("at").alias("start"), "end"), "track").select("track", F.col("most").alias("polyphony"))
    return counts.join(voices, "track").join(seconds, "track").withColumn("a_second", safe_div(F.col("n").cast("double"), F.col("seconds"))).drop("seconds")


def warnings(found: DataFrame) -> DataFrame:
    """``track, code`` of diagnostics that pass a bound."""
    rules = {"dense": F.col("a_second") > 10, "unsure": F.col("unsure") * 2 > F.col("n"), "short": F.col("short") * 3 > F.col("n"), "polyphony": F.col("polyphony") > 6}
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    return found.select("track", F.explode(codes).alias("code"))


def arrangement(found: DataFrame, most_a_second: float) -> DataFrame:
    """``track, mode``: lead for crowded tracks, else mixed."""
    return found.select("track", F.when((F.col("polyphony") > 6) | (F.col("a_second") > 0.8 * most_a_second), "lead").otherwise("mixed").alias("mode"))


def setup_estimate(notes: DataFrame) -> DataFrame:
    """``track, setup``: the tuning and capo on which a track's notes (seconds) lie best; another than the standard one only
    if two of its open strings are heard and its score is over 1.12 of the standard one's."""
    weight = F.greatest(F.lit(0.05), F.col("end") - F.col("at")) * F.greatest(F.lit(0.1), F.col("score"))
    aggs = []
    for k, (_, tuning, capo) in enumerate(SETUPS):
        low = F.array_min(F.transform(fret_positions(F.col("midi"), 20, tuning, capo), lambda p: p["fret"]))
        is_open = F.col("midi").isin([o + capo for o in tuning])
        value = F.when(low.isNull(), -8 * weight).otherwise(weight * (2 - 0.06 * low) + F.when(is_open, 2.4 * weight).otherwise(0.0))
        aggs += [(F.sum(value) - 0.2 * capo).alias(f"v{k}"), F.count_distinct(F.when(is_open & low.isNotNull(), F.col("midi"))).alias(f"o{k}")]
    scored = notes.groupBy("track").agg(*aggs)
    others = F.array(*[F.struct((-F.col(f"v{k}")).alias("v"), F.lit(k).alias("k"), F.lit(SETUPS[k][0]).alias("name"), F.col(f"o{k}").alias("o")) for k in range(1, len(SETUPS))])
    best = F.array_min(others)
    return scored.select("track", F.when((best["o"] >= 2) & (-best["v"] > 1.12 * F.col("v0")), best["name"]).otherwise(SETUPS[0][0]).alias("setup"))
