"""The driver's tables in the roles of the operators' inputs. Times are whole microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Labels that events stand for where a query needs chords: by the whole part of an event's value.
CHORDS = ("C", "Am", "F", "G7", "Dm", "Em7", "N", "Bb", "Cmaj7", "E", "A/C#", "Gm", "C7")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes: ``user_id, id, at, end, label, score``, as long as their value in seconds."""
    at = micros("ts")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), at.alias("at"), (at + F.floor(F.col("value") * 1_000_000)).alias("end"), F.col("event_type").alias("label"), F.col("value").alias("score"))


def timeline(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Even (side 0) or odd (side 1) events as a timeline of each user: ``user_id, id, start, end, label, idx``; an
    event lasts until the user's next one of its side, the last is left out."""
    rows = notes(spark, sf_dir).where(F.col("id") % 2 == side)
    w = W.partitionBy("user_id").orderBy("at", "id")
    timed = rows.select("user_id", "id", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), "label", F.col("id").alias("idx"))
    return timed.where(F.col("end") > F.col("start"))


def chord_of(value):
    """The chord that an event of this value stands for."""
    return F.element_at(F.array(*[F.lit(c) for c in CHORDS]), (F.pmod(F.floor(value), F.lit(len(CHORDS))) + 1).cast("int"))


def chord_timeline(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """:func:`timeline` with chords as labels."""
    values = notes(spark, sf_dir).select("id", chord_of(F.col("score")).alias("label"))
    return timeline(spark, sf_dir, side).drop("label").join(values, "id").select("user_id", "id", "start", "end", "label", "idx")


def track_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes of a track for each user: ``track, id, at, end`` (seconds; a day of the table is a second), ``midi, score``."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 86_400_000_000
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), at.alias("at"), (at + F.col("value") / 200).alias("end"), (F.pmod(F.floor("value"), F.lit(49)) + 40).cast("int").alias("midi"), F.pmod(F.col("value") * 7, F.lit(1.0)).alias("score"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events as points: ``user_id, point_id, at``."""
    return notes(spark, sf_dir).where("id % 2 = 1").select("user_id", F.col("id").alias("point_id"), "at")


#: Labels of :func:`observations`: four chords and none.
OBSERVED = ["C", "C7", "Am", "F", "N"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order as windows of a track, with the scores of a few labels: ``user_id, id, place, at, best,
    second, best_score, margin, confidence, strength, scores, sevenths, seventh, bass_root, bass_confidence, passing,
    decoded``. A label leads for about six windows; the rest comes from the event's number."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), place.cast("long").alias("place"))
    i, k = F.col("id"), F.col("place")
    base = F.when(i % 23 == 0, F.lit(5)).otherwise((F.col("user_id") + F.floor(k / 6)) % 4 + 1)
    score = [F.lit(0.4) + (i * (7 * j + 3)) % 101 / F.lit(1000.0) + F.when(base == j, F.lit(0.06) + i % 7 / F.lit(200.0)).otherwise(0.0) for j in range(1, 6)]
    names = F.array(*[F.lit(n) for n in OBSERVED])
    rows = rows.withColumn("scores", F.array(*score))
    top = F.array_position("scores", F.array_max("scores")).cast("int")
    rows = rows.withColumn("top", top).withColumn("others", F.transform("scores", lambda s, j: F.when(j + 1 == F.col("top"), F.lit(-9.0)).otherwise(s)))
    second = F.array_position("others", F.array_max("others")).cast("int")
    root = F.element_at(F.array(*[F.lit(n) for n in ("C", "C", "A", "F", None)]), F.col("top"))
    return rows.select(
        "user_id", "id", "place", "at", F.element_at(names, F.col("top")).alias("best"), F.element_at(names, second).alias("second"), F.array_max("scores").alias("best_score"), (F.array_max("scores") - F.array_max("others")).alias("margin"),
        (i % 10 / F.lit(10.0)).alias("confidence"), F.when(k % 4 == 0, 1.0).when(k % 2 == 0, 0.86).otherwise(0.72).alias("strength"), "scores",
        F.array(F.lit(None).cast("double"), i % 17 / F.lit(100.0), *[F.lit(None).cast("double")] * 3).alias("sevenths"), F.lit(0.0).alias("seventh"),
        F.when(i % 3 == 0, root).alias("bass_root"), (i % 50 / F.lit(100.0)).alias("bass_confidence"), (i % 11 == 0).alias("passing"), F.element_at(names, ((F.col("user_id") + F.floor((k + 1) / 6)) % 4 + 1).cast("int")).alias("decoded"),
    )


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`observations` with ``start, end`` (half a second each), ``chroma`` that comes again after some bars, and what the
    duration-aware decoder asks for."""
    rows = observations(spark, sf_dir)
    section, i = F.floor(F.col("place") / 4) % 6, F.col("id")
    chroma = F.array(*[F.lit(1.0) + section * (j + 1) % 7 + i * (j + 1) % 5 / F.lit(10.0) for j in range(12)])
    return rows.withColumns({
        "start": F.col("place") * 0.5, "end": (F.col("place") + 1) * 0.5, "chroma": chroma, "uncertain": i % 9 == 0, "root_strength": i % 19 / F.lit(100.0), "tonic": F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 12).cast("int")),
        "mode": F.when(F.col("user_id") % 2 == 0, "major").otherwise("minor"), "key_confidence": F.lit(0.8), "adjustment": F.lit(0.0),
    })


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`observations` with what a learned model says of them: ``user_id, place, seconds, wanted, rules, learned, temperature,
    frames, top, entropy, margin, confidence, agrees, flicker, full_mix``."""
    rows, i = observations(spark, sf_dir), F.col("id")
    votes = F.array(*[(i * (3 * j + 2) % 13 + 1 + F.when(F.col("decoded") == n, 8).otherwise(0)).cast("double") for j, n in enumerate(OBSERVED, 1)])
    rows = rows.withColumn("votes", votes).withColumn("learned", F.transform("votes", lambda v: v / F.aggregate("votes", F.lit(0.0), lambda a, x: a + x)))
    return rows.select(
        "user_id", "place", F.lit(0.5).alias("seconds"), ((F.col("user_id") + F.floor(F.col("place") / 6)) % 4 + 1).alias("wanted"), F.col("scores").alias("rules"), "learned", F.when(F.col("user_id") % 2 == 0, 0.9).otherwise(1.4).alias("temperature"), (i % 9).alias("frames"),
        (F.array_max("learned") * 2).alias("top"), (i % 10 / F.lit(10.0)).alias("entropy"), "margin", "confidence", (i % 2 == 0).alias("agrees"), F.when(i % 3 == 0, 1.0).when(i % 3 == 1, 0.65).otherwise(0.25).alias("flicker"), (i % 5 < 3).alias("full_mix"),
    )
