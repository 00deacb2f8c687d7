"""Interval joins and alignment of timelines.

An interval has a start and an end (half-open); a timeline is a set of intervals of a key that don't overlap. Joins
carry a bucket of time beside the key, so that one key with very many intervals is spread over tasks; where two
timelines are merged, one window over the union of their end points takes the place of range joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, width: int, closed_last: bool = False) -> DataFrame:
    """``points(key, point_id, at)`` with ``label`` of the first of ``intervals(key, start, end, idx, label)`` that holds
    ``at``: start <= at < end, and for the last interval of a key also at = end if ``closed_last``. No match: null."""
    if closed_last:
        ends = intervals.groupBy(key).agg(F.max("end").alias("last"))
        intervals = intervals.join(ends, key).withColumn("shut", F.col("end") == F.col("last")).drop("last")
    else:
        intervals = intervals.withColumn("shut", F.lit(False))
    spread = intervals.select(key, "start", "end", "idx", "label", "shut", buckets(F.col("start"), F.col("end"), width).alias("bucket"))
    found = points.withColumn("bucket", F.floor(F.col("at") / width)).join(spread, [key, "bucket"], "left")
    holds = (F.col("start") <= F.col("at")) & ((F.col("at") < F.col("end")) | (F.col("shut") & (F.col("at") == F.col("end"))))
    first = F.min(F.when(holds, F.struct("idx", "label")))
    return found.groupBy(key, "point_id", "at").agg(first.alias("hit")).select(key, "point_id", "at", F.col("hit.label").alias("label"))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs ``key, left_id, right_id, seconds`` of intervals ``(key, id, start, end)`` that overlap, each pair once."""
    a = left.select(key, F.col("id").alias("left_id"), F.col("start").alias("ls"), F.col("end").alias("le"), buckets(F.col("start"), F.col("end"), width).alias("bucket"))
    b = right.select(key, F.col("id").alias("right_id"), F.col("start").alias("rs"), F.col("end").alias("re"), buckets(F.col("start"), F.col("end"), width).alias("bucket"))
    pairs = a.join(b, [key, "bucket"]).where((F.col("ls") < F.col("re")) & (F.col("le") > F.col("rs")))
    # Of the buckets that two intervals share, the first is that of the later start.
    once = pairs.where(F.col("bucket") == F.floor(F.greatest("ls", "rs") / width))
    return once.select(key, "left_id", "right_id", (F.least("le", "re") - F.greatest("ls", "rs")).alias("shared"))


def overlap_counts(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Every interval on the left with ``n``, the number of those on the right that it overlaps; over 1: fragmented."""
    n = overlaps(left, right, key, width).groupBy(key, F.col("left_id").alias("id")).agg(F.count("*").alias("n"))
    return left.select(key, "id").join(n, [key, "id"], "left").select(key, "id", F.coalesce("n", F.lit(0)).alias("n"))


def aligned_segments(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Elementary segments of two timelines ``(key, start, end, label)``: ``key, start, end, left_label, right_label``.

    The end points of both cut the time; a segment has the label of each timeline there, or null. One shuffle by key:
    at each end point, the last interval of either side to begin is looked up by a window and dropped if it has ended.
    """
    starts = lambda df, side: df.select(key, F.col("start").alias("at"), *[(F.struct("end", "label") if s == side else F.lit(None).cast(df.select(F.struct("end", "label").alias("x")).schema["x"].dataType)).alias(s) for s in ("l", "r")])
    ends = lambda df: df.select(key, F.col("end").alias("at"))
    points = starts(left, "l").unionByName(starts(right, "r")).unionByName(ends(left).unionByName(ends(right)), allowMissingColumns=True)
    points = points.groupBy(key, "at").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    w = W.partitionBy(key).orderBy("at")
    seen = points.select(key, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), *[F.last(s, ignorenulls=True).over(w).alias(s) for s in ("l", "r")])
    label = lambda s: F.when(F.col(f"{s}.end") > F.col("start"), F.col(f"{s}.label"))
    return seen.where(F.col("end").isNotNull()).select(key, "start", "end", label("l").alias("left_label"), label("r").alias("right_label"))


def agreement(segments: DataFrame, key: str) -> DataFrame:
    """Duration-weighted agreement of each key: segments without a left label don't count."""
    span = F.col("end") - F.col("start")
    held = segments.where(F.col("left_label").isNotNull())
    return held.groupBy(key).agg(F.sum(span).alias("total"), F.sum(F.when(F.col("left_label") == F.col("right_label"), span).otherwise(0)).alias("agreed"), F.sum(F.when(F.col("right_label").isNull(), span).otherwise(0)).alias("missing"))


def nearest(probes: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """``key, point_id, at, nearest, error``: the mark ``(key, at)`` nearest to each probe ``(key, point_id, at)``, the
    earlier one among equals, and its signed distance; null where a key has no marks. One window instead of a join."""
    both = probes.select(key, "point_id", "at", F.lit(None).cast("long").alias("mark")).unionByName(marks.select(key, F.lit(None).cast("long").alias("point_id"), "at", F.col("at").alias("mark")))
    back = W.partitionBy(key).orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, 0)  # runs backwards: a frame that ends with the partition costs its square
    seen = both.select(key, "point_id", "at", F.max("mark").over(back).alias("low"), F.min("mark").over(ahead).alias("high")).where(F.col("point_id").isNotNull())
    near = F.when(F.col("low").isNull() | (F.col("high") - F.col("at") < F.col("at") - F.col("low")), F.col("high")).otherwise(F.col("low"))
    return seen.select(key, "point_id", "at", near.alias("nearest"), (near - F.col("at")).alias("error"))


def holding_or_nearest(probes: DataFrame, intervals: DataFrame, key: str, width: int) -> DataFrame:
    """``key, point_id, at, label``: the interval that holds each probe, else the one of which the middle is nearest."""
    held = point_in_interval(probes, intervals, key, width)
    middles = intervals.select(key, (F.col("start") + F.col("end")).alias("at"), "idx", "label")  # in half units, so that whole numbers stay whole
    near = nearest(probes.select(key, "point_id", (2 * F.col("at")).alias("at")), middles.select(key, "at"), key)
    named = near.select(key, "point_id", F.col("nearest").alias("at2")).join(middles.groupBy(key, F.col("at").alias("at2")).agg(F.min(F.struct("idx", "label")).alias("m")), [key, "at2"], "left")
    return held.join(named.select("point_id", F.col("m.label").alias("other")), "point_id", "left").select(key, "point_id", "at", F.coalesce("label", "other").alias("label"))


def playback_state(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """``key, point_id, at, current, following, progress``: index of the interval of a timeline that holds each point, of
    the next to begin, and how far through the interval the point is (0 to 1)."""
    w = W.partitionBy(key).orderBy("at", "probe").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(F.desc("at"), F.desc("probe")).rowsBetween(W.unboundedPreceding, -1)  # runs backwards
    marks = intervals.select(key, F.lit(None).cast("long").alias("point_id"), F.col("start").alias("at"), F.lit(0).alias("probe"), F.struct("idx", "start", "end").alias("i"))
    none = marks.schema["i"].dataType
    both = marks.unionByName(points.select(key, F.col("point_id").cast("long"), F.col("at").cast(marks.schema["at"].dataType), F.lit(1).alias("probe"), F.lit(None).cast(none).alias("i")))
    seen = both.select(key, "point_id", "at", "probe", F.last("i", ignorenulls=True).over(w).alias("i"), F.last("i", ignorenulls=True).over(ahead).alias("n")).where("probe = 1")
    inside = F.col("i.end") > F.col("at")
    share = F.try_divide((F.col("at") - F.col("i.start")).cast("double"), (F.col("i.end") - F.col("i.start")).cast("double"))
    return seen.select(key, "point_id", "at", F.when(inside, F.col("i.idx")).alias("current"), F.col("n.idx").alias("following"), F.when(inside, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0).alias("progress"))


def max_overlap(intervals: DataFrame, key: str) -> DataFrame:
    """``key, most``: the largest number of intervals at one time; an end comes before a start at the same time."""
    edges = intervals.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.at", "e.d")
    summed = edges.groupBy(key, "at", "d").agg(F.sum("d").alias("step"))
    w = W.partitionBy(key).orderBy("at", "d").rowsBetween(W.unboundedPreceding, 0)
    return summed.select(key, F.sum("step").over(w).alias("n")).groupBy(key).agg(F.greatest(F.max("n"), F.lit(0)).alias("most"))


def window_frames(frames: DataFrame, windows: DataFrame, key: str, width: int) -> DataFrame:
    """Mean of each element of ``vector`` and largest ``peak`` of the frames ``(key, at, vector, peak)`` in every window
    ``(key, id, start, end)``: ``key, id, mean, peak, n``."""
    spread = windows.select(key, "id", "start", "end", buckets(F.col("start"), F.col("end"), width).alias("bucket"))
    inside = frames.withColumn("bucket", F.floor(F.col("at") / width)).join(spread, [key, "bucket"]).where((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")))
    return vector_mean(inside, [key, "id"], extra=[F.max("peak").alias("peak")])


def vector_mean(rows: DataFrame, keys: list[str], column: str = "vector", extra: list[Column] | None = None) -> DataFrame:
    """Element-wise mean of an array column by keys, with the number of rows ``n``."""
    each = rows.select(*keys, F.posexplode(column).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    mean = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean"))
    return mean.join(rows.groupBy(*keys).agg(F.count("*").alias("n"), *(extra or [])), keys)
