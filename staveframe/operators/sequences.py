"""Operators on ordered rows of a key: runs, groups, merges, gaps and grids.

All are windows, groupings or ordered folds of Spark; a key's rows are ordered by ``at`` and then ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ordered(key: str):
    return W.partitionBy(key).orderBy("at", "id")


def _islands(rows: DataFrame, key: str, begins: Column) -> DataFrame:
    """Adds ``island``, which counts up at every row that begins one. ``begins`` may use windows."""
    flagged = rows.withColumn("begins", F.coalesce(begins, F.lit(True)).cast("int"))
    return flagged.withColumn("island", F.sum("begins").over(_ordered(key).rowsBetween(W.unboundedPreceding, 0))).drop("begins")


def label_runs(rows: DataFrame, key: str) -> DataFrame:
    """Runs of equal labels of rows ``(key, id, at, end, label, score)``: ``key, island, start, end, label, n, score``
    with the mean score."""
    marked = _islands(rows, key, ~(F.lag("label").over(_ordered(key)).eqNullSafe(F.col("label"))))
    return marked.groupBy(key, "island").agg(F.min("at").alias("start"), F.max("end").alias("end"), F.first("label").alias("label"), F.count("*").alias("n"), F.avg("score").alias("score"))


def lag_gap_groups(rows: DataFrame, key: str, gap: int, level_step: float | None = None) -> DataFrame:
    """Groups of rows ``(key, id, at, level)``: a new one where ``at`` grows by more than ``gap`` (or ``level`` changes by
    more than ``level_step``): ``key, island, start, end, n, level`` with the mean level."""
    w = _ordered(key)
    begins = F.col("at") - F.lag("at").over(w) > gap
    if level_step is not None:
        begins = begins | (F.abs(F.col("level") - F.lag("level").over(w)) > level_step)
    return _islands(rows, key, begins).groupBy(key, "island").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n"), F.avg("level").alias("level"))


def gap_merge(rows: DataFrame, key: str, gap: int) -> DataFrame:
    """Merges intervals ``(key, id, at, end, score)`` where one begins at most ``gap`` after the running end:
    ``key, island, start, end, n, score``. The score is a running mean weighted by length, taken in order."""
    before = W.partitionBy(key).orderBy("at", "end", "id").rowsBetween(W.unboundedPreceding, -1)
    flagged = rows.withColumn("begins", F.coalesce(F.col("at") - F.max("end").over(before) > gap, F.lit(True)).cast("int"))
    marked = flagged.withColumn("island", F.sum("begins").over(W.partitionBy(key).orderBy("at", "end", "id").rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("at", "end", "id", "score")))
    grouped = marked.groupBy(key, "island").agg(F.min("at").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), parts.alias("parts"))

    def step(state: Column, x: Column) -> Column:
        length = F.greatest((x["end"] - x["at"]).cast("double"), F.lit(1e-9))
        held = F.greatest((state["end"] - state["at"]).cast("double"), F.lit(1e-9))
        mean = (state["score"] * held + x["score"] * length) / (held + length)
        return F.struct(state["at"].alias("at"), F.greatest(state["end"], x["end"]).alias("end"), F.lit(None).cast("long").alias("id"), mean.alias("score"))

    first = F.col("parts")[0]
    start = F.struct(first["at"].alias("at"), first["end"].alias("end"), F.lit(None).cast("long").alias("id"), first["score"].cast("double").alias("score"))
    folded = F.aggregate(F.slice("parts", 2, F.size("parts")), start, step)
    return grouped.select(key, "island", "start", "end", "n", folded["score"].alias("score"))


def anchored_clusters(rows: DataFrame, key: str, tolerance: int) -> DataFrame:
    """Adds ``anchor`` to rows ``(key, id, at)``: a new cluster begins where ``at`` is more than ``tolerance`` after the
    FIRST of the cluster, so this is no session. A gap over the tolerance always begins a cluster; an ordered fold over
    the distinct times between two such gaps finds the anchors."""
    ordered = W.partitionBy(key).orderBy("at")
    begins = F.coalesce(F.col("at") - F.lag("at").over(ordered) > tolerance, F.lit(True)).cast("int")
    distinct = rows.where(F.col("at").isNotNull()).select(key, "at").distinct().select(key, "at", begins.alias("begins"))
    islands = distinct.select(key, "at", F.sum("begins").over(ordered.rowsBetween(W.unboundedPreceding, 0)).alias("island"))
    times = islands.groupBy(key, "island").agg(F.array_sort(F.collect_list("at")).alias("ts"))
    # Anchors only are held in the fold, as long as they are few; each time's anchor is the last one up to it.
    start = F.array().cast("array<bigint>")

    def step(anchors: Column, t: Column) -> Column:
        last = F.element_at(anchors, -1)
        return F.when(F.size(anchors) == 0, F.array(t)).when(t - last > tolerance, F.array_append(anchors, t)).otherwise(anchors)

    found = times.select(key, F.explode(F.aggregate("ts", start, step)).alias("anchor"))
    marked = distinct.select(key, "at").join(found.select(key, F.col("anchor").alias("at"), F.col("anchor")), [key, "at"], "left")
    anchors = marked.select(key, "at", F.last("anchor", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, 0)).alias("anchor"))
    return rows.join(anchors, [key, "at"])


def density_filter(rows: DataFrame, key: str, reach: int, most: float, floor: float, high: float) -> DataFrame:
    """Rows ``(key, id, at, score)`` of which the score reaches a floor that rises with the number of rows within
    ``reach``: min(high, floor + 0.025 x (rows over ``most``))."""
    near = F.count("*").over(W.partitionBy(key).orderBy("at").rangeBetween(-reach, reach))
    counted = rows.withColumn("near", near)
    return counted.where(F.col("score") >= F.least(F.lit(high), F.lit(floor) + 0.025 * F.greatest(F.lit(0.0), F.col("near") - F.lit(most))))


def with_neighbour(rows: DataFrame, key: str, reach: int, level_reach: float, least: float) -> DataFrame:
    """Rows ``(key, id, at, level, score)`` with another row of the key within both reaches and a score of ``least`` or
    more. A semi join on the bucket of time and its neighbours, so that a key's rows are spread."""
    mine = rows.withColumn("bucket", F.floor(F.col("at") / reach))
    other = rows.where(F.col("score") >= least).select(F.col(key).alias("k"), F.col("id").alias("o"), F.col("at").alias("oa"), F.col("level").alias("ol"), F.explode(F.array(*[F.floor(F.col("at") / reach) + d for d in (-1, 0, 1)])).alias("ob"))
    near = (F.col("ob") == F.col("bucket")) & (F.col("k") == F.col(key)) & (F.col("o") != F.col("id")) & (F.abs(F.col("oa") - F.col("at")) <= reach) & (F.abs(F.col("ol") - F.col("level")) <= level_reach)
    return mine.join(other, near, "left_semi").drop("bucket")


def without_ghosts(rows: DataFrame, group: list[str], distances: tuple[int, ...], ratio: float, high: float) -> DataFrame:
    """Rows ``(group, id, level, score)`` but for those that stand at one of the distances in level from a stronger row of
    their group and have less than ``ratio`` of its score, and less than ``high``."""
    strong = rows.select(*[F.col(g).alias(f"s_{g}") for g in group], F.col("id").alias("s_id"), F.col("score").alias("s_score"), F.explode(F.array(*[(F.col("level") + s * d).cast(rows.schema["level"].dataType) for d in distances for s in (-1, 1)])).alias("s_level"))
    on = [F.col(g) == F.col(f"s_{g}") for g in group]
    ghost = (F.col("s_level") == F.col("level")) & (F.col("s_id") != F.col("id")) & (F.col("score") < ratio * F.col("s_score")) & (F.col("score") < high)
    condition = ghost
    for x in on:
        condition = condition & x
    return rows.join(strong, condition, "left_anti")


def mode_filter(rows: DataFrame, key: str, radius: int = 1) -> DataFrame:
    """``key, id, label, score``: each row's label by vote of the rows within ``radius`` places: by number, then its own
    label, then sum of the scores, then the label; and the winner's mean score."""
    w = _ordered(key).rowsBetween(-radius, radius)
    seen = rows.withColumn("near", F.collect_list(F.struct("label", "score")).over(w))
    names = F.array_distinct(F.transform("near", lambda x: x["label"]))

    def vote(name: Column) -> Column:
        own = F.filter("near", lambda x: x["label"] == name)
        points = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["score"])
        return F.struct((-F.size(own)).alias("n"), F.when(name == F.col("label"), 0).otherwise(1).alias("other"), (-points).alias("points"), name.alias("label"))

    best = F.array_min(F.transform(names, vote))
    return seen.withColumn("best", best).select(key, "id", F.col("best.label").alias("label"), (F.col("best.points") / F.col("best.n")).alias("score"))


def change_points(rows: DataFrame, key: str) -> DataFrame:
    """``key, id, at``: rows whose label isn't that of the row before; the first row of a key is none."""
    return rows.withColumn("was", F.lag("label").over(_ordered(key))).where(F.col("was") != F.col("label")).select(key, "id", "at")


def clipped_at_next(rows: DataFrame, key: str, least: int) -> DataFrame:
    """``key, id, at, end``: ends moved to the next start of the key where they reach beyond it, ``least`` long at least."""
    following = F.lead("at").over(_ordered(key))
    return rows.select(key, "id", "at", F.greatest(F.col("at") + least, F.least(F.col("end"), F.coalesce(following, F.col("end")))).alias("end"))


def flicker_factor(rows: DataFrame, key: str) -> DataFrame:
    """``key, id, factor``: 1, 0.65 or 0.25 by how many of the two neighbours have another label; 0 for a null label."""
    w = _ordered(key)
    differ = sum((F.coalesce((F.col("label") != f("label").over(w)).cast("int"), F.lit(0)) for f in (F.lag, F.lead)), F.lit(0))
    return rows.select(key, "id", F.when(F.col("label").isNull(), 0.0).when(differ == 0, 1.0).when(differ == 1, 0.65).otherwise(0.25).alias("factor"))


def flickers(runs: DataFrame, key: str, short: int) -> DataFrame:
    """``key, n``: runs ``(key, start, end, label)`` shorter than ``short`` between two runs of one other label."""
    w = W.partitionBy(key).orderBy("start")
    before, after = F.lag("label").over(w), F.lead("label").over(w)
    flagged = runs.select(key, (((before == after) & (before != F.col("label")) & (F.col("end") - F.col("start") < short))).alias("f"))
    return flagged.groupBy(key).agg(F.count_if("f").alias("n"))


def local_run_length(runs: DataFrame, key: str, skip: str = "N") -> DataFrame:
    """``key, island, windows``: 1, 2 or 4 by the median length of the runs within two places, without those of ``skip``."""
    w = W.partitionBy(key).orderBy("island").rowsBetween(-2, 2)
    near = F.array_sort(F.collect_list(F.when(F.col("label") != skip, F.col("n"))).over(w))
    size = F.size(near)
    middle = F.when(size == 0, F.lit(0.0)).otherwise((F.get(near, F.floor((size - 1) / 2).cast("int")) + F.get(near, F.floor(size / 2).cast("int"))) / 2.0)
    return runs.select(key, "island", middle.alias("m")).select(key, "island", F.when(F.col("m") <= 1.5, 1).when(F.col("m") <= 3, 2).otherwise(4).alias("windows"))


def fixed_lag_matches(rows: DataFrame, vector: str, lags: list[int], least: float, similarity) -> DataFrame:
    """``id, lag, similarity``: for rows ``(id, place, vector)``, the lag at which an earlier row is most similar, if by
    ``least`` or more; the smaller lag among equals. An equi join on the place, one row for each lag."""
    later = rows.select("id", F.col(vector).alias("v"), F.col("place").alias("own"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn("place", F.col("own") - F.col("lag"))
    pairs = later.join(rows.select("place", F.col(vector).alias("u")), "place").select("id", "lag", similarity(F.col("v"), F.col("u")).alias("s")).where(F.col("s") >= least)
    return pairs.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("s"), "lag")).alias("m")).select("id", F.col("m.lag").alias("lag"), (-F.col("m.s")).alias("similarity"))


def beat_windows(tracks: DataFrame, key: str, fallback: float = 1.0) -> DataFrame:
    """``key, idx, start, end, strength`` of the windows of tracks ``(key, duration, beat, phase)``: one for each beat, a
    first one up to the phase if it is over 0.35 of a beat long; windows of ``fallback`` seconds where the beat is null."""
    beat = F.coalesce("beat", F.lit(fallback))
    phase = F.when(F.col("beat").isNull(), 0.0).otherwise(F.pmod(F.coalesce("phase", F.lit(0.0)), beat))
    lead = F.when(phase > 0.35 * beat, phase).otherwise(F.lit(0.0))
    n = F.greatest(F.lit(1), F.ceil((F.col("duration") - lead) / beat - 0.35)).cast("int")
    timed = tracks.select(key, "duration", beat.alias("b"), phase.alias("p"), lead.alias("l"), n.alias("n"))
    whole = timed.select(key, "duration", "b", "p", "l", "n", F.posexplode(F.sequence(F.when(F.col("l") > 0, -1).otherwise(0), F.col("n") - 1)).alias("idx", "k"))
    start = F.when((F.col("k") < 0) | ((F.col("k") == 0) & (F.col("l") == 0)), 0.0).otherwise(F.col("p") + F.col("k") * F.col("b"))
    end = F.when(F.col("k") == F.col("n") - 1, F.col("duration")).otherwise(F.col("p") + (F.col("k") + 1) * F.col("b"))
    strength = F.when(F.pmod("k", F.lit(4)) == 0, 1.0).when(F.pmod("k", F.lit(2)) == 0, 0.86).otherwise(0.72)
    return whole.select(key, "idx", start.alias("start"), end.alias("end"), strength.alias("strength"))


def chunks_of(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``key, chunk, n``: pieces of ``size`` rows ``(key, place)``; a last piece of less than a quarter goes."""
    return rows.groupBy(key, F.floor(F.col("place") / size).alias("chunk")).agg(F.count("*").alias("n")).where(F.col("n") >= size / 4)


def gaps_filled(rows: DataFrame, key: str, step: float) -> DataFrame:
    """``key, id, value``: null values of rows ``(key, id, place, value)`` lie on the line between the known ones beside
    them; before the first and after the last known one they go on by ``step`` a place; keys without any stay null."""
    back = W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, 0)  # runs backwards
    known = F.when(F.col("value").isNotNull(), F.struct("place", "value"))
    seen = rows.select(key, "id", "place", F.last(known, ignorenulls=True).over(back).alias("a"), F.last(known, ignorenulls=True).over(ahead).alias("b"))
    line = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * F.coalesce(F.try_divide((F.col("place") - F.col("a.place")).cast("double"), (F.col("b.place") - F.col("a.place")).cast("double")), F.lit(0.0))
    alone = F.coalesce(F.col("a.value") + step * (F.col("place") - F.col("a.place")), F.col("b.value") - step * (F.col("b.place") - F.col("place")))
    return seen.select(key, "id", F.coalesce(line, alone).alias("value"))


def grid_best(rows: DataFrame, key: str, bar: int, slots: int = 16) -> DataFrame:
    """The best row ``(key, id, at, lane, score)`` of each slot and lane of a grid of ``slots`` in every ``bar``: ``key,
    bar, slot, lane, id, span`` with the number of slots up to the next filled slot of the bar. The first row wins ties."""
    bar_no = F.floor(F.col("at") / bar)
    slot = F.least(F.lit(slots - 1), F.floor((F.col("at") - bar_no * bar) * slots / bar + 0.5)).cast("int")
    best = rows.groupBy(key, bar_no.alias("bar"), slot.alias("slot"), "lane").agg(F.min(F.struct((-F.col("score")).alias("s"), "at", "id")).alias("m"))
    filled = best.select(key, "bar", "slot").distinct()
    spans = filled.select(key, "bar", "slot", (F.coalesce(F.lead("slot").over(W.partitionBy(key, "bar").orderBy("slot")), F.lit(slots)) - F.col("slot")).alias("span"))
    return best.select(key, "bar", "slot", "lane", F.col("m.id").alias("id")).join(spans, [key, "bar", "slot"])


def stride_sample(rows: DataFrame, key: str, stride: int, most: int) -> DataFrame:
    """Every ``stride``-th row of a key, ``most`` at most: this is the operator's meaning, not a shortcut."""
    place = F.row_number().over(_ordered(key)) - 1
    return rows.withColumn("place", place).where((F.col("place") % stride == 0) & (F.col("place") < stride * most))


def first_per(rows: DataFrame, category: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each category in the given order."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*category).orderBy(*order))).where(F.col("rank") <= n)


def movement(rows: DataFrame, key: str, tolerance: int) -> DataFrame:
    """``key, mean_step, largest_step`` of the mean level of anchored clusters of rows ``(key, id, at, level)``."""
    mean = anchored_clusters(rows, key, tolerance).groupBy(key, "anchor").agg(F.avg("level").alias("level"))
    step = F.abs(F.col("level") - F.lag("level").over(W.partitionBy(key).orderBy("anchor")))
    return mean.select(key, step.alias("s")).groupBy(key).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean_step"), F.coalesce(F.max("s"), F.lit(0.0)).alias("largest_step"))
