"""Accuracy of one timeline of chords against another, joins of several timelines, and diagnostics of weights and keys.

Timelines are ``key, id, start, end, label`` with half-open intervals that don't overlap. All are joins, windows and
groupings; a key's rows are spread where a join needs buckets of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staveframe.functions import labels as L
from staveframe.functions.scalars import clamp, half_up, safe_div
from staveframe.operators import intervals as I
from staveframe.operators import scores as S
from staveframe.operators.fusion import BINS, key_estimate

# Weights and bounds of the learned evidence, and the degrees of the two scales with their triads.
LEARNED_WEIGHT, LEAST_LEARNED, MOST_ENTROPY, PROTECTED, MOST_FULL_MIX, MOST_GUITAR, RULE_TOP = 0.35, 0.6, 0.75, 0.72, 0.3, 0.55, 0.9
SCALES = {"major": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10)}
TRIADS = {"major": ("maj", "min", "min", "maj", "maj", "min", "dim"), "minor": ("min", "dim", "maj", "min", "min", "maj", "maj")}
STAGES = (
    "availability", "minimum-learned-confidence", "maximum-learned-entropy", "learned-confidence-scaling", "learned-entropy-scaling", "rule-score-margin", "rule-confidence-room",
    "high-rule-confidence-protection", "agreement-bonus", "learned-flicker-suppression", "source-specific-maximum",
)
BASS_SURE = 0.35
# The classes of qualities that a model is trained on; all others are of class 0.
TARGETS = {"min": 1, "min7": 1, "dim": 1, "7": 2}


def _plain(symbol: Column) -> Column:
    """A strict symbol without its bass."""
    return F.regexp_replace(symbol, "/.*", "")


def _family(c: Column) -> Column:
    return F.when(c["root"].isNull(), "N").when(F.coalesce(c["quality"].isin(*L.MINOR_LIKE), F.lit(False)), F.concat(c["root"].cast("string"), F.lit("min"))).otherwise(F.concat(c["root"].cast("string"), F.lit("maj")))


def judged_segments(reference: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """Elementary segments of the reference ``key, start, end, span, reference, detected``; nothing detected is ``N``."""
    cut = I.aligned_segments(reference.select(key, "start", "end", "label"), detected.select(key, "start", "end", "label"), key).where(F.col("left_label").isNotNull())
    return cut.select(key, "start", "end", (F.col("end") - F.col("start")).alias("span"), F.col("left_label").alias("reference"), F.coalesce("right_label", F.lit("N")).alias("detected"))


def _plain_symbol(label: Column) -> Column:
    return F.coalesce(_plain(L.strict_once(label)["symbol"]), F.lit("N"))


def accuracy_report(reference: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """Shares of each key's time: ``key, total, root, family, detailed, none_precision, none_recall, inversion``. A share
    of nothing is 0."""
    r, d = F.col("r"), F.col("d")
    span = lambda when: F.sum(F.when(when, F.col("span")).otherwise(0))
    silent_r, silent_d = r["root"].isNull(), d["root"].isNull()
    # Summed up by pairs of labels first, so that few labels are read.
    pairs = judged_segments(reference, detected, key).groupBy(key, "reference", "detected").agg(F.sum("span").alias("span"))
    sums = pairs.select(key, "span", L.strict_once(F.col("reference")).alias("r"), L.strict_once(F.col("detected")).alias("d")).groupBy(key).agg(
        F.sum("span").alias("total"), span(r["root"].eqNullSafe(d["root"])).alias("root"), span(_family(r) == _family(d)).alias("family"), span(F.coalesce(_plain(r["symbol"]), F.lit("N")) == F.coalesce(_plain(d["symbol"]), F.lit("N"))).alias("detailed"),
        span(silent_r & silent_d).alias("both"), span(silent_r).alias("none_r"), span(silent_d).alias("none_d"), span(r["bass"].isNotNull()).alias("bass"), span(r["bass"].isNotNull() & r["bass"].eqNullSafe(d["bass"])).alias("bass_right"),
    )
    share = lambda a, b: half_up(safe_div(F.col(a).cast("double"), F.col(b).cast("double")))
    return sums.select(key, "total", *[share(c, "total").alias(c) for c in ("root", "family", "detailed")], share("both", "none_d").alias("none_precision"), share("both", "none_r").alias("none_recall"), share("bass_right", "bass").alias("inversion"))


def confusion(reference: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """``reference, detected, seconds``: time of each pair of different symbols over all keys, in the unit of the timelines."""
    pairs = judged_segments(reference, detected, key).groupBy("reference", "detected").agg(F.sum("span").alias("span"))
    read = pairs.select(_plain_symbol(F.col("reference")).alias("reference"), _plain_symbol(F.col("detected")).alias("detected"), "span")
    return read.where(F.col("reference") != F.col("detected")).groupBy("reference", "detected").agg(F.sum("span").alias("seconds"))


def mismatch_runs(reference: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """``key, start, end, reference, detected``: stretches of one wrong symbol for one right symbol, neighbours merged."""
    cut = judged_segments(reference, detected, key).drop("span").withColumnsRenamed({"reference": "_r", "detected": "_d"})
    # So that few labels are read. Those of a pair come as its maximum: a condition on what it is grouped by would be moved below it, to every segment.
    told = cut.groupBy("_r", "_d").agg(F.max("_r").alias("r"), F.max("_d").alias("d"))
    pairs = told.select("_r", "_d", _plain_symbol(F.col("r")).alias("reference"), _plain_symbol(F.col("d")).alias("detected"))
    named = cut.join(pairs.where(F.col("reference") != F.col("detected")), ["_r", "_d"]).drop("_r", "_d")
    w = W.partitionBy(key).orderBy("start")
    same = (F.lag("end").over(w) == F.col("start")) & (F.lag("reference").over(w) == F.col("reference")) & (F.lag("detected").over(w) == F.col("detected"))
    marked = named.withColumn("begins", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("reference").alias("reference"), F.first("detected").alias("detected")).drop("run")


def boundary_report(reference: DataFrame, detected: DataFrame, key: str, tolerance: float) -> DataFrame:
    """``key, n, mean, median, signed, early, late``: errors of the boundaries detected nearest to those of the reference
    (each timeline's starts but the first); early and late are those beyond the tolerance."""
    first = lambda t: t.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy("start"))).where("k > 1")
    found = I.nearest(first(reference).select(key, F.col("id").alias("point_id"), F.col("start").alias("at")), first(detected).select(key, F.col("start").alias("at")), key).where(F.col("error").isNotNull())
    e = F.col("error").cast("double")
    return found.groupBy(key).agg(F.count("*").alias("n"), half_up(F.avg(F.abs(e)), 3).alias("mean"), half_up(F.median(F.abs(e)), 3).alias("median"), half_up(F.avg(e), 3).alias("signed"), F.count_if(e < -tolerance).alias("early"), F.count_if(e > tolerance).alias("late"))


def labels_at_middle(windows: DataFrame, timelines: dict[str, DataFrame], key: str, width: int) -> DataFrame:
    """Windows ``(key, id, start, end)`` with a column for each timeline: its label at the window's middle, else ``N``.
    Middles are taken in half units, so that whole times stay whole."""
    out = windows.select(key, "id", "start", "end")
    points = windows.select(key, F.col("id").alias("point_id"), (F.col("start") + F.col("end")).alias("at"))
    for name, line in timelines.items():
        doubled = line.select(key, (2 * F.col("start")).alias("start"), (2 * F.col("end")).alias("end"), F.col("id").alias("idx"), "label")
        hit = I.point_in_interval(points, doubled, key, 2 * width).select(key, F.col("point_id").alias("id"), F.coalesce("label", F.lit("N")).alias(name))
        out = out.join(hit, [key, "id"])
    return out


def overrides(windows: DataFrame, rule: DataFrame, hybrid: DataFrame, reference: DataFrame, key: str, width: int) -> DataFrame:
    """``key, windows, changed, corrected, spoiled, share``: windows in which the hybrid label at the middle is another than
    the rule's, and of these those that put it right or wrong."""
    told = labels_at_middle(windows, {"rule": rule, "hybrid": hybrid, "wanted": reference}, key, width)
    a, b, c = F.col("rule"), F.col("hybrid"), F.col("wanted")
    sums = told.groupBy(key).agg(F.count("*").alias("windows"), F.count_if(a != b).alias("changed"), F.count_if((a != b) & (b == c)).alias("corrected"), F.count_if((a != b) & (a == c)).alias("spoiled"))
    return sums.withColumn("share", half_up(safe_div(F.col("changed").cast("double"), F.col("windows").cast("double"))))


def missed_short(reference: DataFrame, detected: DataFrame, key: str, most: float, width: int) -> DataFrame:
    """``key, short, missed``: reference intervals of at most this length, and those with another chord at their middle; two
    spellings of a symbol, with any bass, are one chord."""
    short = reference.where(F.col("end") - F.col("start") <= most)
    told = labels_at_middle(short, {"found": detected}, key, width).join(short.select(key, "id", "label"), [key, "id"])
    pairs = told.groupBy(key, "found", "label").agg(F.count("*").alias("n"))  # so that few labels are read
    other = _plain_symbol(F.col("found")) != _plain_symbol(F.col("label"))
    return pairs.groupBy(key).agg(F.sum("n").alias("short"), F.sum(F.when(other, F.col("n")).otherwise(0)).alias("missed"))


def bass_evidence(windows: DataFrame, reference: DataFrame, key: str, width: int) -> DataFrame:
    """``key, agreement, coverage, sure_agreement, conflict`` of windows ``(key, id, start, end, bass, confidence)``: each is
    held against the reference at its middle, and weighs as much as it overlaps with that interval."""
    w = windows.select(key, "id", "start", "end", "bass", "confidence")
    at = w.select(key, F.col("id").alias("point_id"), (F.col("start") + F.col("end")).alias("at"))
    lines = reference.select(key, (2 * F.col("start")).alias("start"), (2 * F.col("end")).alias("end"), F.col("id").alias("idx"), F.struct("start", "end", "label").alias("label"))
    hit = I.point_in_interval(at, lines, key, 2 * width).select(key, F.col("point_id").alias("id"), F.col("label").alias("ref")).where(F.col("ref").isNotNull())
    shared = F.greatest(F.lit(0), F.least("end", "ref.end") - F.greatest("start", "ref.start"))
    both = w.join(hit, [key, "id"]).withColumn("shared", shared).withColumn("right", F.coalesce(F.col("bass") == L.strict_once(F.col("ref.label"))["root"], F.lit(False)))
    part = lambda when: F.sum(F.when(when, F.col("shared")).otherwise(0)).cast("double")
    sure = F.col("confidence") >= BASS_SURE
    sums = both.groupBy(key).agg(F.sum("shared").cast("double").alias("all"), part(F.col("right")).alias("good"), part(sure).alias("sure"), part(sure & F.col("right")).alias("sure_good"))
    share = lambda a, b: half_up(safe_div(a, b))
    c = F.col
    return sums.select(key, share(c("good"), c("all")).alias("agreement"), share(c("sure"), c("all")).alias("coverage"), share(c("sure_good"), c("sure")).alias("sure_agreement"), share(c("sure") - c("sure_good"), c("sure")).alias("conflict"))


def with_corrections(regions: DataFrame, corrections: DataFrame, key: str, width: int) -> DataFrame:
    """Regions ``(key, id, start, end, label)`` with the label of the last correction ``(key, id, start, end, label)`` whose
    middle lies in them, and ``locked``."""
    at = corrections.select(key, F.col("id").alias("point_id"), (F.col("start") + F.col("end")).alias("at"))
    lines = regions.select(key, (2 * F.col("start")).alias("start"), (2 * F.col("end")).alias("end"), F.col("id").alias("idx"), F.col("id").alias("label"))
    hit = I.point_in_interval(at, lines, key, 2 * width).where(F.col("label").isNotNull()).select(key, F.col("point_id").alias("c"), F.col("label").alias("id"))
    new = hit.join(corrections.select(key, F.col("id").alias("c"), F.col("label").alias("new")), [key, "c"]).groupBy(key, "id").agg(F.max_by("new", "c").alias("new"))
    return regions.join(new, [key, "id"], "left").select(key, "id", "start", "end", F.coalesce("new", "label").alias("label"), F.col("new").isNotNull().alias("locked"))


def on_beats(chords: DataFrame, beats: DataFrame, key: str, step: int = 4, least: float = 0.05) -> DataFrame:
    """``key, place, start, end``: chord ``place`` (from 0) begins at the beat ``place x step``, the last beat at most, and ends
    where the next begins; the last one at ``duration``. Beats ``(key, at)`` count once each."""
    grid = beats.select(key, "at").distinct().withColumn("beat", F.row_number().over(W.partitionBy(key).orderBy("at")) - 1)
    last = grid.groupBy(key).agg(F.max("beat").alias("top"), F.max("at").alias("end_beat"))
    sized = chords.join(last, key).withColumn("n", F.count("*").over(W.partitionBy(key)))
    spot = lambda k: F.least(F.col("place") * step + k, F.col("top"))
    a = sized.withColumn("beat", spot(0)).join(grid.select(key, "beat", F.col("at").alias("start")), [key, "beat"]).drop("beat")
    b = a.withColumn("beat", spot(step)).join(grid.select(key, "beat", F.col("at").alias("following")), [key, "beat"])
    end = F.when(F.col("place") + 1 < F.col("n"), F.col("following")).otherwise(F.coalesce("duration", "end_beat"))
    return b.select(key, "place", "start", F.greatest(F.col("start") + least, end).alias("end"))


def key_compatibility(root: Column, quality: Column, tonic: Column, mode: Column, confidence: Column) -> Column:
    """How well a chord fits a key: its confidence for a triad of the scale, 0.45 of it for a dominant that resolves to one,
    else 0.12 of it for or against, by whether the root is in the scale; 0 without a key."""
    degree = F.pmod(root - tonic, F.lit(12))
    plain = F.when(quality.isin("min", "min7"), "min").when(quality == "dim", "dim").otherwise("maj")

    def of(which: str) -> Column:
        triad, inside = F.lit(False), F.lit(False)
        for d, q in zip(SCALES[which], TRIADS[which], strict=True):
            triad, inside = triad | ((degree == d) & (plain == q)), inside | (degree == d)
        resolves = (quality == "7") & F.pmod(degree + 5, F.lit(12)).isin(*SCALES[which])
        return F.when(triad, confidence).when(resolves, 0.45 * confidence).when(inside, 0.12 * confidence).otherwise(-0.12 * confidence)

    return F.when(tonic.isNull(), 0.0).when(mode == "major", of("major")).otherwise(of("minor"))


def local_keys(windows: DataFrame, frames: DataFrame, key: str, reach: int, width: int, least: float = 0.25) -> DataFrame:
    """``key, id, name, confidence, is_local``: the key of the frames ``(key, id, start, end, vector, level)`` of pitch classes that
    overlap a window ``(key, id, start, end)`` widened by ``reach``, if it is sure enough, else that of all the key's frames.

    Frames are summed up as :func:`scores.robust_mean` does it. A median of moving frames has no running form, so windows
    and frames meet in buckets of time of this ``width``: each window with the frames in its reach, however long the track is.
    """
    wide = windows.select(key, "id", (F.col("start") - reach).alias("start"), (F.col("end") + reach).alias("end"))
    met = I.overlaps(wide, frames, key, width).select(key, F.col("left_id").alias("window"), F.col("right_id").alias("id"))
    heard = S.robust_mean(met.join(frames.select(key, "id", "level", "vector"), [key, "id"]), [key, "window"])
    local = heard.select(key, F.col("window").alias("id"), key_estimate(F.col("chroma")).alias("local"))
    whole = S.robust_mean(frames, [key]).select(key, key_estimate(F.col("chroma")).alias("all"))
    joined = windows.select(key, "id").join(local, [key, "id"], "left").join(whole, key, "left")
    use = F.col("local").isNotNull() & (F.col("all").isNull() | (F.col("local.confidence") >= least))
    pick = lambda f: F.when(use, F.col(f"local.{f}")).otherwise(F.col(f"all.{f}")).alias(f)
    return joined.select(key, "id", pick("name"), pick("confidence"), F.coalesce(use, F.lit(False)).alias("is_local"))


def gates(frames: Column, top: Column, entropy: Column, margin: Column, confidence: Column, agrees: Column, flicker: Column, full_mix: Column, settings: dict | None = None) -> list:
    """The eleven steps, in the order of :data:`STAGES`, from a weight to the one after each; ``settings`` may hold other bounds."""
    of = lambda name, usual: (settings or {}).get(name, F.lit(usual))
    least, most, protected = of("least_learned", LEAST_LEARNED), of("most_entropy", MOST_ENTROPY), of("protected", PROTECTED)
    ambiguous = 1 - clamp(margin / 0.1)
    unsure = 1 - clamp(confidence / protected)
    room = 0.35 + 0.65 * (ambiguous + unsure) / 2
    by_margin = 0.675 + 0.325 * ambiguous
    gate = lambda ok: (lambda w: F.when(ok, w).otherwise(0.0))
    times = lambda f: (lambda w: w * f)
    return [
        gate(frames > 0), gate(top >= least), gate(entropy < most), times(0.35 + 0.65 * clamp((top - least) / (1 - least))), times(clamp((most - entropy) / most)),
        times(by_margin), times(room / by_margin), times(F.when(confidence <= protected, 1.0).otherwise(clamp((RULE_TOP - confidence) / (RULE_TOP - protected)))), times(F.when(agrees, 1.1).otherwise(1.0)), times(flicker),
        lambda w: F.least(F.greatest(w, F.lit(0.0)), F.when(full_mix, MOST_FULL_MIX).otherwise(of("most_guitar", MOST_GUITAR))),
    ]


def learned_weight(frames: Column, top: Column, entropy: Column, margin: Column, confidence: Column, agrees: Column, flicker: Column, full_mix: Column) -> Column:
    """``array<struct(stage, before, after, limited)>``: the weight of learned evidence through its eleven gates in turn; the
    last ``after`` is the weight."""
    out, w = [], F.lit(LEARNED_WEIGHT)
    for name, step in zip(STAGES, gates(frames, top, entropy, margin, confidence, agrees, flicker, full_mix), strict=True):
        after = step(w)
        out.append(F.struct(F.lit(name).alias("stage"), w.alias("before"), after.alias("after"), (after < w - 1e-9).alias("limited")))
        w = after
    return F.array(*out)


def gate_diagnostics(windows: DataFrame) -> DataFrame:
    """``stage, n, before, after`` of windows ``(stages)`` that a stage has limited, all stages."""
    each = windows.select(F.explode("stages").alias("s")).groupBy("s.stage").agg(F.count_if("s.limited").alias("n"), F.avg(F.when(F.col("s.limited"), F.col("s.before"))).alias("before"), F.avg(F.when(F.col("s.limited"), F.col("s.after"))).alias("after"))
    return each.select("stage", "n", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))


def weight_buckets(windows: DataFrame) -> DataFrame:
    """``bucket, n`` of the weights of windows ``(weight)``."""
    w = F.col("weight")
    name = F.when(w == 0, "zero").when(w < 0.05, "below-0.05").when(w < 0.15, "0.05-to-0.15").when(w < 0.3, "0.15-to-0.30").otherwise("above-0.30")
    return windows.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


def sliced_reliability(points: DataFrame, bins: int = 10) -> DataFrame:
    """``slice, bin, n, confidence, accuracy`` of points ``(confidence, right, slices array)``: each counts in all of its slices."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return points.select(F.explode("slices").alias("slice"), at.alias("bin"), "confidence", "right").groupBy("slice", "bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("right").cast("double")).alias("accuracy"))


def changed_regions(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, changed``: places at which two lists of regions differ in label, start or end, or of which one list has none."""
    placed = lambda t: t.select(key, F.row_number().over(W.partitionBy(key).orderBy("start")).alias("place"), F.struct("label", "start", "end").alias("x"))
    both = placed(left).alias("a").join(placed(right).withColumnRenamed("x", "y"), [key, "place"], "full")
    return both.groupBy(key).agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("changed"))


def region_diagnostics(regions: DataFrame, key: str) -> DataFrame:
    """``key, regions, silent, changes, mean``: numbers of regions, of those without a chord, of label changes, and the mean length."""
    was = F.lag("label").over(W.partitionBy(key).orderBy("start"))
    flagged = regions.select(key, "label", (F.col("end") - F.col("start")).alias("span"), (was != F.col("label")).alias("change"))
    return flagged.groupBy(key).agg(F.count("*").alias("regions"), F.count_if(F.col("label") == "N").alias("silent"), F.count_if("change").alias("changes"), F.avg("span").alias("mean"))


# Names of the twelve roots and endings of the three qualities that a model tells; boundaries count above this.
LEARNED_ROOTS, LEARNED_ENDINGS, BOUNDARY = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"), ("", "m", "7"), 0.6


def fused_regions(regions: DataFrame, frames: DataFrame, key: str, width: int, back: int | None = None, rule_weight: float = 1.0, learned_weight: float = LEARNED_WEIGHT) -> DataFrame:
    """``key, id, start, end, label, learned``: regions ``(key, id, start, end, label, confidence)`` take the likeliest root and
    quality of their frames ``(key, at, roots, qualities, boundary)`` where the product of the two means weighs more than the
    rule's label; those without frames stay.

    With ``back``, a region with frames begins at the first frame within that time before it that is a boundary, and the
    region before it ends there if it lasted longer; a key's first region stays where it is.
    """
    told = frames.select(key, "at", F.concat("roots", "qualities").alias("vector"), F.lit(0.0).alias("peak"))
    mean = I.window_frames(told, regions, key, width).select(key, "id", F.slice("mean", 1, 12).alias("r"), F.slice("mean", 13, 3).alias("q"))
    first = lambda c: F.array_position(c, F.array_max(c)).cast("int")
    named = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), first(c))
    learned = mean.select(key, "id", F.concat(named(LEARNED_ROOTS, "r"), named(LEARNED_ENDINGS, "q")).alias("other"), (F.array_max("r") * F.array_max("q")).alias("sure"))
    order = W.partitionBy(key).orderBy("start", "id")
    rows = regions.join(learned, [key, "id"], "left").withColumn("moved", F.col("start"))
    if back is not None:
        before = regions.select(key, "id", (F.col("start") - back).alias("start"), F.col("start").alias("end"))
        spread = before.select(key, "id", "start", "end", I.buckets(F.col("start"), F.col("end"), width).alias("bucket"))
        marks = frames.where(F.col("boundary") > BOUNDARY).select(key, "at", F.floor(F.col("at") / width).alias("bucket"))
        early = marks.join(spread, [key, "bucket"]).where("start <= at AND at < end").groupBy(key, "id").agg(F.min("at").alias("early"))
        use = F.col("other").isNotNull() & (F.row_number().over(order) > 1)
        rows = rows.join(early, [key, "id"], "left").withColumn("moved", F.when(use, F.coalesce("early", "start")).otherwise(F.col("start")))
    wins = F.coalesce(learned_weight * F.col("sure") > rule_weight * F.col("confidence"), F.lit(False))
    until = F.least("end", F.lead("moved").over(order))
    return rows.select(key, "id", F.col("moved").alias("start"), until.alias("end"), F.when(wins, F.col("other")).otherwise(F.col("label")).alias("label"), wins.alias("learned"))


def shortlist(candidates: DataFrame, group: str, order: list[Column], most: int, always: Column) -> DataFrame:
    """All candidates that ``always`` holds of, and the first ``most`` of the others of each group; ``rank`` counts these."""
    marked = candidates.withColumn("always", F.coalesce(always, F.lit(False)))
    place = F.row_number().over(W.partitionBy(group, "always").orderBy(*order))
    return marked.withColumn("rank", F.when(~F.col("always"), place)).where(F.col("always") | (F.col("rank") <= most)).drop("always")


def fnv1a(text: Column, seed: int = 2166136261) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 units as eight hexadecimal digits, from a seed or its usual start."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.conv(c, 16, 10).cast("long")) * F.lit(16777619), F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(F.aggregate(units, F.lit(seed).cast("long"), step)), 8, "0"))


def frame_agreement(frames: DataFrame, regions: DataFrame, key: str, width: int) -> DataFrame:
    """``key, scored, share``: the frames ``(key, point_id, at, vector)`` within a region that has a root, and the share of which
    the greatest bin, the first of equals, is that root. Keys without such frames have a share of 0."""
    held = I.point_in_interval(frames.select(key, "point_id", "at"), regions.select(key, "start", "end", F.col("id").alias("idx"), "label"), key, width)
    pairs = held.join(frames.select(key, "point_id", (F.array_position("vector", F.array_max("vector")) - 1).alias("top")), [key, "point_id"]).groupBy(key, "label", "top").agg(F.count("*").alias("n"))
    read = pairs.withColumn("root", F.when(F.col("label").isNotNull(), L.annotated(F.coalesce("label", F.lit("N")))["root"]))
    told = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = read.groupBy(key).agg(told(F.col("root").isNotNull()).alias("scored"), told(F.col("root") == F.col("top")).alias("hits"))
    return sums.select(key, "scored", half_up(safe_div(F.col("hits").cast("double"), F.col("scored").cast("double")), 6).alias("share"))


def finite_means(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys, n`` and the mean of the finite values of each metric, rounded; 0 without any."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[half_up(F.coalesce(F.avg(ok(m)), F.lit(0.0))).alias(m) for m in metrics])


def probability_peaks(frames: DataFrame, key: str, over: float = 0.5) -> DataFrame:
    """``key, peaks``: frames ``(key, place, p)`` above ``over`` that neither neighbour exceeds; every frame of a plateau counts."""
    w = W.partitionBy(key).orderBy("place")
    fits = lambda c: c.isNull() | (F.col("p") >= c)
    return frames.select(key, ((F.col("p") > over) & fits(F.lag("p").over(w)) & fits(F.lead("p").over(w))).alias("peak")).groupBy(key).agg(F.count_if("peak").alias("peaks"))


def dataset_manifest(files: DataFrame, group: list[str]) -> DataFrame:
    """``group, files, bytes, distinct, first, last`` of files ``(group, content)``: how many different contents there are, by
    their SHA-256, and the least and the greatest of these."""
    each = files.select(*group, F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"), F.octet_length(F.coalesce("content", F.lit(""))).alias("size"))
    return each.groupBy(*group).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct("sha").alias("distinct"), F.min("sha").alias("first"), F.max("sha").alias("last"))


def clipped_by_lane(rows: DataFrame, key: str, lane: str, least: int) -> DataFrame:
    """``key, lane, id, at, end``: ends moved to the next start of the key in the same lane, ``least`` long at least."""
    following = F.lead("at").over(W.partitionBy(key, lane).orderBy("at", "id"))
    return rows.select(key, lane, "id", "at", F.greatest(F.col("at") + least, F.least(F.col("end"), F.coalesce(following, F.col("end")))).alias("end"))


def frame_targets(frames: DataFrame, regions: DataFrame, key: str, tolerance: int, width: int) -> DataFrame:
    """``key, point_id, root, quality, no_chord, boundary`` of frames ``(key, point_id, at)`` for training: root and class of
    quality (:data:`TARGETS`) of the region ``(key, start, end, idx, label)`` that holds the frame, -1
    for both without a chord, and how near the start of a region is, from 1 there to 0 at ``tolerance``. A key's first
    region begins no chord."""
    held = I.point_in_interval(frames, regions, key, width).select(key, "point_id", "at", "label")
    first = F.row_number().over(W.partitionBy(key).orderBy("start", "idx"))
    near = I.nearest(frames, regions.select(key, F.col("start").alias("at"), first.alias("k")).where("k > 1").select(key, "at"), key).select("point_id", "error")
    told = held.join(near, "point_id").withColumn("c", L.strict_once(F.col("label")))
    classes = F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])
    quality = F.when(F.col("c.root").isNotNull(), F.coalesce(F.try_element_at(classes, F.col("c.quality")), F.lit(0))).otherwise(-1)
    peak = F.greatest(F.lit(0.0), 1 - F.abs("error") / tolerance)
    return told.select(key, "point_id", F.coalesce("c.root", F.lit(-1)).cast("int").alias("root"), quality.cast("int").alias("quality"), F.col("c.root").isNull().alias("no_chord"), F.coalesce(peak, F.lit(0.0)).alias("boundary"))


def disagreements(windows: DataFrame, final: DataFrame, key: str, width: int, most: int = 200) -> DataFrame:
    """``key, id, start, end, rule, learned, final``: of windows ``(key, id, start, end, rule, learned)`` the first ``most`` of a
    key in which not all three labels agree; the final one is that of the region that holds the window's start, else the
    rule's. The limit is the report's."""
    points = windows.select(key, F.col("id").alias("point_id"), F.col("start").alias("at"))
    held = I.point_in_interval(points, final, key, width).select(key, F.col("point_id").alias("id"), F.col("label").alias("found"))
    told = windows.join(held, [key, "id"], "left").withColumn("final", F.coalesce("found", "rule"))
    apart = told.where(~(F.col("rule").eqNullSafe(F.col("learned")) & F.col("rule").eqNullSafe(F.col("final"))))
    ranked = apart.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy("start", "id")))
    return ranked.where(F.col("k") <= most).select(key, "id", "start", "end", "rule", "learned", "final")


def around_focus(windows: DataFrame, focus: DataFrame, key: str, reach: int, most: int = 12) -> DataFrame:
    """``key, id, start, end``: the first ``most`` windows of a key of which the middle lies within ``reach`` of its time in
    ``focus(key, at)``, one row a key."""
    near = windows.join(focus.select(key, "at"), key).where(F.abs(F.col("start") + F.col("end") - 2 * F.col("at")) <= 2 * reach)
    return near.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy("start", "id"))).where(F.col("k") <= most).select(key, "id", "start", "end")


def metric_changes(before: DataFrame, after: DataFrame, key: str, ignored: list[str]) -> DataFrame:
    """``key, name, before, after`` of the metrics ``(key, name, value)`` that differ between two reports or stand in one only,
    but for those that depend on the machine, such as run time and memory; empty for equal reports."""
    sides = [t.where(~F.col("name").isin(ignored)).select(key, "name", F.col("value").alias(v), F.lit(True).alias(f"has_{v}")) for t, v in ((before, "before"), (after, "after"))]
    both = sides[0].join(sides[1], [key, "name"], "full_outer")
    same = F.col("has_before").eqNullSafe(F.col("has_after")) & F.col("before").eqNullSafe(F.col("after"))
    return both.where(~same).select(key, "name", "before", "after")
