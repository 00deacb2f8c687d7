"""Queries on timelines and ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from staveframe.functions.scalars import half_up, safe_div
from staveframe.operators import intervals as I
from staveframe.operators import sequences as S
from staveframe.plans.roles import HOUR, notes, probes, timeline

WIDTH = 12 * HOUR

EVENTS_SQL = """
WITH e AS (SELECT event_id AS id, user_id, event_type AS label, value AS score, epoch_us(ts) AS "at",
        epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) AS "end" FROM events),
tl AS (SELECT user_id, id, label, "at" AS s, lead("at") OVER (PARTITION BY user_id, id % 2 ORDER BY "at", id) AS t FROM e),
l AS (SELECT * FROM tl WHERE id % 2 = 0 AND t > s), r AS (SELECT * FROM tl WHERE id % 2 = 1 AND t > s),
p AS (SELECT user_id, id, "at" FROM e WHERE id % 2 = 1)
"""
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with the SQL that gives the same rows (after the tables above, unless it has its own)."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.startswith("WITH") else EVENTS_SQL + sql
        return f

    return put


@query("""
, pt AS (SELECT user_id, s AS x FROM l UNION SELECT user_id, t FROM l UNION SELECT user_id, s FROM r UNION SELECT user_id, t FROM r),
sg AS (SELECT user_id, x AS a, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS b FROM pt),
jn AS (SELECT sg.user_id, sg.b - sg.a AS d, l.label AS ll, r.label AS rl FROM sg JOIN l ON l.user_id = sg.user_id AND l.s <= sg.a AND sg.a < l.t
    LEFT JOIN r ON r.user_id = sg.user_id AND r.s <= sg.a AND sg.a < r.t WHERE sg.b IS NOT NULL)
SELECT user_id, CAST(sum(d) AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN ll = rl THEN d END), 0) AS BIGINT) AS agreed,
    CAST(coalesce(sum(CASE WHEN rl IS NULL THEN d END), 0) AS BIGINT) AS missing,
    floor(coalesce(sum(CASE WHEN ll = rl THEN d END), 0)::DOUBLE / sum(d)::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS accuracy
FROM jn GROUP BY user_id
""".strip())
def temporal_alignment(spark, sf_dir):
    found = I.agreement(I.aligned_segments(timeline(spark, sf_dir, 0), timeline(spark, sf_dir, 1), "user_id"), "user_id")
    return found.withColumn("accuracy", half_up(safe_div(F.col("agreed").cast("double"), F.col("total").cast("double"))))


@query("""
SELECT p.user_id, p.id AS point_id, p."at", min_by(l.label, l.id) AS label FROM p LEFT JOIN l ON l.user_id = p.user_id AND l.s <= p."at" AND p."at" < l.t GROUP BY ALL
""".strip())
def point_in_interval(spark, sf_dir):
    return I.point_in_interval(probes(spark, sf_dir), timeline(spark, sf_dir, 0), "user_id", WIDTH)


@query("""
, z AS (SELECT user_id, max(t) AS z FROM l GROUP BY user_id), q AS (SELECT user_id, t AS "at", id FROM l)
SELECT q.user_id, q.id AS point_id, q."at", min_by(l.label, l.id) AS label FROM q JOIN z USING (user_id)
    LEFT JOIN l ON l.user_id = q.user_id AND l.s <= q."at" AND (q."at" < l.t OR (q."at" = l.t AND l.t = z.z)) GROUP BY ALL
""".strip())
def point_in_interval_closed(spark, sf_dir):
    left = timeline(spark, sf_dir, 0)
    return I.point_in_interval(left.select("user_id", F.col("id").alias("point_id"), F.col("end").alias("at")), left, "user_id", WIDTH, closed_last=True)


@query("""
, m AS (SELECT user_id, id, "at" FROM e WHERE id % 2 = 0),
n AS (SELECT p.user_id, p.id, p."at", arg_min(m."at", (abs(m."at" - p."at"), m."at")) AS nearest FROM p LEFT JOIN m ON m.user_id = p.user_id GROUP BY ALL)
SELECT user_id, id AS point_id, "at", nearest, nearest - "at" AS error FROM n
""".strip())
def nearest_boundary(spark, sf_dir):
    marks = notes(spark, sf_dir).where("id % 2 = 0").select("user_id", "at")
    return I.nearest(probes(spark, sf_dir), marks, "user_id")


@query("""
, h AS (SELECT p.user_id, p.id, p."at", min_by(l.label, l.id) AS label FROM p LEFT JOIN l ON l.user_id = p.user_id AND l.s <= p."at" AND p."at" < l.t GROUP BY ALL),
n AS (SELECT p.id, arg_min(l.label, (abs(l.s + l.t - 2 * p."at"), l.s + l.t, l.id)) AS label FROM p JOIN l ON l.user_id = p.user_id GROUP BY ALL)
SELECT h.user_id, h.id AS point_id, h."at", coalesce(h.label, n.label) AS label FROM h LEFT JOIN n USING (id)
""".strip())
def containing_else_nearest(spark, sf_dir):
    return I.holding_or_nearest(probes(spark, sf_dir), timeline(spark, sf_dir, 0), "user_id", WIDTH)


@query("""
SELECT l.user_id, l.id, count(r.id) AS n FROM l LEFT JOIN r ON r.user_id = l.user_id AND l.s < r.t AND l.t > r.s GROUP BY ALL
""".strip())
def overlap_fragmentation(spark, sf_dir):
    return I.overlap_counts(timeline(spark, sf_dir, 0), timeline(spark, sf_dir, 1), "user_id", WIDTH)


@query("""
SELECT p.user_id, p.id AS point_id, p."at", max(l.id) FILTER (l.s <= p."at" AND p."at" < l.t) AS current, arg_min(l.id, l.s) FILTER (l.s > p."at") AS following,
    floor(coalesce(max((p."at" - l.s)::DOUBLE / (l.t - l.s)::DOUBLE) FILTER (l.s <= p."at" AND p."at" < l.t), 0) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS progress
FROM p LEFT JOIN l ON l.user_id = p.user_id GROUP BY ALL
""".strip())
def playback_state(spark, sf_dir):
    return I.playback_state(probes(spark, sf_dir), timeline(spark, sf_dir, 0), "user_id").withColumn("progress", half_up(F.col("progress")))


@query("""
, x AS (SELECT user_id, "at" AS t, 1 AS d FROM e UNION ALL SELECT user_id, "end", -1 FROM e), y AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM x)
SELECT user_id, CAST(greatest(max(n), 0) AS BIGINT) AS most FROM y GROUP BY user_id
""".strip())
def max_overlap(spark, sf_dir):
    longer = notes(spark, sf_dir).select("user_id", F.col("at").alias("start"), "end")
    return I.max_overlap(longer, "user_id")


@query("""
, f AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER w AND lag(id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY "at", id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY "at", id) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, min("at") AS start, max("end") AS "end", min(label) AS label, count(*) AS n, floor(avg(score) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score FROM g GROUP BY user_id, island
""".strip())
def run_length_regions(spark, sf_dir):
    return S.label_runs(notes(spark, sf_dir), "user_id").withColumn("score", half_up(F.col("score")))


@query("""
, f AS (SELECT *, CASE WHEN "at" - lag("at") OVER w <= 21600000000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY "at", id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY "at", id) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, min("at") AS start, max("at") AS "end", count(*) AS n, floor(avg(score) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS level FROM g GROUP BY user_id, island
""".strip())
def lag_gap_groups(spark, sf_dir):
    return S.lag_gap_groups(notes(spark, sf_dir).withColumn("level", F.col("score")), "user_id", 6 * HOUR).withColumn("level", half_up(F.col("level")))


@query("""
, k AS (SELECT *, "at" + 720 * ("end" - "at") AS z FROM e),
f AS (SELECT *, CASE WHEN "at" - max(z) OVER (PARTITION BY user_id ORDER BY "at", z, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3600000000 THEN 0 ELSE 1 END AS b FROM k),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY "at", z, id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, min("at") AS start, max(z) AS "end", count(*) AS n FROM g GROUP BY user_id, island
""".strip())
def gap_merge(spark, sf_dir):
    long = notes(spark, sf_dir).withColumn("end", F.col("at") + 720 * (F.col("end") - F.col("at")))
    return S.gap_merge(long, "user_id", HOUR).drop("score")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id AS id, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
c AS (SELECT user_id, id, "at", k, "at" AS anchor FROM o WHERE k = 1
    UNION ALL SELECT o.user_id, o.id, o."at", o.k, CASE WHEN o."at" - c.anchor > 28800000000 THEN o."at" ELSE c.anchor END FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1)
SELECT user_id, id, "at", anchor FROM c
""".strip())
def anchored_clusters(spark, sf_dir):
    return S.anchored_clusters(notes(spark, sf_dir).select("user_id", "id", "at"), "user_id", 8 * HOUR)


@query("""
, c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN 43200000000 PRECEDING AND 43200000000 FOLLOWING) AS near FROM e)
SELECT user_id, id, score, near FROM c WHERE score >= least(60.0::DOUBLE, 5.0::DOUBLE + 0.025::DOUBLE * greatest(0, near - 2))
""".strip())
def density_filter(spark, sf_dir):
    return S.density_filter(notes(spark, sf_dir), "user_id", 12 * HOUR, 2.0, 5.0, 60.0).select("user_id", "id", "score", "near")


@query("""
SELECT user_id, id, "at" FROM e WHERE EXISTS (SELECT 1 FROM e o WHERE o.user_id = e.user_id AND o.id <> e.id AND abs(o."at" - e."at") <= 7200000000 AND abs(o.score - e.score) <= 20 AND o.score >= 10)
""".strip())
def neighbour_semi_join(spark, sf_dir):
    return S.with_neighbour(notes(spark, sf_dir).withColumn("level", F.col("score")), "user_id", 2 * HOUR, 20.0, 10.0).select("user_id", "id", "at")


@query("""
, v AS (SELECT user_id, id, CAST(floor(score) AS BIGINT) AS level, score, "at" // 86400000000 AS day FROM e)
SELECT user_id, day, id FROM v WHERE NOT EXISTS (SELECT 1 FROM v s WHERE s.user_id = v.user_id AND s.day = v.day AND s.id <> v.id AND abs(s.level - v.level) IN (12, 24) AND v.score < 0.8::DOUBLE * s.score AND v.score < 60)
""".strip())
def ghost_anti_join(spark, sf_dir):
    rows = notes(spark, sf_dir).select("user_id", "id", F.floor("score").alias("level"), "score", F.floor(F.col("at") / (24 * HOUR)).alias("day"))
    return S.without_ghosts(rows, ["user_id", "day"], (12, 24), 0.8, 60.0).select("user_id", "day", "id")


@query("""
, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", id) AS k FROM e),
v AS (SELECT a.user_id, a.id, b.label, count(*) AS n, max(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) AS own, sum(b.score) AS s, avg(b.score) AS m FROM o a JOIN o b ON a.user_id = b.user_id AND abs(a.k - b.k) <= 1 GROUP BY ALL)
SELECT user_id, id, label, floor(m * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, own DESC, s DESC, label) AS r FROM v) WHERE r = 1
""".strip())
def mode_filter(spark, sf_dir):
    return S.mode_filter(notes(spark, sf_dir), "user_id", 1).withColumn("score", half_up(F.col("score")))


@query("""
SELECT user_id, id, "at" FROM (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY "at", id) AS was FROM e) WHERE was <> label
""".strip())
def change_points(spark, sf_dir):
    return S.change_points(notes(spark, sf_dir), "user_id")


@query("""
, k AS (SELECT *, "at" + 720 * ("end" - "at") AS z FROM e)
SELECT user_id, id, "at", greatest("at" + 20000, least(z, coalesce(lead("at") OVER (PARTITION BY user_id ORDER BY "at", id), z))) AS "end" FROM k
""".strip())
def clip_at_next(spark, sf_dir):
    long = notes(spark, sf_dir).withColumn("end", F.col("at") + 720 * (F.col("end") - F.col("at")))
    return S.clipped_at_next(long, "user_id", 20_000)


@query("""
, f AS (SELECT *, lag(label) OVER w AS a, lead(label) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY "at", id)),
g AS (SELECT *, (CASE WHEN label <> a THEN 1 ELSE 0 END) + (CASE WHEN label <> b THEN 1 ELSE 0 END) AS d FROM f)
SELECT user_id, id, CAST(CASE WHEN label IS NULL THEN 0 WHEN d = 0 THEN 1 WHEN d = 1 THEN 0.65 ELSE 0.25 END AS DOUBLE) AS factor FROM g
""".strip())
def flicker_factor(spark, sf_dir):
    return S.flicker_factor(notes(spark, sf_dir), "user_id")


@query("""
, g AS (SELECT user_id, s, t, label, lag(label) OVER w AS a, lead(label) OVER w AS b FROM l WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT user_id, count(*) FILTER (a = b AND a <> label AND t - s < 86400000000) AS n FROM g GROUP BY user_id
""".strip())
def flicker_counts(spark, sf_dir):
    return S.flickers(timeline(spark, sf_dir, 0), "user_id", 24 * HOUR)


@query("""
, f AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER w AND lag(id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY "at", id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY "at", id) AS island FROM f),
h AS (SELECT user_id, island, min(label) AS label, count(*) AS n FROM g GROUP BY ALL),
m AS (SELECT a.user_id, a.island, coalesce(median(b.n) FILTER (b.label <> 'error'), 0) AS m FROM h a JOIN h b ON a.user_id = b.user_id AND abs(a.island - b.island) <= 2 GROUP BY ALL)
SELECT user_id, CAST(island AS BIGINT) AS island, CASE WHEN m <= 1.5 THEN 1 WHEN m <= 3 THEN 2 ELSE 4 END AS windows FROM m
""".strip())
def local_run_length(spark, sf_dir):
    return S.local_run_length(S.label_runs(notes(spark, sf_dir), "user_id"), "user_id", "error")


@query("""
, b AS (SELECT user_id, "at" // 86400000000 AS bar, CAST(least(15, floor(("at" % 86400000000) * 16 / 86400000000.0::DOUBLE + 0.5::DOUBLE)) AS INTEGER) AS slot, label AS lane, id, score, "at" FROM e),
m AS (SELECT user_id, bar, slot, lane, arg_min(id, (-score, "at", id)) AS id FROM b GROUP BY ALL),
f AS (SELECT user_id, bar, slot, coalesce(lead(slot) OVER (PARTITION BY user_id, bar ORDER BY slot), 16) - slot AS span FROM (SELECT DISTINCT user_id, bar, slot FROM m))
SELECT user_id, bar, slot, lane, id, span FROM m JOIN f USING (user_id, bar, slot)
""".strip())
def grid_bucket_best(spark, sf_dir):
    return S.grid_best(notes(spark, sf_dir).withColumn("lane", F.col("label")), "user_id", 24 * HOUR)


@query("""
, k AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY "at", id) AS place, CASE WHEN id % 5 <> 0 THEN score END AS v FROM e),
n AS (SELECT k.*, (SELECT max(place) FROM k j WHERE j.user_id = k.user_id AND j.place <= k.place AND j.v IS NOT NULL) AS a, (SELECT min(place) FROM k j WHERE j.user_id = k.user_id AND j.place >= k.place AND j.v IS NOT NULL) AS b FROM k),
j AS (SELECT n.user_id, n.id, n.place, n.a, n.b, x.v AS va, y.v AS vb FROM n LEFT JOIN k x ON x.user_id = n.user_id AND x.place = n.a LEFT JOIN k y ON y.user_id = n.user_id AND y.place = n.b)
SELECT user_id, id, floor(CASE WHEN a = b THEN va WHEN va IS NULL THEN vb - 1.0::DOUBLE * (b - place) WHEN vb IS NULL THEN va + 1.0::DOUBLE * (place - a)
    ELSE va + (vb - va) * ((place - a)::DOUBLE / (b - a)::DOUBLE) END * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS value FROM j
""".strip())
def gap_interpolation(spark, sf_dir):
    from staveframe.operators.tracks import numbered

    rows = numbered(notes(spark, sf_dir), "user_id").withColumn("value", F.when(F.col("id") % 5 != 0, F.col("score")))
    return S.gaps_filled(rows, "user_id", 1.0).withColumn("value", half_up(F.col("value")))


@query("""
, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", id) - 1 AS place FROM e)
SELECT user_id, place // 16 AS chunk, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 4
""".strip())
def fixed_chunks(spark, sf_dir):
    from staveframe.operators.tracks import numbered

    return S.chunks_of(numbered(notes(spark, sf_dir), "user_id"), "user_id", 16)


@query("""
, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", id) - 1 AS place FROM e)
SELECT user_id, id, place FROM k WHERE place % 7 = 0 AND place < 7 * 5
""".strip())
def stride_sampling(spark, sf_dir):
    return S.stride_sample(notes(spark, sf_dir), "user_id", 7, 5).select("user_id", "id", F.col("place").cast("long").alias("place"))


@query("""
SELECT user_id, label, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY "at", id) AS k FROM e) WHERE k = 1
""".strip())
def first_per_category(spark, sf_dir):
    return S.first_per(notes(spark, sf_dir), ["user_id", "label"], [F.col("at"), F.col("id")]).select("user_id", "label", "id")


@query("""
, s AS (SELECT user_id, ("at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at"))::DOUBLE / 1000000.0::DOUBLE AS d FROM e)
SELECT user_id, floor(60.0::DOUBLE / median(d) FILTER (d > 0) * 100000000.0::DOUBLE + 0.5::DOUBLE) / 100000000.0::DOUBLE AS bpm FROM s GROUP BY user_id
""".strip())
def tempo_from_beats(spark, sf_dir):
    from staveframe.operators.scores import tempo

    beats = notes(spark, sf_dir).select("user_id", (F.col("at") / 1_000_000).alias("at"))
    return tempo(beats, "user_id").withColumn("bpm", half_up(F.col("bpm"), 8))


@query("""
, a AS (SELECT user_id, list(DISTINCT label) AS x FROM l GROUP BY user_id), b AS (SELECT user_id, list(DISTINCT label) AS y FROM r GROUP BY user_id)
SELECT user_id, floor(coalesce(len(list_intersect(x, y)), 0)::DOUBLE / len(x)::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS recall FROM a LEFT JOIN b USING (user_id)
""".strip())
def label_recall(spark, sf_dir):
    from staveframe.operators.scores import label_recall as recall

    return recall(timeline(spark, sf_dir, 0), timeline(spark, sf_dir, 1), "user_id").withColumn("recall", half_up(F.col("recall")))


@query("""
, m AS (SELECT user_id, "at" FROM e WHERE id % 2 = 0), d AS (SELECT p.user_id, p.id, min(abs(m."at" - p."at")) AS d FROM p LEFT JOIN m ON m.user_id = p.user_id GROUP BY ALL)
SELECT user_id, floor(count(*) FILTER (d <= 14400000000)::DOUBLE / count(*)::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS share FROM d GROUP BY user_id
""".strip())
def share_within(spark, sf_dir):
    from staveframe.operators.scores import share_within as share

    errors = nearest_boundary(spark, sf_dir).select("user_id", F.coalesce(F.col("error").cast("double"), F.lit(float("inf"))).alias("error"))
    return share(errors, "user_id", 4.0 * HOUR).withColumn("share", half_up(F.col("share")))


@query("""
, w AS (SELECT user_id, id, s, t FROM l), f AS (SELECT user_id, "at", score FROM e)
SELECT w.user_id, w.id, count(*) AS n, max(f.score) AS peak, floor(avg(f.score) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS mean FROM w JOIN f ON f.user_id = w.user_id AND w.s <= f."at" AND f."at" < w.t GROUP BY ALL
""".strip())
def frame_windows(spark, sf_dir):
    frames = notes(spark, sf_dir).select("user_id", "at", F.array("score").alias("vector"), F.col("score").alias("peak"))
    return I.window_frames(frames, timeline(spark, sf_dir, 0), "user_id", WIDTH).select("user_id", "id", "n", "peak", half_up(F.col("mean")[0]).alias("mean"))
