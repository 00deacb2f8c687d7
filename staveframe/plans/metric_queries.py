"""Queries on the accuracy of chord timelines, on joins of several timelines and on diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from staveframe.functions import labels as L
from staveframe.functions.scalars import count_texts as words_of
from staveframe.functions.scalars import half_up, stamp_problem
from staveframe.operators import fusion
from staveframe.operators import metrics as M
from staveframe.operators import tracks as T
from staveframe.plans.interval_queries import EVENTS_SQL
from staveframe.plans.roles import CHORDS, HOUR, chord_of, chord_timeline, notes, probes, table, timeline

WIDTH = 12 * HOUR
QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What the labels of the tables' chords mean, written out for SQL: root, family, symbol without bass, bass.
MEANS = {"C": (0, "0maj", "C", None), "Am": (9, "9min", "Am", None), "F": (5, "5maj", "F", None), "G7": (7, "7maj", "G7", None), "Dm": (2, "2min", "Dm", None), "Em7": (4, "4min", "Em7", None), "N": (None, "N", "N", None), "Bb": (10, "10maj", "A#", None),
         "Cmaj7": (0, "0maj", "Cmaj7", None), "E": (4, "4maj", "E", None), "A/C#": (9, "9maj", "A", 1), "Gm": (7, "7min", "Gm", None), "C7": (0, "0maj", "C7", None)}
_quoted = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
CHORD_SQL = EVENTS_SQL.rstrip() + f""",
ch(k, name, root, fam, sym, bass) AS (VALUES {', '.join(f"({k}, {', '.join(map(_quoted, (c, *MEANS[c])))})" for k, c in enumerate(CHORDS))}),
lc AS (SELECT l.user_id, l.id, l.s, l.t, ch.* FROM l JOIN e ON e.id = l.id JOIN ch ON ch.k = CAST(floor(e.score) AS BIGINT) % {len(CHORDS)}),
rc AS (SELECT r.user_id, r.id, r.s, r.t, ch.* FROM r JOIN e ON e.id = r.id JOIN ch ON ch.k = CAST(floor(e.score) AS BIGINT) % {len(CHORDS)})
"""
SEGMENTS_SQL = CHORD_SQL.rstrip() + """,
pt AS (SELECT user_id, s AS x FROM lc UNION SELECT user_id, t FROM lc UNION SELECT user_id, s FROM rc UNION SELECT user_id, t FROM rc),
sg AS (SELECT user_id, x AS a, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS b FROM pt),
js AS (SELECT sg.user_id, sg.a, sg.b, sg.b - sg.a AS d, lc.root AS rr, lc.fam AS rf, lc.sym AS rs, lc.bass AS rb, rc.root AS dr, coalesce(rc.fam, 'N') AS df, coalesce(rc.sym, 'N') AS ds, rc.bass AS db
    FROM sg JOIN lc ON lc.user_id = sg.user_id AND lc.s <= sg.a AND sg.a < lc.t LEFT JOIN rc ON rc.user_id = sg.user_id AND rc.s <= sg.a AND sg.a < rc.t WHERE sg.b IS NOT NULL)
"""


def query(sql: str):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _half_up(x: str, places: int = 4) -> str:
    return f"floor(({x}) * 1e{places}::DOUBLE + 0.5::DOUBLE) / 1e{places}::DOUBLE"


def _share(a: str, b: str) -> str:
    return _half_up(f"CASE WHEN coalesce({b}, 0) = 0 THEN 0::DOUBLE ELSE coalesce({a}, 0)::DOUBLE / ({b})::DOUBLE END")


@query(SEGMENTS_SQL + f"""
SELECT user_id, CAST(sum(d) AS BIGINT) AS total, {_share('sum(d) FILTER (rr IS NOT DISTINCT FROM dr)', 'sum(d)')} AS root, {_share('sum(d) FILTER (rf = df)', 'sum(d)')} AS family, {_share('sum(d) FILTER (rs = ds)', 'sum(d)')} AS detailed,
    {_share('sum(d) FILTER (rr IS NULL AND dr IS NULL)', 'sum(d) FILTER (dr IS NULL)')} AS none_precision, {_share('sum(d) FILTER (rr IS NULL AND dr IS NULL)', 'sum(d) FILTER (rr IS NULL)')} AS none_recall,
    {_share('sum(d) FILTER (rb IS NOT NULL AND rb IS NOT DISTINCT FROM db)', 'sum(d) FILTER (rb IS NOT NULL)')} AS inversion FROM js GROUP BY user_id
""")
def accuracy_report(spark, sf_dir):
    return M.accuracy_report(chord_timeline(spark, sf_dir, 0), chord_timeline(spark, sf_dir, 1), "user_id")


@query(SEGMENTS_SQL + "SELECT rs AS reference, ds AS detected, CAST(sum(d) AS BIGINT) AS seconds FROM js WHERE rs <> ds GROUP BY ALL")
def chord_confusion(spark, sf_dir):
    return M.confusion(chord_timeline(spark, sf_dir, 0), chord_timeline(spark, sf_dir, 1), "user_id")


@query(SEGMENTS_SQL.rstrip() + """,
m AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(rs) OVER w = rs AND lag(ds) OVER w = ds THEN 0 ELSE 1 END AS n FROM js WHERE rs <> ds WINDOW w AS (PARTITION BY user_id ORDER BY a)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a) AS k FROM m)
SELECT user_id, min(a) AS start, max(b) AS "end", any_value(rs) AS reference, any_value(ds) AS detected FROM g GROUP BY user_id, k
""")
def mismatch_runs(spark, sf_dir):
    return M.mismatch_runs(chord_timeline(spark, sf_dir, 0), chord_timeline(spark, sf_dir, 1), "user_id")


@query(EVENTS_SQL + f"""
, a AS (SELECT user_id, id, s AS x, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM l), b AS (SELECT user_id, s AS y, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM r),
n AS (SELECT a.user_id, a.id, arg_min(b.y - a.x, (abs(b.y - a.x), b.y)) AS e FROM a JOIN b ON a.user_id = b.user_id WHERE a.k > 1 AND b.k > 1 GROUP BY a.user_id, a.id)
SELECT user_id, count(*) AS n, {_half_up('avg(abs(e)::DOUBLE)', 3)} AS mean, {_half_up('median(abs(e)::DOUBLE)', 3)} AS median, {_half_up('avg(e::DOUBLE)', 3)} AS signed, count(*) FILTER (e < -{HOUR}) AS early, count(*) FILTER (e > {HOUR}) AS late FROM n GROUP BY user_id
""")
def boundary_report(spark, sf_dir):
    return M.boundary_report(timeline(spark, sf_dir, 0), timeline(spark, sf_dir, 1), "user_id", HOUR)


MIDDLE_SQL = CHORD_SQL.rstrip() + """,
w AS (SELECT user_id, id, s, t FROM lc WHERE id % 3 <> 1)
"""


@query(MIDDLE_SQL.rstrip() + f""",
m AS (SELECT w.user_id, w.id, coalesce(a.name, 'N') AS a, coalesce(b.name, 'N') AS b, coalesce(c.name, 'N') AS c FROM w LEFT JOIN rc a ON a.user_id = w.user_id AND 2 * a.s <= w.s + w.t AND w.s + w.t < 2 * a.t
    LEFT JOIN lc b ON b.user_id = w.user_id AND b.id % 4 = 0 AND 2 * b.s <= w.s + w.t AND w.s + w.t < 2 * b.t LEFT JOIN lc c ON c.user_id = w.user_id AND 2 * c.s <= w.s + w.t AND w.s + w.t < 2 * c.t)
SELECT user_id, count(*) AS windows, count(*) FILTER (a <> b) AS changed, count(*) FILTER (a <> b AND b = c) AS corrected, count(*) FILTER (a <> b AND a = c) AS spoiled, {_share('count(*) FILTER (a <> b)', 'count(*)')} AS share FROM m GROUP BY user_id
""")
def override_counts(spark, sf_dir):
    left, right = chord_timeline(spark, sf_dir, 0), chord_timeline(spark, sf_dir, 1)
    return M.overrides(left.where("id % 3 <> 1"), right, left.where("id % 4 = 0"), left, "user_id", WIDTH)


@query(CHORD_SQL.rstrip() + f""",
m AS (SELECT lc.user_id, lc.sym AS name, coalesce(rc.sym, 'N') AS found FROM lc LEFT JOIN rc ON rc.user_id = lc.user_id AND 2 * rc.s <= lc.s + lc.t AND lc.s + lc.t < 2 * rc.t WHERE lc.t - lc.s <= {WIDTH})
SELECT user_id, count(*) AS short, count(*) FILTER (found <> name) AS missed FROM m GROUP BY user_id
""")
def missed_short_chords(spark, sf_dir):
    """The detected side spells some chords in another way."""
    other = F.when(F.col("label") == "Bb", "A#").when(F.col("label") == "A/C#", "A").otherwise(F.col("label"))
    return M.missed_short(chord_timeline(spark, sf_dir, 0), chord_timeline(spark, sf_dir, 1).withColumn("label", other), "user_id", WIDTH, WIDTH)


@query(CHORD_SQL.rstrip() + f""",
w AS (SELECT l.user_id, l.id, l.s, l.t, CAST(floor(e.score * 3) AS BIGINT) % 12 AS bass, (e.score * 7) % 1 AS c FROM l JOIN e ON e.id = l.id),
m AS (SELECT w.user_id, least(w.t, rc.t) - greatest(w.s, rc.s) AS d, coalesce(w.bass = rc.root, false) AS ok, w.c >= 0.35 AS sure FROM w JOIN rc ON rc.user_id = w.user_id AND 2 * rc.s <= w.s + w.t AND w.s + w.t < 2 * rc.t)
SELECT user_id, {_share('sum(d) FILTER (ok)', 'sum(d)')} AS agreement, {_share('sum(d) FILTER (sure)', 'sum(d)')} AS coverage, {_share('sum(d) FILTER (sure AND ok)', 'sum(d) FILTER (sure)')} AS sure_agreement, {_share('sum(d) FILTER (sure AND NOT ok)', 'sum(d) FILTER (sure)')} AS conflict FROM m GROUP BY user_id
""")
def bass_evidence(spark, sf_dir):
    values = notes(spark, sf_dir).select("id", F.pmod(F.floor(F.col("score") * 3), F.lit(12)).alias("bass"), F.pmod(F.col("score") * 7, F.lit(1.0)).alias("confidence"))
    return M.bass_evidence(timeline(spark, sf_dir, 0).join(values, "id"), chord_timeline(spark, sf_dir, 1), "user_id", WIDTH)


@query(CHORD_SQL.rstrip() + """,
h AS (SELECT lc.user_id, lc.id, max_by(rc.name, rc.id) AS name FROM rc JOIN lc ON rc.user_id = lc.user_id AND 2 * lc.s <= rc.s + rc.t AND rc.s + rc.t < 2 * lc.t WHERE rc.id % 5 = 0 GROUP BY ALL)
SELECT lc.user_id, lc.id, lc.s AS start, lc.t AS "end", coalesce(h.name, lc.name) AS label, h.name IS NOT NULL AS locked FROM lc LEFT JOIN h USING (user_id, id)
""")
def locked_corrections(spark, sf_dir):
    """Every fifth chord of the other side as a correction by a user: what corrects is a choice of the data, not a limit."""
    return M.with_corrections(chord_timeline(spark, sf_dir, 0), chord_timeline(spark, sf_dir, 1).where("id % 5 = 0"), "user_id", WIDTH)


@query("""
WITH e AS (SELECT user_id, event_id AS id, epoch_us(ts) AS x FROM events), b AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY x) - 1 AS k FROM (SELECT DISTINCT user_id, x FROM e)),
z AS (SELECT user_id, max(k) AS top, max(x) AS fin FROM b GROUP BY user_id), c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY x, id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE id % 4 = 0)
SELECT c.user_id, c.place, s.x / 1e6::DOUBLE AS start, greatest(s.x / 1e6::DOUBLE + 0.05::DOUBLE, CASE WHEN c.place + 1 < c.n THEN t.x ELSE z.fin END / 1e6::DOUBLE) AS "end" FROM c JOIN z USING (user_id)
JOIN b s ON s.user_id = c.user_id AND s.k = least(c.place * 4, z.top) JOIN b t ON t.user_id = c.user_id AND t.k = least(c.place * 4 + 4, z.top)
""")
def beat_assignment(spark, sf_dir):
    """Every fourth event as a chord without a time, and all events as beats."""
    rows = notes(spark, sf_dir)
    chords = T.numbered(rows.where("id % 4 = 0"), "user_id").select("user_id", "place", F.lit(None).cast("double").alias("duration"))
    return M.on_beats(chords, rows.select("user_id", (F.col("at") / 1e6).alias("at")), "user_id")


@query(CHORD_SQL.rstrip() + f""",
k AS (SELECT e.id, ch.root, CASE ch.sym WHEN 'G7' THEN '7' WHEN 'C7' THEN '7' ELSE CASE WHEN ch.fam LIKE '%min' THEN 'min' ELSE 'maj' END END AS q, e.user_id % 12 AS tonic, e.user_id % 2 = 0 AS major, (e.score * 3) % 1 AS c, (ch.root - e.user_id % 12 + 12) % 12 AS d
    FROM e JOIN ch ON ch.k = CAST(floor(e.score) AS BIGINT) % {len(CHORDS)} WHERE ch.root IS NOT NULL),
t AS (SELECT *, CASE WHEN major THEN (q IN ('maj', '7') AND d IN (0, 5, 7)) OR (q = 'min' AND d IN (2, 4, 9)) ELSE (q = 'min' AND d IN (0, 5, 7)) OR (q IN ('maj', '7') AND d IN (3, 8, 10)) END AS triad,
    q = '7' AND CASE WHEN major THEN (d + 5) % 12 IN (0, 2, 4, 5, 7, 9, 11) ELSE (d + 5) % 12 IN (0, 2, 3, 5, 7, 8, 10) END AS dominant, CASE WHEN major THEN d IN (0, 2, 4, 5, 7, 9, 11) ELSE d IN (0, 2, 3, 5, 7, 8, 10) END AS inside FROM k)
SELECT id, {_half_up('CASE WHEN triad THEN c WHEN dominant THEN 0.45::DOUBLE * c WHEN inside THEN 0.12::DOUBLE * c ELSE -0.12::DOUBLE * c END', 9)} AS fit FROM t
""")
def key_fit(spark, sf_dir):
    rows = notes(spark, sf_dir).select("user_id", "id", "score", L.strict(chord_of(F.col("score"))).alias("c")).where(F.col("c.root").isNotNull())
    fit = M.key_compatibility(F.col("c.root"), F.col("c.quality"), F.col("user_id") % 12, F.when(F.col("user_id") % 2 == 0, "major").otherwise("minor"), F.pmod(F.col("score") * 3, F.lit(1.0)))
    return rows.select("id", half_up(fit, 9).alias("fit"))


@query("""
WITH o AS (SELECT o_orderpriority AS id, o_totalprice / 100000 AS a, o_custkey / 1000.0::DOUBLE AS b, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / (o_orderkey % 7) END AS c FROM orders)
""" + f"SELECT id, count(*) AS n, {_half_up('coalesce(avg(a), 0)')} AS a, {_half_up('coalesce(avg(b), 0)')} AS b, {_half_up('coalesce(avg(c), 0)')} AS c FROM o GROUP BY id")
def ablation_rollup(spark, sf_dir):
    """Orders as results of the configuration that their priority stands for; one metric isn't finite for some."""
    rows = table(spark, sf_dir, "orders")
    third = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice") / (F.col("o_orderkey") % 7)).otherwise(F.lit(float("nan")))
    return M.finite_means(rows.select(F.col("o_orderpriority").alias("id"), (F.col("o_totalprice") / 100000).alias("a"), (F.col("o_custkey") / 1000.0).alias("b"), third.alias("c")), ["id"], ["a", "b", "c"])


WEIGHT_SQL = """
WITH x AS (SELECT event_id AS id, event_id % 9 > 0 AS held, (value * 3) % 1 AS top, (value * 5) % 1 AS entropy, (value * 7) % 1 / 5 AS margin, (value * 11) % 1 AS c, event_id % 2 = 0 AS agrees, CASE event_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.65::DOUBLE ELSE 0.25::DOUBLE END AS flicker, event_id % 5 < 3 AS full_mix FROM events),
f AS (SELECT *, 1 - greatest(0, least(1, margin / 0.1::DOUBLE)) AS am, 1 - greatest(0, least(1, c / 0.72::DOUBLE)) AS ac FROM x), w0 AS (SELECT *, 0.35::DOUBLE AS w0, 0.675::DOUBLE + 0.325::DOUBLE * am AS bm, 0.35::DOUBLE + 0.65::DOUBLE * (am + ac) / 2 AS room FROM f),
w1 AS (SELECT *, CASE WHEN held THEN w0 ELSE 0 END AS w1 FROM w0), w2 AS (SELECT *, CASE WHEN top >= 0.6 THEN w1 ELSE 0 END AS w2 FROM w1), w3 AS (SELECT *, CASE WHEN entropy < 0.75 THEN w2 ELSE 0 END AS w3 FROM w2),
w4 AS (SELECT *, w3 * (0.35::DOUBLE + 0.65::DOUBLE * greatest(0, least(1, (top - 0.6::DOUBLE) / (1 - 0.6::DOUBLE)))) AS w4 FROM w3), w5 AS (SELECT *, w4 * greatest(0, least(1, (0.75::DOUBLE - entropy) / 0.75::DOUBLE)) AS w5 FROM w4), w6 AS (SELECT *, w5 * bm AS w6 FROM w5),
w7 AS (SELECT *, w6 * (room / bm) AS w7 FROM w6), w8 AS (SELECT *, w7 * CASE WHEN c <= 0.72 THEN 1 ELSE greatest(0, least(1, (0.9::DOUBLE - c) / (0.9::DOUBLE - 0.72::DOUBLE))) END AS w8 FROM w7), w9 AS (SELECT *, w8 * CASE WHEN agrees THEN 1.1::DOUBLE ELSE 1 END AS w9 FROM w8),
w10 AS (SELECT *, w9 * flicker AS w10 FROM w9), w11 AS (SELECT *, least(greatest(w10, 0), CASE WHEN full_mix THEN 0.3::DOUBLE ELSE 0.55::DOUBLE END) AS w11 FROM w10)
"""


def _weighed(spark, sf_dir):
    part = lambda k: F.pmod(F.col("value") * k, F.lit(1.0))
    i = F.col("event_id")
    stages = M.learned_weight((i % 9 > 0).cast("int"), part(3), part(5), part(7) / 5, part(11), i % 2 == 0, F.when(i % 3 == 0, 1.0).when(i % 3 == 1, 0.65).otherwise(0.25), i % 5 < 3)
    return table(spark, sf_dir, "events").select(i.alias("id"), stages.alias("stages")).withColumn("weight", F.element_at("stages", -1)["after"])


@query(WEIGHT_SQL + f"SELECT id, {_half_up('w11', 9)} AS weight FROM w11")
def learned_weights(spark, sf_dir):
    return _weighed(spark, sf_dir).select("id", half_up(F.col("weight"), 9).alias("weight"))


@query(WEIGHT_SQL.rstrip() + ", s AS (" + " UNION ALL ".join(f"SELECT '{name}' AS stage, w{k} AS b, w{k + 1} AS a FROM w11" for k, name in enumerate(M.STAGES)) + f""")
SELECT stage, count(*) FILTER (a < b - 1e-9) AS n, {_half_up('coalesce(avg(b) FILTER (a < b - 1e-9), 0)', 6)} AS before, {_half_up('coalesce(avg(a) FILTER (a < b - 1e-9), 0)', 6)} AS after FROM s GROUP BY stage""")
def gate_diagnostics(spark, sf_dir):
    return M.gate_diagnostics(_weighed(spark, sf_dir)).select("stage", "n", half_up(F.col("before"), 6).alias("before"), half_up(F.col("after"), 6).alias("after"))


@query(WEIGHT_SQL + "SELECT CASE WHEN w11 = 0 THEN 'zero' WHEN w11 < 0.05 THEN 'below-0.05' WHEN w11 < 0.15 THEN '0.05-to-0.15' WHEN w11 < 0.3 THEN '0.15-to-0.30' ELSE 'above-0.30' END AS bucket, count(*) AS n FROM w11 GROUP BY ALL")
def weight_buckets(spark, sf_dir):
    return M.weight_buckets(_weighed(spark, sf_dir))


@query(f"""
WITH p AS (SELECT l.doc_id, l.quality, l.toxic, least(1, n_chars / 6000.0::DOUBLE) AS c, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id), s AS (SELECT 'all' AS slice, * FROM p UNION ALL SELECT source, * FROM p UNION ALL SELECT CASE WHEN toxic = quality THEN 'agree' ELSE 'disagree' END, * FROM p)
SELECT slice, CAST(least(floor(c * 10), 9) AS INTEGER) AS bin, count(*) AS n, {_half_up('avg(c)', 6)} AS confidence, {_half_up('avg(quality)', 6)} AS accuracy FROM s GROUP BY 1, 2
""")
def calibration_slices(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.least(F.lit(1.0), F.col("n_chars") / 6000.0).alias("confidence"))
    points = table(spark, sf_dir, "labels").join(d, "doc_id").select("confidence", (F.col("quality") == 1).alias("right"), F.array(F.lit("all"), F.col("source"), F.when(F.col("toxic") == F.col("quality"), "agree").otherwise("disagree")).alias("slices"))
    return M.sliced_reliability(points).select("slice", "bin", "n", half_up(F.col("confidence"), 6).alias("confidence"), half_up(F.col("accuracy"), 6).alias("accuracy"))


@query(EVENTS_SQL + """
, a AS (SELECT user_id, label, s, t, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM l), b AS (SELECT user_id, label, s, CASE WHEN id % 3 = 0 THEN t + 1 ELSE t END AS t, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM l WHERE id % 10 > 0 OR user_id % 2 = 0)
SELECT coalesce(a.user_id, b.user_id) AS user_id, count(*) FILTER (a.label IS DISTINCT FROM b.label OR a.s IS DISTINCT FROM b.s OR a.t IS DISTINCT FROM b.t) AS changed FROM a FULL JOIN b ON a.user_id = b.user_id AND a.k = b.k GROUP BY 1
""")
def changed_regions(spark, sf_dir):
    t = timeline(spark, sf_dir, 0)
    other = t.where("id % 10 > 0 OR user_id % 2 = 0").withColumn("end", F.when(F.col("id") % 3 == 0, F.col("end") + 1).otherwise(F.col("end")))
    return M.changed_regions(t, other, "user_id")


@query(CHORD_SQL.rstrip() + f""",
m AS (SELECT user_id, name, t - s AS d, lag(name) OVER (PARTITION BY user_id ORDER BY s) AS was FROM lc)
SELECT user_id, count(*) AS regions, count(*) FILTER (name = 'N') AS silent, count(*) FILTER (was <> name) AS changes, {_half_up('avg(d)', 3)} AS mean FROM m GROUP BY user_id
""")
def region_diagnostics(spark, sf_dir):
    return M.region_diagnostics(chord_timeline(spark, sf_dir, 0), "user_id").withColumn("mean", half_up(F.col("mean"), 3))


@query(CHORD_SQL.rstrip() + f""",
fr AS (SELECT user_id, id, "at", list_transform(range(0, 12), lambda j: (id * (j + 3)) % 17) AS v FROM e WHERE id % 2 = 1),
ft AS (SELECT user_id, id, "at", list_position(v, list_max(v)) - 1 AS top FROM fr),
m AS (SELECT ft.user_id, lc.root, ft.top FROM ft LEFT JOIN lc ON lc.user_id = ft.user_id AND lc.s <= ft."at" AND ft."at" < lc.t)
SELECT user_id, count(root) AS scored, {_half_up('CASE WHEN count(root) = 0 THEN 0::DOUBLE ELSE (count(*) FILTER (root = top))::DOUBLE / count(root)::DOUBLE END', 6)} AS share FROM m GROUP BY user_id
""")
def frame_agreement(spark, sf_dir):
    """The other side's events as frames of bass bins, against the roots of the chords that they fall in."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.col("point_id") * (j + 3) % 17)
    return M.frame_agreement(probes(spark, sf_dir).withColumn("vector", vector), chord_timeline(spark, sf_dir, 0), "user_id", WIDTH)


@query("""
WITH n AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN ' é漢' WHEN 1 THEN ' ' || chr(128077) ELSE '' END AS name FROM part),
u AS (SELECT id, flatten(list_transform(string_split(name, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024]::BIGINT[] ELSE [unicode(c)]::BIGINT[] END)) AS cs FROM n)
SELECT id, lower(printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, cs), lambda h, c: (xor(h, c) * 16777619) % 4294967296))) AS hash FROM u
""")
def name_hashes(spark, sf_dir):
    """Hashes of names, some of which have characters beyond the first plane."""
    key = F.col("p_partkey")
    name = F.concat("p_name", F.when(key % 3 == 0, " é漢").when(key % 3 == 1, " \U0001f44d").otherwise(""))
    return table(spark, sf_dir, "part").select(key.alias("id"), M.fnv1a(name).alias("hash"))


@query("""
WITH p AS (SELECT user_id, event_id AS id, floor((value * 3) % 1 * 10) / 10 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
n AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b FROM p WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, count(*) FILTER (p > 0.5::DOUBLE AND (a IS NULL OR p >= a) AND (b IS NULL OR p >= b)) AS peaks FROM n GROUP BY user_id
""")
def probability_peaks(spark, sf_dir):
    """Probabilities in steps of a tenth, so that many neighbours are equal."""
    rows = T.numbered(notes(spark, sf_dir), "user_id").select("user_id", "place", (F.floor(F.pmod(F.col("score") * 3, F.lit(1.0)) * 10) / 10).alias("p"))
    return M.probability_peaks(rows, "user_id")


@query("""
WITH d AS (SELECT source, lang, sha256(coalesce(text, '')) AS sha, octet_length(encode(coalesce(text, ''))) AS size FROM documents)
SELECT source, lang, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT sha) AS "distinct", min(sha) AS first, max(sha) AS last FROM d GROUP BY source, lang
""")
def dataset_manifest(spark, sf_dir):
    return M.dataset_manifest(table(spark, sf_dir, "documents").select("source", "lang", F.col("text").alias("content")), ["source", "lang"])


@query("""
WITH r AS (SELECT p_partkey AS id, p_brand AS brand, p_retailprice AS price, CASE WHEN p_partkey % 100 <> 0 THEN row_number() OVER (PARTITION BY p_brand, p_partkey % 100 = 0 ORDER BY p_retailprice DESC, p_partkey) END AS k FROM part)
SELECT brand, id, price, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 4 OR id % 100 = 0
""")
def shortlist(spark, sf_dir):
    """A top-k report: all incumbents, and the four best of the other candidates of each group."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    return M.shortlist(rows, "brand", [F.desc("price"), F.col("id")], 4, F.col("id") % 100 == 0)


@query("""
WITH e AS (SELECT user_id, event_id AS id, event_type AS lane, epoch_us(ts) AS x, epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) AS t FROM events)
SELECT user_id, lane, id, x AS "at", greatest(x + 1000, least(t, coalesce(lead(x) OVER (PARTITION BY user_id, lane ORDER BY x, id), t))) AS "end" FROM e
""")
def string_sustain(spark, sf_dir):
    """Ends of notes moved to the next start on the same string; the event type stands for the string."""
    return M.clipped_by_lane(notes(spark, sf_dir).withColumnRenamed("label", "lane"), "user_id", "lane", 1000)


@query(EVENTS_SQL.rstrip() + f""",
fr AS (SELECT user_id, id, "at" AS s, "end" AS t, (id % 20)::DOUBLE / 100.0::DOUBLE AS lv, list_transform(range(0, 12), lambda j: ((id * (j + 3) + j) % 19)::DOUBLE * score) AS v FROM e WHERE id % 2 = 1),
pr AS (SELECT unnest([{', '.join(f"{{'k': {k}, 'd': {d}, 'w': {w / sum(values)!r}::DOUBLE}}" for k, values in enumerate((fusion.MAJOR, fusion.MINOR)) for d, w in enumerate(values))}], recursive := true)),
mt AS (SELECT l.user_id, l.id, fr.lv, fr.v FROM l JOIN fr ON fr.user_id = l.user_id AND fr.s < l.t + {8 * HOUR} AND fr.t > l.s - {8 * HOUR} UNION ALL SELECT user_id, NULL, lv, v FROM fr),
pk AS (SELECT *, max(lv) OVER (PARTITION BY user_id, id) AS pk FROM mt),
hd AS (SELECT user_id, id, lv, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS p FROM pk WHERE lv >= greatest(0.004::DOUBLE, 0.15::DOUBLE * pk) OR pk < 0.004::DOUBLE),
rb AS (SELECT user_id, id, p, 0.35::DOUBLE * median(x) + 0.65::DOUBLE * CASE WHEN sum(lv) > 0 THEN sum(x * lv) / sum(lv) ELSE avg(x) END AS x FROM hd GROUP BY ALL),
st AS (SELECT *, x / sum(x) OVER (PARTITION BY user_id, id) AS y, sum(x) OVER (PARTITION BY user_id, id) AS whole FROM rb),
sc AS (SELECT q.user_id, q.id, g.tonic, pr.k, sum(q.y * pr.w) AS s FROM st q, range(12) g(tonic), pr WHERE pr.d = (q.p - g.tonic + 12) % 12 AND q.whole > 0 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY s DESC, tonic, k) AS r FROM sc),
ky AS (SELECT user_id, id, max((['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[tonic + 1] || CASE WHEN k = 0 THEN ' major' ELSE ' minor' END) FILTER (r = 1) AS name, greatest(0, least(1, (max(s) FILTER (r = 1) - max(s) FILTER (r = 2)) / 0.018::DOUBLE)) AS confidence FROM rk GROUP BY user_id, id),
us AS (SELECT l.user_id, l.id, a.name, a.confidence, b.name AS all_name, b.confidence AS all_confidence, coalesce(a.name IS NOT NULL AND (b.name IS NULL OR a.confidence >= 0.25::DOUBLE), false) AS is_local FROM l LEFT JOIN ky a ON a.user_id = l.user_id AND a.id = l.id LEFT JOIN ky b ON b.user_id = l.user_id AND b.id IS NULL)
SELECT user_id, id, CASE WHEN is_local THEN name ELSE all_name END AS name, {_half_up('CASE WHEN is_local THEN confidence ELSE all_confidence END', 5)} AS confidence, is_local FROM us
""")
def local_keys(spark, sf_dir):
    """The key near each of a user's events on one side, of the other side's events as frames of pitch classes; a twentieth
    of the frames is silent."""
    rows = notes(spark, sf_dir).where("id % 2 = 1")
    vector = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: ((F.col("id") * (j + 3) + j) % 19).cast("double") * F.col("score"))
    frames = rows.select("user_id", "id", F.col("at").alias("start"), "end", vector.alias("vector"), (F.col("id") % 20 / F.lit(100.0)).alias("level"))
    return M.local_keys(timeline(spark, sf_dir, 0), frames, "user_id", 8 * HOUR, WIDTH).withColumn("confidence", half_up(F.col("confidence"), 5))


@query(CHORD_SQL.rstrip() + f""",
f AS (SELECT user_id, "at", list_transform(range(0, 12), lambda j: ((id * (j + 2) % 23) / 32.0::DOUBLE)) AS r, list_transform(range(0, 3), lambda j: ((id * (j + 5) % 11) / 16.0::DOUBLE)) AS q, (score * 3) % 1 AS b FROM e WHERE id % 2 = 1),
h AS (SELECT lc.user_id, lc.id, f.r, f.q FROM lc JOIN f ON f.user_id = lc.user_id AND lc.s <= f."at" AND f."at" < lc.t),
m AS (SELECT user_id, id, list_transform(range(1, 13), lambda j: list_avg(list_transform(rs, lambda x: x[j]))) AS r, list_transform(range(1, 4), lambda j: list_avg(list_transform(qs, lambda x: x[j]))) AS q FROM (SELECT user_id, id, list(r) AS rs, list(q) AS qs FROM h GROUP BY user_id, id)),
y AS (SELECT lc.user_id, lc.id, min(f."at") AS early FROM lc JOIN f ON f.user_id = lc.user_id AND lc.s - {6 * HOUR} <= f."at" AND f."at" < lc.s AND f.b > 0.6::DOUBLE GROUP BY lc.user_id, lc.id),
z AS (SELECT lc.user_id, lc.id, lc.s, lc.t, lc.name, ((e.score * 11) % 1) / 4 AS confidence, m.r, m.q, CASE WHEN m.r IS NOT NULL AND row_number() OVER (PARTITION BY lc.user_id ORDER BY lc.s, lc.id) > 1 THEN coalesce(y.early, lc.s) ELSE lc.s END AS moved
    FROM lc JOIN e ON e.id = lc.id LEFT JOIN m ON m.user_id = lc.user_id AND m.id = lc.id LEFT JOIN y ON y.user_id = lc.user_id AND y.id = lc.id),
w AS (SELECT *, coalesce(0.35::DOUBLE * (list_max(r) * list_max(q)) > confidence, false) AS learned, least(t, coalesce(lead(moved) OVER (PARTITION BY user_id ORDER BY s, id), t)) AS until FROM z)
SELECT user_id, id, moved AS start, until AS "end", CASE WHEN learned THEN (['C', 'C#', 'D', 'Eb', 'E', 'F', 'F#', 'G', 'Ab', 'A', 'Bb', 'B'])[list_position(r, list_max(r))] || (['', 'm', '7'])[list_position(q, list_max(q))] ELSE name END AS label, learned FROM w
""")
def fused_regions(spark, sf_dir):
    """One side's chords against the other side's events as frames of roots and qualities, dated back by up to six hours."""
    rows, i = notes(spark, sf_dir), F.col("id")
    regions = chord_timeline(spark, sf_dir, 0).join(rows.select("id", (F.pmod(F.col("score") * 11, F.lit(1.0)) / 4).alias("confidence")), "id")
    each = lambda n, a, m, of: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: i * (j + a) % m / F.lit(of))
    frames = rows.where("id % 2 = 1").select("user_id", "at", each(12, 2, 23, 32.0).alias("roots"), each(3, 5, 11, 16.0).alias("qualities"), F.pmod(F.col("score") * 3, F.lit(1.0)).alias("boundary"))
    return M.fused_regions(regions, frames, "user_id", WIDTH, 6 * HOUR)


@query(CHORD_SQL.rstrip() + f""",
b AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, id) AS k FROM lc), d AS (SELECT p.id, min(abs(b.s - p."at")) AS d FROM p JOIN b ON b.user_id = p.user_id AND b.k > 1 GROUP BY p.id)
SELECT p.user_id, p.id AS point_id, CAST(coalesce(lc.root, -1) AS INTEGER) AS root, CAST(CASE WHEN lc.root IS NULL THEN -1 WHEN lc.sym IN ('Am', 'Dm', 'Em7', 'Gm') THEN 1 WHEN lc.sym IN ('G7', 'C7') THEN 2 ELSE 0 END AS INTEGER) AS quality,
    lc.root IS NULL AS no_chord, {_half_up(f"coalesce(greatest(0, 1 - d.d::DOUBLE / {WIDTH}::DOUBLE), 0)")} AS boundary
FROM p LEFT JOIN lc ON lc.user_id = p.user_id AND lc.s <= p."at" AND p."at" < lc.t LEFT JOIN d ON d.id = p.id
""")
def frame_targets(spark, sf_dir):
    return M.frame_targets(probes(spark, sf_dir), chord_timeline(spark, sf_dir, 0), "user_id", WIDTH, WIDTH).withColumn("boundary", half_up(F.col("boundary")))


@query(CHORD_SQL.rstrip() + f""",
w AS (SELECT rc.user_id, rc.id, rc.s, rc.t, rc.name AS rule, ch.name AS learned, coalesce(lc.name, rc.name) AS final FROM rc JOIN e ON e.id = rc.id JOIN ch ON ch.k = CAST(floor(e.score * 3) AS BIGINT) % {len(CHORDS)} LEFT JOIN lc ON lc.user_id = rc.user_id AND lc.s <= rc.s AND rc.s < lc.t),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, id) AS k FROM w WHERE rule <> learned OR rule <> final)
SELECT user_id, id, s AS start, t AS "end", rule, learned, final FROM k WHERE k <= 10
""")
def disagreement_windows(spark, sf_dir):
    """A report of the first ten windows of each user."""
    learned = notes(spark, sf_dir).select("id", chord_of(F.col("score") * 3).alias("learned"))
    windows = chord_timeline(spark, sf_dir, 1).withColumnRenamed("label", "rule").join(learned, "id")
    return M.disagreements(windows, chord_timeline(spark, sf_dir, 0), "user_id", WIDTH, 10)


@query(EVENTS_SQL.rstrip() + """,
f AS (SELECT user_id, min("at") + (max("at") - min("at")) // 2 AS x FROM e GROUP BY user_id),
k AS (SELECT l.*, row_number() OVER (PARTITION BY l.user_id ORDER BY l.s, l.id) AS k FROM l JOIN f USING (user_id) WHERE abs(l.s + l.t - 2 * f.x) <= 2 * 172800000000)
SELECT user_id, id, s AS start, t AS "end" FROM k WHERE k <= 12
""")
def focus_windows(spark, sf_dir):
    """A report of the first twelve windows near the middle of each user's time."""
    focus = notes(spark, sf_dir).groupBy("user_id").agg((F.min("at") + F.floor((F.max("at") - F.min("at")) / 2)).alias("at"))
    return M.around_focus(timeline(spark, sf_dir, 0), focus, "user_id", 48 * HOUR)


@query("""
WITH m AS (SELECT l_returnflag AS engine, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS quantity, CAST(sum(CAST(l_quantity AS BIGINT) + CASE WHEN l_returnflag < 'N' AND l_linenumber = 7 THEN 1 ELSE 0 END) AS DOUBLE) AS later FROM lineitem GROUP BY 1)
SELECT engine, 'quantity' AS name, quantity AS before, later AS after FROM m WHERE quantity <> later UNION ALL SELECT engine, 'lines', n, NULL FROM m WHERE engine = 'R'
""")
def metric_changes(spark, sf_dir):
    """Two reports on lineitems by return flag, of which the later counts some quantities one higher, lacks a metric and took
    another time."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("engine"), F.col("l_quantity").cast("long").alias("q"), ((F.col("l_returnflag") < "N") & (F.col("l_linenumber") == 7)).cast("long").alias("more"))
    sums = li.groupBy("engine").agg(F.count("*").cast("double").alias("lines"), F.sum("q").cast("double").alias("quantity"), F.sum(F.col("q") + F.col("more")).cast("double").alias("later"), F.max("q").cast("double").alias("seconds"))
    named = lambda pairs: sums.select("engine", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])).alias("m")).select("engine", "m.*")
    before = named([("lines", F.col("lines")), ("quantity", F.col("quantity")), ("runtime", F.col("seconds"))])
    after = named([("lines", F.col("lines")), ("quantity", F.col("later")), ("runtime", F.col("seconds") + 1)])
    return M.metric_changes(before, after.where("NOT (name = 'lines' AND engine = 'R')"), "engine", ["runtime", "memory"])


@query("""
WITH c AS (SELECT p_partkey AS id, (['C','c','D#','E♭','F♯','H','n',' G '])[p_size % 8 + 1] || (['','m','7','maj7','m7','dim','sus4','add9','m9','/E'])[p_partkey % 10 + 1] AS text FROM part),
t AS (SELECT id, text, replace(replace(trim(text), '♯', '#'), '♭', 'b') AS x FROM c)
SELECT id, text, CASE WHEN upper(x) = 'N' THEN 'N' WHEN regexp_full_match(x, '[A-G](#|b)?(maj7|m7|sus2|sus4|add9|dim|aug|m|7)?') THEN x END AS label FROM t
""")
def manual_labels(spark, sf_dir):
    roots, forms = (F.array(*[F.lit(x) for x in xs]) for xs in (("C", "c", "D#", "E♭", "F♯", "H", "n", " G "), ("", "m", "7", "maj7", "m7", "dim", "sus4", "add9", "m9", "/E")))
    text = F.concat(F.element_at(roots, (F.col("p_size") % 8 + 1).cast("int")), F.element_at(forms, (F.col("p_partkey") % 10 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")).withColumn("label", L.manual(F.col("text")))


@query("""
WITH m AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 5 > 1 THEN 'v2' END AS schema, CASE WHEN event_id % 7 = 0 THEN 'v1' ELSE 'v3' END AS pipeline, CASE WHEN event_id % 11 = 0 THEN 'soon' WHEN event_id % 13 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS created FROM events)
SELECT id, CASE WHEN schema IS DISTINCT FROM 'v2' THEN 'schema ' || coalesce(schema, 'missing') || ' does not match v2' WHEN pipeline <> 'v3' THEN 'pipeline ' || pipeline || ' does not match v3' WHEN created IS NULL OR created = 'soon' THEN 'createdAt is missing or invalid' END AS reason FROM m
""")
def stamp_check(spark, sf_dir):
    """Events as stored metadata, of which some have another version, or a time of creation that is missing or no time."""
    n = F.col("event_id")
    created = F.when(n % 11 == 0, "soon").when(n % 13 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = table(spark, sf_dir, "events").select(n.alias("id"), F.when(n % 5 == 0, F.col("event_type")).when(n % 5 > 1, "v2").alias("schema"), F.when(n % 7 == 0, "v1").otherwise("v3").alias("pipeline"), created.alias("created"))
    return rows.select("id", stamp_problem({"schema": (F.col("schema"), "v2"), "pipeline": (F.col("pipeline"), "v3")}, F.col("created")).alias("reason"))


@query("""
WITH c AS (SELECT user_id, count(*) AS a, count(*) FILTER (value > 20) AS b, count(DISTINCT event_type) AS d FROM events GROUP BY user_id)
SELECT user_id, 'Final arrangement: ' || b || ' notes' AS main, 'Raw detections: ' || a AS raw, 'After cleanup: ' || b AS cleaned, 'Chord regions: ' || d AS chords FROM c
""")
def count_texts(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("a"), F.count_if(F.col("value") > 20).alias("b"), F.count_distinct("event_type").alias("d"))
    return sums.select("user_id", *words_of({"main": F.col("b"), "raw": F.col("a"), "cleaned": F.col("b"), "chords": F.col("d")}))
