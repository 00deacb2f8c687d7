"""Queries on notes, keys, labels in pairs, and the stream extensions applied to a bounded table."""

from __future__ import annotations

from pyspark.sql import functions as F

from staveframe.functions import labels as L
from staveframe.functions import scalars as X
from staveframe.operators import fusion, notes
from staveframe.plans.roles import table, track_notes
from staveframe.plans.table_queries import CHORDS_SQL, V_SQL, _chords, _vectors, half_up_sql
from staveframe.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("")
def note_cleanup(spark, sf_dir):
    return notes.cleaned(track_notes(spark, sf_dir))


@query("")
def note_diagnostics(spark, sf_dir):
    clean = notes.cleaned(track_notes(spark, sf_dir))
    seconds = track_notes(spark, sf_dir).groupBy(F.col("track").cast("string").alias("track")).agg(F.max("end").alias("seconds"))
    return notes.diagnostics(clean, seconds)


@query(f"""
WITH n AS (SELECT user_id AS track, CAST(floor(value) AS BIGINT) % 49 + 40 AS midi, greatest(0.05::DOUBLE, value / 200) * greatest(0.1::DOUBLE, (value * 7) % 1) AS w FROM events),
s(k, name, tuning, capo) AS (VALUES {', '.join(f"({k}, '{name}', {list(tuning)}, {capo})" for k, (name, tuning, capo) in enumerate(notes.SETUPS))}),
f AS (SELECT track, midi, w, k, name, capo, list_min(list_filter(list_transform(tuning, lambda o: midi - o - capo), lambda x: x BETWEEN 0 AND 20)) AS low, list_contains(tuning, midi - capo) AS open FROM n, s),
v AS (SELECT track, k, name, sum(CASE WHEN low IS NULL THEN -8 * w ELSE w * (2 - 0.06::DOUBLE * low) + CASE WHEN open THEN 2.4::DOUBLE * w ELSE 0 END END) - 0.2::DOUBLE * max(capo) AS v, count(DISTINCT midi) FILTER (open AND low IS NOT NULL) AS o FROM f GROUP BY ALL),
b AS (SELECT track, max(v) FILTER (k = 0) AS v0, arg_min({{'name': name, 'v': v, 'o': o}}, (-v, k)) FILTER (k > 0) AS b FROM v GROUP BY track)
SELECT track, CASE WHEN b.o >= 2 AND b.v > 1.12::DOUBLE * v0 THEN b.name ELSE 'Standard' END AS setup FROM b
""")
def setup_estimate(spark, sf_dir):
    return notes.setup_estimate(track_notes(spark, sf_dir))


@query(CHORDS_SQL + """
, k AS (SELECT id, r IN ('N', '') AS none, p IS NOT NULL AND q <> '?' AS ok, p, q, CASE WHEN q = 'min' THEN 'm' ELSE q END AS f, CASE WHEN b <> '' AND p <> 7 THEN '/G' ELSE '' END AS low FROM x),
y AS (SELECT id, CASE WHEN none THEN 'N' ELSE p || f || low END AS symbol, CASE WHEN NOT none THEN p END AS root, NOT none AND f IN ('m', 'm7', 'dim') AS mi, NOT none AND f IN ('7', 'maj7', 'm7') AS more FROM k WHERE none OR ok),
j AS (SELECT c.id, c.symbol AS rs, d.symbol AS ds, c.root AS rr, d.root AS dr, c.mi AS rm, d.mi AS dm, c.more AS re, d.more AS de, (d.root - c.root + 12) % 12 AS dist, c.id % 3 = 0 AND c.root IS NOT NULL AS heard FROM y c JOIN y d ON d.id = c.id + 1)
SELECT CASE WHEN rs = ds THEN NULL WHEN rr IS NULL THEN 'missed N' WHEN dr IS NULL AND heard THEN 'bass root ignored' WHEN dr IS NULL THEN 'false N' WHEN id % 11 = 0 THEN 'boundary snapped to wrong beat' WHEN rr = dr AND NOT re AND de THEN 'transient seventh detected'
    WHEN rr = dr AND re AND NOT de THEN 'seventh omitted' WHEN rr = dr AND (id / 50) % 1 < 0.12::DOUBLE THEN 'weak third caused major/minor ambiguity' WHEN rr = dr THEN 'wrong chord quality' WHEN (rm AND NOT dm AND dist = 3) OR (NOT rm AND dm AND dist = 9) THEN 'relative major/minor confusion'
    WHEN heard THEN 'bass root ignored' WHEN id % 5 = 0 THEN 'lead melody contaminated harmony' ELSE 'wrong root' END AS kind, count(*) AS n FROM j GROUP BY 1
""")
def mismatch_classes(spark, sf_dir):
    c = _chords(spark, sf_dir).select("id", L.strict(F.col("chord")).alias("c")).where("c.ok")
    pairs = c.join(c.select((F.col("id") - 1).alias("id"), F.col("c").alias("d")), "id")
    kind = fusion.mismatch_class(F.col("c"), F.col("d"), F.when(F.col("id") % 3 == 0, F.col("c.root")), F.pmod(F.col("id") / 50.0, F.lit(1.0)), F.col("id") % 11 == 0, F.col("id") % 5 == 0)
    return pairs.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_sum = lambda xs: f"list_reduce(list_prepend(0.0::DOUBLE, {xs}), lambda a, x: a + x)"  # noqa: E731  # in the order of the list
_profiles = [(f"{name} {mode}", [values[(p - tonic) % 12] / sum(values) for p in range(12)]) for tonic, name in enumerate(L.SHARPS) for mode, values in (("major", fusion.MAJOR), ("minor", fusion.MINOR))]


@query(V_SQL + f"""
, c AS (SELECT id, list_transform(vector[1:12], lambda a: greatest(a, 0)) AS c FROM v),
m(k, name, w) AS (VALUES {', '.join(f"({k}, '{name}', {w}::DOUBLE[])" for k, (name, w) in enumerate(_profiles))}),
s AS (SELECT id, k, name, {_sum('c')} > 0 AS heard, {_sum('list_transform(range(1, len(c) + 1), lambda p: c[p] * w[p])')} AS s FROM c, m),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN isnan(s) THEN 1 ELSE 0 END, s DESC, k) AS r FROM s),
b AS (SELECT id, max(name) FILTER (r = 1 AND heard) AS key, max(s) FILTER (r = 1 AND heard) - max(s) FILTER (r = 2) AS d FROM r GROUP BY id)
SELECT id, key, CASE WHEN NOT isnan(d) THEN {half_up_sql('greatest(0, least(1, d / 0.018::DOUBLE))', 5)} END AS confidence FROM b
""")
def key_estimate(spark, sf_dir):
    found = _vectors(spark, sf_dir).select("id", fusion.key_estimate(F.transform(F.slice("vector", 1, 12), lambda a: F.greatest(a, F.lit(0.0)))).alias("k"))
    return found.select("id", F.col("k.name").alias("key"), X.half_up(F.col("k.confidence"), 5).alias("confidence"))


@query(f"""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS label, count(*) AS n, {half_up_sql('avg(value)')} AS mean FROM events GROUP BY ALL
""")
def windowed_counts(spark, sf_dir):
    """Extension: the stream operator over the whole table as a bounded input."""
    found = live.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", "1 hour")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "label", "n", X.half_up(F.col("mean")).alias("mean"))


@query("""
WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k
""")
def event_sessions(spark, sf_dir):
    """Extension: sessions of the stream operator over the whole table."""
    found = live.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "3 hours", "1 hour")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
