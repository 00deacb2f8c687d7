"""Queries whose next step rests on the state after the last one, and incremental ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staveframe.functions.scalars import half_up
from staveframe.operators import calibration, edits, evidence, regions, rollups, smoothing
from staveframe.plans.roles import OBSERVED, heard, judged, observations, table
from staveframe.sources.store import Store, shared_folder
from staveframe.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: The windows of ``roles.observations``, labels by their number.
WINDOWS_SQL = """
WITH RECURSIVE ev AS (
    SELECT user_id, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events
), sc AS (
    SELECT *, list_transform(range(1, 6), lambda j: 0.4::DOUBLE + ((i * (7 * j + 3)) % 101)::DOUBLE / 1000.0::DOUBLE + CASE WHEN b = j THEN 0.06::DOUBLE + (i % 7)::DOUBLE / 200.0::DOUBLE ELSE 0.0::DOUBLE END) AS sc
    FROM (SELECT *, CASE WHEN i % 23 = 0 THEN 5 ELSE (user_id + k // 6) % 4 + 1 END AS b FROM ev)
), tp AS (
    SELECT *, list_position(sc, list_max(sc)) AS best FROM sc
), sd AS (
    SELECT *, list_transform(range(1, 6), lambda j: CASE WHEN j = best THEN -9.0::DOUBLE ELSE sc[j] END) AS rest FROM tp
), ob AS MATERIALIZED (
    SELECT user_id, i, k, sc, best, list_position(rest, list_max(rest)) AS sec, list_max(sc) AS bs, list_max(sc) - list_max(rest) AS mg, (i % 10)::DOUBLE / 10.0::DOUBLE AS cf,
        CASE WHEN k % 4 = 0 THEN 1.0::DOUBLE WHEN k % 2 = 0 THEN 0.86::DOUBLE ELSE 0.72::DOUBLE END AS st, (i % 17)::DOUBLE / 100.0::DOUBLE AS s7, CASE WHEN i % 3 = 0 THEN ['C', 'C', 'A', 'F', NULL][best] END AS br,
        (i % 50)::DOUBLE / 100.0::DOUBLE AS bc, i % 11 = 0 AS ps, (user_id + (k + 1) // 6) % 4 + 1 AS de, ['C', 'C', 'A', 'F', NULL] AS ro FROM sd
)"""
#: Every window's state after it: label, where it began to lose, last boundary, and for each label its evidence, first
#: support, supports, last support, windows on top and in a row; and the decision made there, if any.
CHANGES_SQL = WINDOWS_SQL + """,
nb AS (
    SELECT *, lead(de, 1) OVER w AS d1, lead(de, 2) OVER w AS d2, lead(de, 3) OVER w AS d3, lead(de, 4) OVER w AS d4, lag(sc, 1) OVER w AS p1, lag(sc, 2) OVER w AS p2, lead(sc, 1) OVER w AS n1,
        list_transform(range(1, 6), lambda j: coalesce(br = ro[j] AND bc >= 0.22::DOUBLE AND NOT ps, false)) AS att FROM ob WINDOW w AS (PARTITION BY user_id ORDER BY k)
), fq AS MATERIALIZED (
    SELECT *, list_transform(range(1, 6), lambda j: coalesce(list_filter([de, d1, d2, d3, d4], lambda d: d IS NOT NULL AND ro[d] = ro[j])[1], j)) AS fin,
        list_transform(range(0, 25), lambda c: CASE WHEN p1 IS NULL THEN 0.0::DOUBLE WHEN p2 IS NULL THEN p1[c // 5 + 1] - p1[c % 5 + 1] ELSE ((p2[c // 5 + 1] - p2[c % 5 + 1]) + (p1[c // 5 + 1] - p1[c % 5 + 1])) / 2 END
            + CASE WHEN n1 IS NULL THEN sc[c % 5 + 1] - sc[c // 5 + 1] ELSE ((sc[c % 5 + 1] - sc[c // 5 + 1]) + (n1[c % 5 + 1] - n1[c // 5 + 1])) / 2 END
            + CASE WHEN att[c % 5 + 1] THEN 0.025::DOUBLE * bc ELSE 0.0::DOUBLE END + st * 0.012::DOUBLE) AS fit FROM nb
), r AS (
    SELECT user_id, k, de AS cur, -1::BIGINT AS dep, 0::BIGINT AS lb, [NULL, NULL, NULL, NULL, NULL]::DOUBLE[] AS ev, [0, 0, 0, 0, 0]::BIGINT[] AS fs, [0, 0, 0, 0, 0]::BIGINT[] AS sw, [0, 0, 0, 0, 0]::BIGINT[] AS ls, [0, 0, 0, 0, 0]::BIGINT[] AS tw, [0, 0, 0, 0, 0]::BIGINT[] AS cw,
        NULL::BIGINT AS was, NULL::BIGINT AS e, NULL::BIGINT AS bnd, NULL::DOUBLE AS gathered, NULL::BIGINT AS sup FROM fq WHERE k = 0
    UNION ALL
    SELECT user_id, k, CASE WHEN a IS NULL THEN cur ELSE nm END, CASE WHEN a IS NULL THEN dep ELSE -1 END, CASE WHEN a IS NULL THEN lb ELSE bn END, CASE WHEN a IS NULL THEN ev ELSE [NULL, NULL, NULL, NULL, NULL]::DOUBLE[] END, fs, sw, ls, tw, cw,
        CASE WHEN a IS NOT NULL THEN cur END, CASE WHEN a IS NOT NULL THEN e END, CASE WHEN a IS NOT NULL THEN bn END, CASE WHEN a IS NOT NULL THEN ev[a] END, CASE WHEN a IS NOT NULL THEN sw[a] END
    FROM (SELECT *, CASE WHEN v1 IS NULL AND v2 IS NULL AND v3 IS NULL THEN greatest(lb + 1, e) WHEN v1 IS NOT NULL AND v1 >= coalesce(v2, -1e9) AND v1 >= coalesce(v3, -1e9) THEN e - 1 WHEN v2 IS NOT NULL AND v2 >= coalesce(v3, -1e9) THEN e ELSE e + 1 END AS bn
    FROM (SELECT y.*, CASE WHEN y.e - 1 > lb AND y.e - 1 >= 1 THEN b1.fit[(cur - 1) * 5 + nm] - 0.006::DOUBLE END AS v1, CASE WHEN y.e > lb THEN b2.fit[(cur - 1) * 5 + nm] END AS v2, CASE WHEN y.e + 1 > lb AND y.e + 1 <= y.k THEN b3.fit[(cur - 1) * 5 + nm] - (0.006::DOUBLE + 0.004::DOUBLE) END AS v3
    FROM (SELECT *, CASE WHEN dep >= 0 THEN least(dep, fs[a]) ELSE fs[a] END AS e, fin[a] AS nm
    FROM (SELECT *, list_sort(list_transform(list_filter(range(1, 6), lambda j: ev[j] >= 0.045::DOUBLE AND tw[j] >= 1 AND (cw[j] >= 2 OR (sw[j] >= 1 AND j = best AND cf >= 0.16::DOUBLE AND st >= 0.86::DOUBLE AND mg >= 0.01::DOUBLE * 0.75::DOUBLE AND att[j]))), lambda j: {'c': -cw[j], 't': -tw[j], 'v': -ev[j], 'f': fs[j], 'j': j}))[1]['j'] AS a
    FROM (SELECT user_id, k, cur, dep, lb, best, cf, st, mg, att, fin,
        list_transform(range(1, 6), lambda j: CASE WHEN con[j] > 0 THEN coalesce(ev[j], 0.0::DOUBLE) + con[j] ELSE ev[j] END) AS ev, list_transform(range(1, 6), lambda j: CASE WHEN con[j] > 0 AND ev[j] IS NULL THEN k ELSE fs[j] END) AS fs,
        list_transform(range(1, 6), lambda j: CASE WHEN con[j] > 0 THEN CASE WHEN ev[j] IS NULL THEN 0 ELSE sw[j] END + 1 ELSE sw[j] END) AS sw, list_transform(range(1, 6), lambda j: CASE WHEN con[j] > 0 THEN k ELSE ls[j] END) AS ls,
        list_transform(range(1, 6), lambda j: CASE WHEN con[j] > 0 THEN CASE WHEN ev[j] IS NULL THEN 0 ELSE tw[j] END + CASE WHEN j = best THEN 1 ELSE 0 END ELSE tw[j] END) AS tw, list_transform(range(1, 6), lambda j: CASE WHEN con[j] > 0 THEN CASE WHEN ev[j] IS NULL THEN 0 ELSE cw[j] END + CASE WHEN j = best THEN 1 ELSE 0 END ELSE cw[j] END) AS cw
    FROM (SELECT *, list_transform(range(1, 6), lambda j: CASE WHEN j <> cur AND NOT (coalesce(ro[j] = ro[cur], false) AND NOT (j = 2 AND s7 >= 0.1::DOUBLE)) AND (j = best OR j = sec OR j = de OR coalesce(ro[j] = ro[best] OR ro[j] = ro[sec], false) OR att[j]) AND sc[j] - sc[cur] >= -0.01::DOUBLE
            THEN greatest(0.0::DOUBLE, sc[j] - sc[cur] - 0.01::DOUBLE * 0.25::DOUBLE) * (0.85::DOUBLE + st * 0.3::DOUBLE) * (0.65::DOUBLE + cf) + CASE WHEN j = best THEN greatest(0.0::DOUBLE, mg) * 0.12::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN att[j] THEN 0.018::DOUBLE * bc ELSE 0.0::DOUBLE END + CASE WHEN de = j THEN 0.003::DOUBLE ELSE 0.0::DOUBLE END
            ELSE 0.0::DOUBLE END) AS con
    FROM (SELECT user_id, k, sc, best, sec, cf, st, mg, s7, bc, de, ro, att, fin, cur, lb, CASE WHEN win THEN -1 WHEN dep < 0 THEN k ELSE dep END AS dep,
        list_transform(range(1, 6), lambda j: CASE WHEN ev[j] * f >= 0.002::DOUBLE THEN ev[j] * f END) AS ev, fs, ls, tw, list_transform(range(1, 6), lambda j: CASE WHEN k - ls[j] > 1 THEN greatest(0, sw[j] - 1) ELSE sw[j] END) AS sw, list_transform(range(1, 6), lambda j: CASE WHEN j = best THEN cw[j] ELSE 0 END) AS cw
    FROM (SELECT *, CASE WHEN win THEN 0.32::DOUBLE ELSE 0.68::DOUBLE END AS f
    FROM (SELECT o.*, r.cur, r.dep, r.lb, r.ev, r.fs, r.sw, r.ls, r.tw, r.cw, o.best = r.cur OR o.sc[r.cur] >= o.bs - 0.01::DOUBLE * 0.5::DOUBLE AS win FROM r JOIN fq o ON o.user_id = r.user_id AND o.k = r.k + 1))))))
    ) y LEFT JOIN fq b1 ON b1.user_id = y.user_id AND b1.k = y.e - 1 LEFT JOIN fq b2 ON b2.user_id = y.user_id AND b2.k = y.e LEFT JOIN fq b3 ON b3.user_id = y.user_id AND b3.k = y.e + 1))
)"""
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in OBSERVED) + "]"


@query(CHANGES_SQL + f"""
SELECT user_id, k AS place, {NAMES_SQL}[was] AS from_label, {NAMES_SQL}[cur] AS to_label, e AS evidence_from, bnd AS boundary, gathered AS evidence, sup AS supports FROM r WHERE was IS NOT NULL
""")
def change_decisions(spark, sf_dir):
    found = changes.decisions(observations(spark, sf_dir), "user_id", OBSERVED)
    return found.where("boundary IS NOT NULL").select("user_id", "place", "from_label", "to_label", "evidence_from", "boundary", "evidence", "supports")


@query(CHANGES_SQL + f"""
, hit AS (SELECT o.user_id, o.k AS place, max(d.k) AS at FROM ob o LEFT JOIN r d ON d.user_id = o.user_id AND d.was IS NOT NULL AND d.bnd <= o.k GROUP BY o.user_id, o.k)
SELECT hit.user_id, hit.place, {NAMES_SQL}[d.cur] AS label, d.bnd AS boundary, hit.at AS confirmed FROM hit JOIN r d ON d.user_id = hit.user_id AND d.k = coalesce(hit.at, 0)
""")
def reduced_latency(spark, sf_dir):
    return changes.confirmed(observations(spark, sf_dir), "user_id", OBSERVED)


MODEL, OTHER_MODEL = "m2", "m1"
VOTES_SQL = "list_transform(range(0, 12), lambda z: len(list_filter(pcs, lambda p: p = z)))"


def _requests(spark, sf_dir):
    """A request for each user and type of event; the model of clicks is another one than that of the rest."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    each = events.groupBy(F.col("event_type").alias("capture"), F.col("user_id").alias("track")).agg(F.count("*").alias("frames"), F.min("event_id").alias("from"), F.max("event_id").alias("to"))
    each = each.withColumns({"performer": F.concat(F.lit("p0"), (F.col("track") % 6).cast("string")), "model": F.when(F.col("capture") == "click", MODEL).otherwise(OTHER_MODEL)}).where("performer <> 'p00'")
    return each.withColumn("cache_key", evidence.request_key("capture", "track", "frames", "from", "to", "model"))


def _answers(spark, sf_dir):
    """How many of a request's events fall to each of twelve classes."""

    def run(todo):
        events = table(spark, sf_dir, "events").select(F.col("event_type").alias("capture"), F.col("user_id").alias("track"), F.pmod(F.floor("value"), F.lit(12)).alias("pc"))
        votes = events.join(todo.select("capture", "track", "cache_key"), ["capture", "track"]).groupBy("cache_key").agg(*[F.count_if(F.col("pc") == k).alias(f"v{k}") for k in range(12)])
        return votes.select("cache_key", F.array(*[F.col(f"v{k}") for k in range(12)]).alias("votes"))

    return run


@query(f"""
WITH e AS (SELECT event_type AS capture, user_id AS track, list(CAST(floor(value) AS BIGINT) % 12) AS pcs, count(*) AS frames, min(event_id) AS a, max(event_id) AS b FROM events WHERE user_id % 6 <> 0 GROUP BY ALL)
SELECT capture, track, 'p0' || (track % 6) AS performer, CASE WHEN track % 6 % 2 = 0 THEN 'even' ELSE 'odd' END AS fold, CASE WHEN capture = 'click' OR track % 3 = 2 THEN 'miss' WHEN track % 3 = 1 THEN 'invalid' ELSE 'hit' END AS status,
    array_to_string({VOTES_SQL}, ' ') AS votes, sha256(array_to_string({VOTES_SQL}, ' ')) AS digest, CASE WHEN track = min(track) OVER (PARTITION BY capture) THEN 'same' ELSE '' END AS parity FROM e
""")
def calibration_evidence(spark, sf_dir):
    """A third of the tracks is in the store, a third with answers that are cut short; for clicks both are of an older model."""
    requests, answer = _requests(spark, sf_dir), _answers(spark, sf_dir)
    store = Store(spark, f"{shared_folder(spark)}/evidence-{uuid.uuid4().hex}", "cache_key", 8)
    valid = (F.size("votes") == 12) & (F.aggregate("votes", F.lit(0).cast("long"), lambda a, v: a + v) > 0)
    older = requests.withColumn("model", F.lit(OTHER_MODEL)).withColumn("cache_key", evidence.request_key("capture", "track", "frames", "from", "to", "model"))
    evidence.cached(older.where("track % 3 = 0"), store, answer, ["model"], valid)
    broken = older.where("track % 3 = 1")
    store.upsert(answer(broken).join(broken.select("cache_key", "model"), "cache_key").withColumns({"votes": F.slice("votes", 1, 7), "entry": F.lit(evidence.ENTRY)}))
    performers = spark.createDataFrame([(f"p0{k}", "training" if k < 4 else "development", "odd" if k % 2 else "even") for k in range(1, 6)], "performer string, role string, fold string")
    told = evidence.evidence(requests, performers, store, answer, ["model"], valid, F.sha2(F.concat_ws(" ", F.col("votes").cast("array<string>")), 256), "p00")
    return told.select("capture", "track", "performer", "fold", "status", F.concat_ws(" ", F.col("votes").cast("array<string>")).alias("votes"), "digest", F.when(F.col("parity"), "same").otherwise("").alias("parity"))


def _song_reports(spark, sf_dir):
    """An order as the report of a song: metrics of its items, items sent back as mismatches, items by status as confusions."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    li = items.repartition("l_orderkey").groupBy("l_orderkey").agg(  # dealt first: lists of one item each would be built, and dealt, before
        F.max("l_discount").alias("root"), F.max("l_tax").alias("family"), F.max("l_quantity").alias("boundary"),
        F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("error_type"), F.col("l_quantity").cast("double").alias("duration")))).alias("mismatches"),
        F.collect_list(F.struct(F.concat("l_returnflag", F.lit(">"), "l_linestatus").alias("pair"), F.col("l_tax").cast("double").alias("seconds"))).alias("confusions"),
    )
    metrics = F.create_map(F.lit("rootAccuracy"), F.col("root").cast("double"), F.lit("majorMinorAccuracy"), F.when(F.col("l_orderkey") % 5 != 0, F.col("family").cast("double")), F.lit("meanBoundaryErrorMs"), F.when(F.col("l_orderkey") % 7 == 0, float("nan")).otherwise(F.col("boundary").cast("double")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("song "), F.col("o_custkey").cast("string")).alias("song"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("genre"))
    return li.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("report_id"), "song", "genre", metrics.alias("metrics"), "mismatches", "confusions")


_mean = lambda x: f"floor((sum(CAST({x} AS DECIMAL(28,8))) / count({x}))::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE"


@query(f"""
WITH it AS (SELECT l_orderkey, max(l_discount)::DOUBLE AS root, max(l_tax)::DOUBLE AS fam, max(l_quantity)::DOUBLE AS bnd FROM lineitem GROUP BY 1),
rp AS (SELECT l_orderkey AS id, 'song ' || o_custkey AS song, coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END, 'Unspecified') AS genre, root, CASE WHEN l_orderkey % 5 <> 0 THEN fam END AS fam, CASE WHEN l_orderkey % 7 <> 0 THEN bnd END AS bnd FROM it JOIN orders ON o_orderkey = l_orderkey),
cs AS (SELECT 'line ' || l_linenumber AS name, rp.song, l_quantity FROM lineitem JOIN rp ON rp.id = l_orderkey WHERE l_returnflag = 'R')
SELECT 'metric' AS part, 'rootAccuracy' AS name, '' AS item, count(root) AS songs, NULL::BIGINT AS occurrences, {_mean('root')} AS value, '' AS recurring FROM rp
UNION ALL SELECT 'metric', 'majorMinorAccuracy', '', count(fam), NULL, {_mean('fam')}, '' FROM rp HAVING count(fam) > 0 UNION ALL SELECT 'metric', 'meanBoundaryErrorMs', '', count(bnd), NULL, {_mean('bnd')}, '' FROM rp HAVING count(bnd) > 0
UNION ALL SELECT 'songs', '', '', count(*), NULL, NULL, '' FROM rp UNION ALL SELECT 'genre', genre, '', count(*), NULL, NULL, '' FROM rp GROUP BY genre
UNION ALL SELECT 'genre', genre, 'rootAccuracy', count(root), NULL, {_mean('root')}, '' FROM rp GROUP BY genre UNION ALL SELECT 'genre', genre, 'majorMinorAccuracy', count(fam), NULL, {_mean('fam')}, '' FROM rp GROUP BY genre HAVING count(fam) > 0
UNION ALL SELECT 'cause', name, '', count(DISTINCT song), count(*), floor(sum(l_quantity)::DOUBLE * 1e3::DOUBLE + 0.5::DOUBLE) / 1e3::DOUBLE, CASE WHEN count(DISTINCT song) >= 3 THEN 'yes' ELSE 'no' END FROM cs GROUP BY name
UNION ALL SELECT 'confusion', l_returnflag || '>' || l_linestatus, '', count(*), NULL, floor(sum(l_tax)::DOUBLE * 1e3::DOUBLE + 0.5::DOUBLE) / 1e3::DOUBLE, '' FROM lineitem JOIN rp ON rp.id = l_orderkey GROUP BY 2
""")
def refreshed_rollup(spark, sf_dir):
    """Two thirds of the reports are stored first, a part of them in an earlier form; a second refresh brings the rest and
    the later forms."""
    root = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    stored, sums = Store(spark, f"{root}/songs", "report_id", 16), Store(spark, f"{root}/sums", "sum_key", 4)
    reports = _song_reports(spark, sf_dir)  # each refresh works out its own part
    early = F.col("report_id") % 4 == 1
    former = {"song": F.when(early, F.lit("former song")).otherwise(F.col("song")), "genre": F.when(early, F.lit("former")).otherwise(F.col("genre")), "metrics": F.when(early, F.map_from_arrays(F.array(F.lit("rootAccuracy"), F.lit("formerly")), F.array(F.lit(0.5), F.lit(1.5)))).otherwise(F.col("metrics"))}
    rollups.refresh(reports.where("report_id % 3 <> 2").withColumns(former), stored, sums)
    rollups.refresh(reports.where("report_id % 3 = 2 OR report_id % 4 = 1"), stored, sums)
    recurring = F.when(F.col("recurring"), "yes").when(~F.col("recurring"), "no").otherwise("")
    return rollups.report(sums.current()).withColumn("recurring", recurring)


SECONDS = 0.5
#: Regions of the leading label, triads where the seventh is weak; then a list of them for each user, of which the first
#: that may be is relabelled and joined until none is left, and neighbours of one root are joined from left to right.
_sum5 = lambda c, a: f"list_transform(range(1, 6), lambda j: list_sum(list_transform({a}, lambda x: x.{c}[j]))::BIGINT)"
_join = lambda a, nm: f"[{{'nm': {nm}, 's': ({a})[1].s, 'e': ({a})[-1].e, 'n': list_sum(list_transform({a}, lambda x: x.n))::BIGINT, 'mg': list_sum(list_transform({a}, lambda x: x.mg))::BIGINT, 'st': ({a})[1].st, 'rm': true, 'ss': {_sum5('ss', a)}, 'cs': {_sum5('cs', a)}}}]"
_conf = lambda x: f"({x}.cs[{x}.nm] / 1e9::DOUBLE / {x}.n)"
_units = lambda x: f"CAST(sum(CAST(floor(({x}) * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS BIGINT)"  # noqa: E731  # no order of adding bears on it
REGIONS_SQL = WINDOWS_SQL + f""",
w1 AS (SELECT *, list_transform(range(1, 6), lambda j: CASE WHEN j = 5 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, sc[j])) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, sc[j] * 0.8::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, mg / 0.12::DOUBLE)) * 0.2::DOUBLE)) END) AS sr,
    CASE WHEN best = lag(best) OVER (PARTITION BY user_id ORDER BY k) THEN 0 ELSE 1 END AS nw FROM ob),
w2 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY k) AS run FROM w1),
g1 AS (SELECT user_id, run, CASE WHEN min(best) = 2 AND {_units('s7')} / 1e9::DOUBLE / count(*) < 0.1::DOUBLE THEN 1 ELSE min(best) END AS nm FROM w2 GROUP BY user_id, run),
g2 AS (SELECT *, CASE WHEN nm = lag(nm) OVER (PARTITION BY user_id ORDER BY run) THEN 0 ELSE 1 END AS nw FROM g1),
g3 AS (SELECT user_id, run, nm, sum(nw) OVER (PARTITION BY user_id ORDER BY run) AS part FROM g2),
g4 AS (SELECT w2.user_id, part, min(nm) AS nm, min(k) * {SECONDS}::DOUBLE AS s, (max(k) + 1) * {SECONDS}::DOUBLE AS e, count(*) AS n, {_units('mg')} AS mg, min_by(st, k) AS st,
    [{', '.join(_units(f'sc[{j}]') for j in range(1, 6))}] AS ss, [{', '.join(_units(f'sr[{j}]') for j in range(1, 6))}] AS cs FROM w2 JOIN g3 ON g3.user_id = w2.user_id AND g3.run = w2.run GROUP BY w2.user_id, part),
f0 AS (SELECT user_id, list({{'nm': nm, 's': s, 'e': e, 'n': n, 'mg': mg, 'st': st, 'rm': false, 'ss': ss, 'cs': cs}} ORDER BY s) AS rs FROM g4 GROUP BY user_id),
fx AS (SELECT user_id, 0 AS turn, rs, 0::BIGINT AS i FROM f0 UNION ALL
    SELECT user_id, turn + 1, CASE WHEN i IS NULL THEN rs ELSE rs[1:lo - 1] || {_join('rs[lo:hi]', 'rp')} || rs[hi + 1:len(rs)] END, coalesce(i, -1) FROM (
        SELECT *, CASE WHEN i > 1 AND rs[i - 1].nm = rp THEN i - 1 ELSE i END AS lo, CASE WHEN i < len(rs) AND rs[i + 1].nm = rp THEN i + 1 ELSE i END AS hi FROM (
            SELECT *, CASE WHEN i > 1 AND i < len(rs) AND (rs[i - 1].nm = rs[i + 1].nm OR (rs[i - 1].nm <= 2 AND rs[i + 1].nm <= 2)) THEN CASE WHEN {_conf('rs[i - 1]')} >= {_conf('rs[i + 1]')} THEN rs[i - 1].nm ELSE rs[i + 1].nm END
                WHEN i > 1 AND rs[i - 1].nm = 5 THEN rs[i + 1].nm WHEN i < len(rs) AND rs[i + 1].nm = 5 THEN rs[i - 1].nm WHEN i = len(rs) THEN rs[i - 1].nm WHEN i = 1 THEN rs[2].nm
                WHEN rs[i].ss[rs[i - 1].nm] / 1e9::DOUBLE / rs[i].n + {_conf('rs[i - 1]')} * 0.08::DOUBLE >= rs[i].ss[rs[i + 1].nm] / 1e9::DOUBLE / rs[i].n + {_conf('rs[i + 1]')} * 0.08::DOUBLE THEN rs[i - 1].nm ELSE rs[i + 1].nm END AS rp FROM (
                SELECT user_id, turn, rs, list_filter(range(1, len(rs) + 1), lambda z: len(rs) > 1 AND CASE WHEN rs[z].nm = 5 THEN rs[z].e - rs[z].s < 1.0::DOUBLE ELSE rs[z].e - rs[z].s < 1.5::DOUBLE AND NOT (rs[z].n >= 2 AND {_conf('rs[z]')} >= 0.82::DOUBLE AND rs[z].st >= 0.86::DOUBLE) END
                    AND NOT (z = 1 AND rs[2].nm = 5) AND NOT (z = len(rs) AND rs[z - 1].nm = 5))[1] AS i FROM fx WHERE i >= 0)))),
f1 AS (SELECT user_id, rs FROM fx WHERE i = -1),
fm AS (SELECT user_id, rs, 1::BIGINT AS i FROM f1 UNION ALL
    SELECT user_id, CASE WHEN weak THEN rs[1:i - 1] || {_join('rs[i:i + 1]', f"CASE WHEN {_conf('rs[i]')} * rs[i].n >= {_conf('rs[i + 1]')} * rs[i + 1].n THEN rs[i].nm ELSE rs[i + 1].nm END")} || rs[i + 2:len(rs)] ELSE rs END, CASE WHEN weak THEN i ELSE i + 1 END FROM (
        SELECT *, rs[i].nm <= 2 AND rs[i + 1].nm <= 2 AND (rs[i].e - rs[i].s < 1.5::DOUBLE OR rs[i + 1].e - rs[i + 1].s < 1.5::DOUBLE OR rs[i].mg / 1e9::DOUBLE / rs[i].n < 0.01::DOUBLE OR rs[i + 1].mg / 1e9::DOUBLE / rs[i + 1].n < 0.01::DOUBLE) AS weak FROM fm WHERE i < len(rs))),
u1 AS (SELECT user_id, unnest(rs) AS r FROM fm WHERE i >= len(rs)),
u2 AS (SELECT user_id, r, CASE WHEN r.nm = lag(r.nm) OVER (PARTITION BY user_id ORDER BY r.s) THEN 0 ELSE 1 END AS nw FROM u1),
u3 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY r.s) AS part FROM u2)
SELECT user_id, min(r.s) AS start, max(r.e) AS "end", {NAMES_SQL}[min(r.nm)] AS label, CAST(sum(r.n) AS BIGINT) AS windows, floor(CAST(sum(r.cs[r.nm]) AS DOUBLE) / 1e9::DOUBLE / CAST(sum(r.n) AS DOUBLE) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS confidence FROM u3 GROUP BY user_id, part
"""


def _leading_regions(spark, sf_dir):
    windows = observations(spark, sf_dir).withColumns({"start": F.col("place") * SECONDS, "end": (F.col("place") + 1) * SECONDS})
    return regions.labelled_regions(windows, "user_id", OBSERVED, "best")


@query(REGIONS_SQL)
def region_cleanup(spark, sf_dir):
    done = regions.cleaned(_leading_regions(spark, sf_dir), "user_id", OBSERVED)
    return done.select("user_id", "start", "end", "label", "windows", half_up(F.col("confidence")).alias("confidence"))


@query(WINDOWS_SQL + f""",
ch AS (SELECT user_id, k, mg, de, list_transform(range(0, 12), lambda j: 1.0::DOUBLE + ((k // 4) % 6 * (j + 1) % 7)::DOUBLE + (i * (j + 1) % 5)::DOUBLE / 10.0::DOUBLE) AS c FROM ob),
nm AS (SELECT *, list_sum(list_transform(c, lambda x: x * x)) AS n FROM ch),
pr AS (SELECT a.user_id, a.k, a.mg, b.k AS prior, b.de, list_sum(list_transform(range(1, 13), lambda j: a.c[j] * b.c[j])) / sqrt(a.n * b.n) AS alike FROM nm a JOIN nm b ON b.user_id = a.user_id AND b.k < a.k AND b.k >= a.k - 64 AND (a.k - b.k) % 4 = 0),
bs AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY alike DESC, prior DESC) AS r FROM pr)
SELECT user_id, k AS place, prior, {NAMES_SQL}[de] AS prior_label, floor(least(0.035::DOUBLE * alike, greatest(0.0::DOUBLE, least(0.015::DOUBLE, mg * 0.5::DOUBLE))) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS bonus
FROM bs WHERE r = 1 AND alike >= 0.9::DOUBLE AND de <> 5 AND mg > 0
""")
def repeat_bonus(spark, sf_dir):
    found = smoothing.repeats(heard(spark, sf_dir), "user_id", "decoded").where("bonus IS NOT NULL")
    return found.select("user_id", "place", "prior", "prior_label", half_up(F.col("bonus"), 9).alias("bonus"))


@query("")
def smoothed_chords(spark, sf_dir):
    """Each user's windows decoded, reinforced by repeated sections and decoded again, with confirmed changes and cleaned up."""
    done = smoothing.smoothed(heard(spark, sf_dir), "user_id", OBSERVED, [0, 0, 9, 5, -1])
    return done.select("user_id", "start", "end", "label", "windows", half_up(F.col("confidence")).alias("confidence"))


SEED, DRAWN = 20260725, 32
_word = lambda a, b: f"(({a}) * (({b}) % 65536) + ((({a}) * (({b}) // 65536)) % 65536) * 65536) % 4294967296"
_up3 = lambda x: f"floor(({x}) * 1e3::DOUBLE + 0.5::DOUBLE) / 1e3::DOUBLE"
CANDIDATES_SQL = f"""
g0 AS (SELECT n, ({SEED} + (n + 1) * 1831565813) % 4294967296 AS v FROM (SELECT unnest(range(0, {DRAWN * calibration.DRAWS})) AS n)),
g1 AS (SELECT n, {_word('xor(v, v // 32768)', 'v | 1')} AS v FROM g0), g2 AS (SELECT n, xor(v, (v + {_word('xor(v, v // 128)', 'v | 61')}) % 4294967296) AS v FROM g1),
g3 AS (SELECT n // 8 AS i, list(xor(v, v // 16384)::DOUBLE / 4294967296.0::DOUBLE ORDER BY n) AS r FROM g2 GROUP BY 1),
cd AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{name}', {level}, {str(adaptive).lower()}, '{kind}', {', '.join(f'{v}::DOUBLE' for v in ({**calibration.BASE, **other}).values())})" for k, (name, other, adaptive, kind, level) in enumerate(calibration.NAMED))}) t(place, id, complexity, adaptive, calibration, lw, ow, aw, ll, me, pr, mx)
    UNION ALL SELECT i + 6, 'random-' || lpad(CAST(i + 1 AS VARCHAR), 2, '0'), 2, true, CASE WHEN r[8] < 0.25::DOUBLE THEN 'temperature' ELSE 'none' END, {_up3('0.35::DOUBLE + r[1] * 0.5::DOUBLE')}, ([0, 0.1, 0.25]::DOUBLE[])[CAST(floor(r[3] * 3) AS BIGINT) + 1], ([0, 0.15, 0.25]::DOUBLE[])[CAST(floor(r[4] * 3) AS BIGINT) + 1],
        {_up3('0.35::DOUBLE + r[5] * 0.27::DOUBLE')}, {_up3('0.7::DOUBLE + r[6] * 0.29::DOUBLE')}, {_up3('0.68::DOUBLE + r[7] * 0.2::DOUBLE')}, {_up3(f"greatest({_up3('0.35::DOUBLE + r[1] * 0.5::DOUBLE')}, 0.5::DOUBLE + r[2] * 0.4::DOUBLE)")} FROM g3)
"""


@query(WINDOWS_SQL + "," + CANDIDATES_SQL.rstrip() + """,
vt AS (SELECT user_id, k, i, sc, cf, mg, (user_id + k // 6) % 4 + 1 AS wanted, CASE WHEN user_id % 2 = 0 THEN 0.9::DOUBLE ELSE 1.4::DOUBLE END AS t, list_transform(range(1, 6), lambda j: (i * (3 * j + 2) % 13 + 1 + CASE WHEN j = de THEN 8 ELSE 0 END)::DOUBLE) AS v FROM ob),
lp AS (SELECT *, list_transform(v, lambda x: x / list_sum(v)) AS p FROM vt),
tp2 AS (SELECT *, list_transform(p, lambda x: power(x, 1 / t)) AS q FROM lp),
wn AS (SELECT *, list_transform(q, lambda x: x / list_sum(q)) AS z, list_max(p) * 2 AS top, (i % 10)::DOUBLE / 10.0::DOUBLE AS en, i % 9 AS fr, CASE WHEN i % 2 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS ag, CASE i % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.65::DOUBLE ELSE 0.25::DOUBLE END AS fl, i % 5 < 3 AS fm FROM tp2),
am AS (SELECT wn.*, cd.*, 1 - greatest(0, least(1, mg / 0.1::DOUBLE)) AS am, 1 - greatest(0, least(1, cf / pr)) AS ac FROM wn, cd),
ww AS (SELECT *, CASE WHEN NOT adaptive THEN CASE WHEN fr > 0 THEN lw ELSE 0 END WHEN fr > 0 AND top >= ll AND en < me THEN least(greatest(lw * (0.35::DOUBLE + 0.65::DOUBLE * greatest(0, least(1, (top - ll) / (1 - ll)))) * greatest(0, least(1, (me - en) / me)) * (0.675::DOUBLE + 0.325::DOUBLE * am)
    * ((0.35::DOUBLE + 0.65::DOUBLE * (am + ac) / 2) / (0.675::DOUBLE + 0.325::DOUBLE * am)) * CASE WHEN cf <= pr THEN 1 ELSE greatest(0, least(1, (0.9::DOUBLE - cf) / (0.9::DOUBLE - pr))) END * ag * fl, 0), CASE WHEN fm THEN 0.3::DOUBLE ELSE mx END) ELSE 0 END AS w FROM am),
mx AS (SELECT user_id, k, id, wanted, list_transform(range(1, 6), lambda j: sc[j] + w * CASE WHEN calibration = 'temperature' THEN z[j] ELSE p[j] END) AS s FROM ww),
fd AS (SELECT *, list_position(s, list_max(s)) AS found FROM mx),
ch AS (SELECT *, coalesce(found <> lag(found) OVER (PARTITION BY user_id, id ORDER BY k), false) AS changed, CASE WHEN found <= 2 THEN 1 ELSE found END = CASE WHEN wanted <= 2 THEN 1 ELSE wanted END AS hit FROM fd),
sm AS (SELECT id, (count(*) FILTER (found = wanted))::DOUBLE / count(*) AS d, (count(*) FILTER (hit))::DOUBLE / count(*) AS r, (count(*) FILTER (changed))::DOUBLE / count(*) AS c FROM ch GROUP BY id)
SELECT id, floor(d * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS detailed, floor(r * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS root, floor(c * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS change_rate, floor((d + r * 0.25::DOUBLE - c * 0.02::DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS score FROM sm
""")
def candidate_screening(spark, sf_dir):
    """Six named candidates and 32 drawn ones over every user's windows."""
    found = calibration.screened(judged(spark, sf_dir), calibration.candidates(spark, SEED, DRAWN), "user_id", [0, 0, 9, 5, None])
    return found.select("id", *[half_up(F.col(c), 6).alias(c) for c in ("detailed", "root", "change_rate", "score")])


ENGINES_SQL = "eg AS (SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{name}', {str(adaptive).lower()}, '{kind}', {share}::DOUBLE, {'NULL' if fixed is None else fixed}::DOUBLE, {', '.join(f'{v}::DOUBLE' for v in ({**calibration.BASE, **other}).values())})"
    for k, (name, other, adaptive, kind, share, fixed) in enumerate(calibration.ENGINES)
) + ") t(place, id, adaptive, calibration, rs, fx, lw, ow, aw, ll, me, pr, mx)),\n"


@query(WINDOWS_SQL + "," + ENGINES_SQL + """vt AS (SELECT user_id, k, i, sc, cf, mg, (user_id + k // 6) % 4 + 1 AS wanted, CASE WHEN user_id % 2 = 0 THEN 0.9::DOUBLE ELSE 1.4::DOUBLE END AS t, list_transform(range(1, 6), lambda j: (i * (3 * j + 2) % 13 + 1 + CASE WHEN j = de THEN 8 ELSE 0 END)::DOUBLE) AS v FROM ob),
lp AS (SELECT *, list_transform(v, lambda x: x / list_sum(v)) AS p FROM vt),
tp2 AS (SELECT *, list_transform(p, lambda x: power(x, 1 / t)) AS q FROM lp),
wn AS (SELECT *, list_transform(q, lambda x: x / list_sum(q)) AS z, list_max(p) * 2 AS top, (i % 10)::DOUBLE / 10.0::DOUBLE AS en, i % 9 AS fr, CASE WHEN i % 2 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS ag, CASE i % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.65::DOUBLE ELSE 0.25::DOUBLE END AS fl, i % 5 < 3 AS fm FROM tp2),
am AS (SELECT wn.*, eg.*, 1 - greatest(0, least(1, mg / 0.1::DOUBLE)) AS am, 1 - greatest(0, least(1, cf / pr)) AS ac FROM wn, eg),
ww AS (SELECT *, CASE WHEN NOT adaptive THEN CASE WHEN fr > 0 THEN lw ELSE 0 END WHEN fr > 0 AND top >= ll AND en < me THEN least(greatest(lw * (0.35::DOUBLE + 0.65::DOUBLE * greatest(0, least(1, (top - ll) / (1 - ll)))) * greatest(0, least(1, (me - en) / me)) * (0.675::DOUBLE + 0.325::DOUBLE * am)
    * ((0.35::DOUBLE + 0.65::DOUBLE * (am + ac) / 2) / (0.675::DOUBLE + 0.325::DOUBLE * am)) * CASE WHEN cf <= pr THEN 1 ELSE greatest(0, least(1, (0.9::DOUBLE - cf) / (0.9::DOUBLE - pr))) END * ag * fl, 0), CASE WHEN fm THEN 0.3::DOUBLE ELSE mx END) ELSE 0 END AS w FROM am),
mx AS (SELECT user_id, k, place, id, wanted, coalesce(fx, w) AS w, list_transform(range(1, 6), lambda j: rs * sc[j] + coalesce(fx, w) * CASE WHEN calibration = 'temperature' THEN z[j] ELSE p[j] END) AS s FROM ww),
fd AS (SELECT *, list_position(s, list_max(s)) AS found FROM mx),
ch AS (SELECT *, coalesce(found <> lag(found) OVER (PARTITION BY user_id, id ORDER BY k), true) AS begins, found <> first_value(found) OVER (PARTITION BY user_id, k ORDER BY place) AS differs, CASE WHEN found <= 2 THEN 1 ELSE found END = CASE WHEN wanted <= 2 THEN 1 ELSE wanted END AS hit FROM fd),
sm AS (SELECT user_id, place, id, count(*) AS n, (count(*) FILTER (found = wanted))::DOUBLE / count(*) AS d, (count(*) FILTER (hit))::DOUBLE / count(*) AS r, count(*) FILTER (begins) AS regions, count(*) FILTER (differs) AS differs, (count(*) FILTER (w > 0))::DOUBLE / count(*) AS u FROM ch GROUP BY ALL),
fn AS (SELECT *, d - max(d) FILTER (place = 0) OVER (PARTITION BY user_id) AS g, row_number() OVER (PARTITION BY user_id ORDER BY d DESC, place) AS rank FROM sm)
SELECT user_id, id AS engine, floor(d * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS detailed, floor(r * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS root, regions, floor(differs::DOUBLE / n * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS differs, floor(u * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS learned, floor(g * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS gain, CAST(rank AS INTEGER) AS rank FROM fn
""")
def engine_comparison(spark, sf_dir):
    """Seven engines, rules alone first, on every user's windows in one scan."""
    found = calibration.compared(judged(spark, sf_dir), "user_id", [0, 0, 9, 5, None])
    differs = F.col("differs") / F.col("seconds")
    return found.select("user_id", "engine", *[half_up(F.col(c), 6).alias(c) for c in ("detailed", "root")], "regions", half_up(differs, 6).alias("differs"), *[half_up(F.col(c), 6).alias(c) for c in ("learned", "gain")], "rank")


ACTIONS = ("apply", "no-chord", "split", "merge-previous", "merge-next", "unknown")


@query("""
WITH RECURSIVE ev AS (
    SELECT user_id, event_id AS i, event_type AS label, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS k FROM events
), rg AS (
    SELECT user_id, list({'s': k * 2.0::DOUBLE, 'e': (k + 1) * 2.0::DOUBLE, 'l': label, 'z': false} ORDER BY k) AS rs FROM ev WHERE i % 2 = 0 GROUP BY user_id
), lg AS (
    SELECT user_id, k, i * 7 % 60 - 3 AS p, i % 6 AS a, CASE WHEN i % 12 > 0 THEN label || '*' END AS label, (i * 7 % 60 - 3) * 2.0::DOUBLE + (i % 9)::DOUBLE / 4.0::DOUBLE AS x, i % 4 = 1 AS z FROM ev WHERE i % 2 = 1
), fo AS (
    SELECT user_id, 0::BIGINT AS k, rs FROM rg
    UNION ALL
    SELECT user_id, k + 1, CASE WHEN NOT here THEN rs
        WHEN a = 0 AND label IS NOT NULL THEN rs[1:p] || [{'s': o.s, 'e': o.e, 'l': label, 'z': z}] || rs[p + 2:len(rs)] WHEN a = 1 THEN rs[1:p] || [{'s': o.s, 'e': o.e, 'l': 'N', 'z': true}] || rs[p + 2:len(rs)]
        WHEN a = 2 AND x > o.s + 0.1::DOUBLE AND x < o.e - 0.1::DOUBLE THEN rs[1:p] || [{'s': o.s, 'e': x, 'l': o.l, 'z': true}, {'s': x, 'e': o.e, 'l': o.l, 'z': true}] || rs[p + 2:len(rs)]
        WHEN a = 3 AND p > 0 THEN rs[1:p - 1] || [{'s': rs[p].s, 'e': o.e, 'l': o.l, 'z': o.z OR rs[p].z}] || rs[p + 2:len(rs)] WHEN a = 4 AND p + 1 < len(rs) THEN rs[1:p] || [{'s': o.s, 'e': rs[p + 2].e, 'l': o.l, 'z': o.z OR rs[p + 2].z}] || rs[p + 3:len(rs)]
        ELSE rs END FROM (SELECT fo.user_id, fo.k, fo.rs, lg.p, lg.a, lg.label, lg.x, lg.z, lg.p >= 0 AND lg.p < len(fo.rs) AS here, fo.rs[greatest(lg.p, 0) + 1] AS o FROM fo JOIN lg ON lg.user_id = fo.user_id AND lg.k = fo.k)
), dn AS (
    SELECT user_id, rs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM fo) WHERE r = 1
), un AS (
    SELECT user_id, unnest(rs) AS o, generate_subscripts(rs, 1) - 1 AS place FROM dn
)
SELECT user_id, place, o.s AS start, o.e AS "end", o.l AS label, o.z AS locked FROM un
""")
def region_edits(spark, sf_dir):
    """Each user's even events as regions of two seconds, and the odd ones as edits of them, many of which change nothing."""
    i, k = F.col("event_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    given = events.where("event_id % 2 = 0").select("user_id", (k * 2.0).alias("start"), ((k + 1) * 2.0).alias("end"), F.col("event_type").alias("label"), F.lit(False).alias("locked"))
    place = i * 7 % 60 - 3
    action = F.element_at(F.array(*[F.lit("unknown" if a == "unknown" else a) for a in ACTIONS]), (i % 6 + 1).cast("int"))
    log = events.where("event_id % 2 = 1").select("user_id", k.alias("seq"), place.alias("place"), action.alias("action"), F.when(i % 12 > 0, F.concat("event_type", F.lit("*"))).alias("label"), (place * 2.0 + i % 9 / F.lit(4.0)).alias("at"), (i % 4 == 1).alias("locked"))
    return edits.edited(given, log, "user_id")
