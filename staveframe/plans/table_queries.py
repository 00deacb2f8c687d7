"""Queries on the other tables: vectors, scores, roll-ups, choices, splits and labels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staveframe.functions import labels as L
from staveframe.functions import scalars as X
from staveframe.operators import intervals as I
from staveframe.operators import scores as C
from staveframe.operators import sequences as S
from staveframe.operators import tracks as T
from staveframe.plans.roles import chord_of, micros, notes, table, timeline, track_notes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name; ``sql`` gives the same rows, or is empty where SQL can't express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def half_up_sql(x: str, places: int = 4) -> str:
    return f"floor(({x}) * 1e{places}::DOUBLE + 0.5::DOUBLE) / 1e{places}::DOUBLE"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))


V_SQL = "WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings) "


@query(V_SQL + f"""
, p AS (SELECT *, row_number() OVER (ORDER BY id) AS place FROM v), g AS (SELECT unnest([4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60, 64]) AS lag),
s AS (SELECT a.id, g.lag, {half_up_sql('list_cosine_similarity(a.vector, b.vector)', 6)} AS sim FROM p a, g, p b WHERE b.place = a.place - g.lag)
SELECT id, arg_min(lag, (-sim, lag)) AS lag, max(sim) AS similarity FROM s WHERE sim >= 0.25 GROUP BY id
""")
def fixed_lag_similarity(spark, sf_dir):
    # The ids of the table are its places in time: dense ranks by a window over ids alone, without the vectors.
    v = _vectors(spark, sf_dir)
    shares = v.select("id", F.floor(F.col("id") / 4096).alias("block"))
    sizes = shares.groupBy("block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = shares.join(F.broadcast(before.select("block", "before")), "block").select("id", (F.row_number().over(W.partitionBy("block").orderBy("id")) + F.col("before")).alias("place"))
    rows = v.join(placed, "id")
    return S.fixed_lag_matches(rows, "vector", list(range(4, 65, 4)), 0.25, lambda a, b: X.half_up(X.cosine(a, b), 6))


@query(V_SQL + f"""
, u AS (SELECT label, generate_subscripts(vector, 1) AS i, unnest(vector) AS x FROM v), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL)
SELECT label, i - 1 AS i, {half_up_sql('x', 6)} AS mean FROM m
""")
def vector_mean_by_label(spark, sf_dir):
    mean = I.vector_mean(_vectors(spark, sf_dir), ["label"])
    return mean.select("label", F.posexplode("mean").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), X.half_up(F.col("x"), 6).alias("mean"))


@query(V_SQL + f"""
, t AS (SELECT label AS name, vector FROM v WHERE id IN (SELECT min(id) FROM v GROUP BY label)),
s AS (SELECT v.id, t.name, {half_up_sql('list_cosine_similarity(v.vector, t.vector)', 9)} AS s FROM v, t),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, name) AS k FROM s)
SELECT id, max(name) FILTER (k = 1) AS best, max(name) FILTER (k = 2) AS second, {half_up_sql('max(s) FILTER (k = 1)', 6)} AS score, {half_up_sql('max(s) FILTER (k = 1) - max(s) FILTER (k = 2)', 6)} AS margin FROM r GROUP BY id
""")
def template_top2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    templates = v.groupBy("label").agg(F.min_by("vector", "id").alias("vector")).select(F.col("label").alias("place"), F.col("label").alias("name"), "vector")
    found = C.template_ranks(v.select("id", "vector"), templates)
    return found.withColumns({"score": X.half_up(F.col("score"), 6), "margin": X.half_up(F.col("margin"), 6)})


@query(V_SQL + f"""
, x AS (SELECT id, list_transform(vector, lambda a: exp((a - list_max(vector)) / 0.12::DOUBLE)) AS w FROM v), p AS (SELECT id, list_transform(w, lambda a: a / list_sum(w)) AS p FROM x)
SELECT id, {half_up_sql('list_max(p)', 6)} AS top, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS winner,
    {half_up_sql('-list_sum(list_transform(p, lambda a: CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END)) / ln(len(p))', 6)} AS entropy FROM p
""")
def softmax_entropy(spark, sf_dir):
    p = _vectors(spark, sf_dir).select("id", X.softmax(F.col("vector"), 0.12).alias("p"))
    return p.select("id", X.half_up(F.array_max("p"), 6).alias("top"), X.argmax(F.col("p")).alias("winner"), X.half_up(X.entropy(F.col("p")), 6).alias("entropy"))


@query(V_SQL + f"""
, c AS (SELECT id, list_transform(vector[1:12], lambda a: greatest(a, 0)) AS c FROM v), s AS (SELECT id, c, list_reverse_sort(c) AS o FROM c)
SELECT id, CASE WHEN o[1] > 0 THEN CAST(list_position(c, o[1]) - 1 AS INTEGER) END AS pitch_class, {half_up_sql('greatest(0, least(1, 1.8::DOUBLE * o[1] + 1.8::DOUBLE * (o[1] - o[2])))', 6)} AS confidence,
    {half_up_sql('sqrt(list_sum(list_transform(c, lambda a: a * a)) / 12)', 6)} AS rms FROM s
""")
def strongest_pitch(spark, sf_dir):
    c = _vectors(spark, sf_dir).select("id", F.transform(F.slice("vector", 1, 12), lambda a: F.greatest(a, F.lit(0.0))).alias("c"))
    found = c.select("id", X.strongest_pitch(F.col("c")).alias("s"), X.half_up(X.rms(F.col("c")), 6).alias("rms"))
    return found.select("id", F.col("s.pitch_class").alias("pitch_class"), X.half_up(F.col("s.confidence"), 6).alias("confidence"), "rms")


POINTS_SQL = "WITH q AS (SELECT l.doc_id, l.quality, least(1, n_chars / 6000.0::DOUBLE) AS c FROM labels l JOIN documents d ON d.doc_id = l.doc_id) "


def _points(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 6000.0).alias("confidence"))
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")


@query(POINTS_SQL + f"""
, b AS (SELECT CAST(least(9, floor(c * 10)) AS INTEGER) AS bin, count(*) AS n, avg(c) AS c, avg(quality::DOUBLE) AS a FROM q GROUP BY 1)
SELECT CAST(r AS INTEGER) AS bin, coalesce(n, 0) AS n, {half_up_sql('coalesce(c, 0)', 6)} AS confidence, {half_up_sql('coalesce(a, 0)', 6)} AS accuracy FROM range(10) t(r) LEFT JOIN b ON b.bin = r
""")
def reliability_bins(spark, sf_dir):
    found = C.reliability(_points(spark, sf_dir).withColumn("right", F.col("quality") == 1))
    return found.withColumns({"confidence": X.half_up(F.col("confidence"), 6), "accuracy": X.half_up(F.col("accuracy"), 6)})


@query(POINTS_SQL + f"""
, b AS (SELECT least(9, floor(c * 10)) AS bin, count(*) AS n, avg(c) AS c, avg(quality::DOUBLE) AS a FROM q GROUP BY 1) SELECT {half_up_sql('sum(n * abs(a - c)) / sum(n)', 6)} AS ece FROM b
""")
def calibration_error(spark, sf_dir):
    return C.calibration_error(C.reliability(_points(spark, sf_dir).withColumn("right", F.col("quality") == 1))).withColumn("ece", X.half_up(F.col("ece"), 6))


@query(POINTS_SQL + f"""
, g AS (SELECT unnest([0.5, 0.75, 0.9, 1.0, 1.25, 1.5, 2.0]::DOUBLE[]) AS t), f AS (SELECT doc_id % 4 AS fold, t, avg(-ln(greatest(1e-9::DOUBLE, CASE WHEN quality = 1 THEN pow(c, t) ELSE 1 - pow(c, t) END))) AS loss FROM q, g GROUP BY ALL)
SELECT fold, arg_min(t, (floor(loss * 1e9 + 0.5), abs(t - 1), t)) AS choice, {half_up_sql('min(loss)', 6)} AS loss FROM f GROUP BY fold
""")
def grid_argmin(spark, sf_dir):
    rows = _points(spark, sf_dir).withColumn("fold", F.col("doc_id") % 4)
    loss = lambda t: -F.ln(F.greatest(F.lit(1e-9), F.when(F.col("quality") == 1, F.pow("confidence", t)).otherwise(1 - F.pow("confidence", t))))
    return C.grid_argmin(rows, ["fold"], [0.5, 0.75, 0.9, 1.0, 1.25, 1.5, 2.0], loss).withColumn("loss", X.half_up(F.col("loss"), 6))


CANDIDATES_SQL = """WITH s AS (SELECT l_suppkey AS id, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue, floor(avg(l_quantity) * 100 + 0.5) AS quantity, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) """


def _candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("id")).agg(
        F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 0.5).cast("double").alias("revenue"), F.floor(F.avg("l_quantity") * 100 + 0.5).cast("double").alias("quantity"), F.count_if(F.col("l_returnflag") == "R").alias("returned")
    )


@query(CANDIDATES_SQL + "SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.revenue >= a.revenue AND b.quantity >= a.quantity AND b.returned <= a.returned AND (b.revenue > a.revenue OR b.quantity > a.quantity OR b.returned < a.returned))")
def skyline(spark, sf_dir):
    return C.skyline(_candidates(spark, sf_dir), ["revenue", "quantity"], ["returned"])


@query("""
WITH s AS (SELECT l_suppkey AS id, avg(l_discount) AS d, sum(TRY_CAST(l_discount AS DECIMAL(18,8))) <= count(l_discount) * 0.0505 AS low FROM lineitem GROUP BY l_suppkey, l_returnflag)
SELECT id FROM s GROUP BY id HAVING bool_and(coalesce(CASE WHEN isfinite(d) THEN low ELSE d <= 0.0505::DOUBLE END, true))
""")
def limits_filter(spark, sf_dir):
    # Decimals: many means are the limit itself, and one of doubles lies beside it by the order of rows.
    low = F.sum(F.col("l_discount").try_cast("decimal(18,8)")) <= F.count("l_discount") * F.lit(Decimal("0.0505"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), "l_returnflag").agg(F.avg("l_discount").alias("d"), low.alias("low"))
    return C.within_limits(rows, "id", F.when(F.abs("d") < float("inf"), F.col("low")).otherwise(F.col("d") <= 0.0505))


@query(CANDIDATES_SQL + "SELECT id, revenue, quantity, returned FROM s ORDER BY quantity DESC, revenue DESC, returned, id LIMIT 5")
def candidate_selection(spark, sf_dir):
    """The five best candidates by four keys; the limit is the operator's meaning."""
    return _candidates(spark, sf_dir).orderBy(F.desc("quantity"), F.desc("revenue"), "returned", "id").limit(5)


@query(f"""
WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS value FROM orders GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (b.value - a.value > 1e-9) AS improved, count(*) FILTER (abs(b.value - a.value) <= 1e-9) AS tied, count(*) FILTER (b.value - a.value < -1e-9) AS worsened,
    {half_up_sql('avg(b.value - a.value)', 2)} AS difference FROM y a JOIN y b USING (k) WHERE a.y = 1996 AND b.y = 1997
""")
def paired_difference(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("value"))
    return C.paired_difference(y.where("y = 1996"), y.where("y = 1997"), "k").withColumn("difference", X.half_up(F.col("difference"), 2))


@query("""
WITH a AS (SELECT c_nationkey AS k, count(*) % 3 AS m FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) % 3 AS m FROM supplier GROUP BY 1)
SELECT k, CASE WHEN a.m IS NULL THEN 'only right' WHEN b.m IS NULL THEN 'only left' ELSE 'differs' END AS reason FROM a FULL JOIN b USING (k) WHERE a.m IS DISTINCT FROM b.m
""")
def cross_key_check(spark, sf_dir):
    side = lambda t, c: table(spark, sf_dir, t).groupBy(F.col(c).alias("k")).agg((F.count("*") % 3).alias("m"))
    return C.key_mismatches(side("customer", "c_nationkey"), side("supplier", "s_nationkey"), "k", ["m"])


@query("""
WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier)
SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT k, 'right' FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)
""")
def multiset_equality(spark, sf_dir):
    return C.multiset_difference(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query(f"""
SELECT l_returnflag AS flag, l_linestatus AS status, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n, {half_up_sql('avg(l_quantity)')} AS quantity, {half_up_sql('sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice)')} AS kept
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))
""")
def corpus_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    sets = li.groupingSets([["flag"], ["status"], ["flag", "status"]], "flag", "status")
    kept = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_extendedprice")
    return sets.agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"), X.half_up(F.avg("l_quantity")).alias("quantity"), X.half_up(kept).alias("kept"))


@query(f"""
SELECT n_name AS name, count(DISTINCT l_orderkey) AS songs, count(*) AS occurrences, {half_up_sql('sum(l_quantity)', 2)} AS seconds, count(DISTINCT l_orderkey) >= 3 AS is_recurring
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag = 'R' GROUP BY 1
""")
def recurring_errors(spark, sf_dir):
    # Supplier and nation are dimensions; Spark broadcasts them if their size allows.
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("name"))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_orderkey", "l_quantity")
    return C.recurring(li.join(names, F.col("l_suppkey") == F.col("s_suppkey")), "name", "l_orderkey", "l_quantity").withColumn("seconds", X.half_up(F.col("seconds"), 2))


@query(f"SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, {half_up_sql('sum(l_extendedprice * l_discount)', 2)} AS part, {half_up_sql('sum(l_extendedprice)', 2)} AS whole, {half_up_sql('sum(l_extendedprice * l_discount) / sum(l_extendedprice)')} AS ratio FROM lineitem GROUP BY 1")
def weighted_ratio(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_extendedprice", "l_discount")
    found = C.weighted_ratios(li, ["day"], F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice"))
    return found.withColumns({"part": X.half_up(F.col("part"), 2), "whole": X.half_up(F.col("whole"), 2), "ratio": X.half_up(F.col("ratio"))})


@query("SELECT l_suppkey, " + ", ".join(f"{half_up_sql(f'quantile_cont(l_extendedprice, {p})')} AS q{round(100 * p)}" for p in (0.1, 0.5, 0.9)) + f", {half_up_sql('coalesce(median(l_extendedprice), 0)')} AS median_or_zero FROM lineitem GROUP BY 1")
def quantiles(spark, sf_dir):
    found = C.quantiles(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", [0.1, 0.5, 0.9])
    return found.select("l_suppkey", *[X.half_up(F.col(c)).alias(c) for c in found.columns[1:]])


@query("""
WITH k AS (SELECT c_custkey, c_name, CAST(('0x' || substr(sha256('7:' || c_name), 1, 8)) AS BIGINT) % 100 AS share FROM customer)
SELECT c_custkey, share, CASE WHEN share < 70 THEN 'development' WHEN share < 85 THEN 'validation' ELSE 'test' END AS split FROM k
""")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.hash_share(F.col("c_name"), 7).alias("share"), X.hash_split(F.col("c_name"), 7).alias("split"))


@query("""
WITH k AS (SELECT sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_key, source FROM documents WHERE text IS NOT NULL)
SELECT text_key, count(*) AS tracks, list_aggregate(list_sort(list(DISTINCT source)), 'string_agg', ',') AS splits FROM k WHERE text_key <> sha256('') GROUP BY 1 HAVING count(DISTINCT source) > 1
""")
def leakage(spark, sf_dir):
    """Documents of which the whole text, without brackets and signs, stands in more than one source, by its digest."""
    docs = table(spark, sf_dir, "documents")
    return C.text_leakage(docs, "text", "source").withColumn("splits", F.array_join("splits", ","))


@query("""
WITH g AS (SELECT lower(trim(c_mktsegment)) || ' ' || c_nationkey AS artist, CASE WHEN c_custkey % 41 = 0 THEN 'test' WHEN c_custkey % 23 = 0 THEN 'validation' WHEN c_custkey % 17 = 0 THEN 'development' END AS given FROM customer),
s AS (SELECT artist, list(DISTINCT given) FILTER (given IS NOT NULL) AS s FROM g GROUP BY 1), h AS (SELECT *, CAST(('0x' || substr(sha256('11:' || artist), 1, 8)) AS BIGINT) % 100 AS k FROM s)
SELECT artist, coalesce(CASE WHEN list_contains(s, 'test') THEN 'test' WHEN list_contains(s, 'validation') THEN 'validation' WHEN list_contains(s, 'development') THEN 'development' END,
    CASE WHEN k < 70 THEN 'development' WHEN k < 85 THEN 'validation' ELSE 'test' END) AS split, coalesce(len(s), 0) > 1 AS conflict FROM h
""")
def assigned_splits(spark, sf_dir):
    """All customers, of whom few have a split of their own; segment and nation stand for the artist."""
    k = F.col("c_custkey")
    given = F.when(k % 41 == 0, "test").when(k % 23 == 0, "validation").when(k % 17 == 0, "development")
    return C.assigned_splits(table(spark, sf_dir, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("artist"), given.alias("given")), "artist", "given", 11)


@query("""
WITH n AS (SELECT user_id, CASE WHEN value > 60 THEN 'long' WHEN value > 5 THEN 'medium' ELSE 'short' END || ' ' || event_type AS name, value FROM events), e AS (SELECT user_id, name, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS seconds FROM n GROUP BY ALL),
t AS (SELECT a || ' ' || b AS name FROM (VALUES ('long'), ('medium'), ('short')) x(a), (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) y(b)), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, t.name, CAST(coalesce(e.n, 0) AS BIGINT) AS n, coalesce(e.seconds, 0)::DOUBLE AS seconds FROM u CROSS JOIN t LEFT JOIN e ON e.user_id = u.user_id AND e.name = t.name
""")
def taxonomy_merge(spark, sf_dir):
    """All events by kind and length, with zeros for the classes that a user lacks."""
    sizes = F.when(F.col("value") > 60, "long").when(F.col("value") > 5, "medium").otherwise("short")
    rows = table(spark, sf_dir, "events").select("user_id", F.concat_ws(" ", sizes, "event_type").alias("name"), F.lit(1).cast("long").alias("n"), F.col("value").alias("seconds"))
    return C.zero_filled(rows, "user_id", [f"{a} {b}" for a in ("long", "medium", "short") for b in KINDS]).withColumn("seconds", F.floor(F.col("seconds") * 100 + 0.5) / 100)

@query("""
WITH a AS (SELECT 'performer' AS kind, CAST(c_nationkey AS VARCHAR) AS name, count(DISTINCT c_custkey % 5) AS n FROM customer GROUP BY 2 HAVING count(DISTINCT c_custkey % 5) <> 1),
b AS (SELECT 'track' AS kind, c_name AS name, count(DISTINCT c_custkey % 5) AS n FROM customer GROUP BY 2 HAVING count(DISTINCT c_custkey % 5) <> 1) SELECT * FROM a UNION ALL SELECT * FROM b
""")
def folds_check(spark, sf_dir):
    return C.folds_check(table(spark, sf_dir, "customer").withColumn("fold", F.col("c_custkey") % 5), "c_nationkey", "fold", "c_name")


CHORDS_SQL = """WITH c AS (SELECT p_partkey AS id, (['C','C#','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B','H','N',''])[p_size % 16 + 1] AS r, (['','m','7','maj7','m7','dim','sus4','min','?'])[p_partkey % 9 + 1] AS q, CASE WHEN p_partkey % 4 = 0 THEN '/G' ELSE '' END AS b FROM part),
x AS (SELECT id, r, CASE WHEN r IN ('N','') THEN '' ELSE q END AS q, CASE WHEN r IN ('N','') THEN '' ELSE b END AS b, ((CASE left(r, 1) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END
    + CASE substr(r, 2, 1) WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END) + 12) % 12 AS p FROM c) """


def _chords(spark, sf_dir):
    roots = F.array(*[F.lit(x) for x in ("C", "C#", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B", "H", "N", "")])
    forms = F.array(*[F.lit(x) for x in ("", "m", "7", "maj7", "m7", "dim", "sus4", "min", "?")])
    r = F.element_at(roots, F.col("p_size") % 16 + 1)
    form = F.concat(F.element_at(forms, (F.col("p_partkey") % 9 + 1).cast("int")), F.when(F.col("p_partkey") % 4 == 0, "/G").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(r, F.when(r.isin("N", ""), "").otherwise(form)).alias("chord"))


@query(CHORDS_SQL + """
, k AS (SELECT *, r IN ('N', '') AS none, p IS NOT NULL AND q <> '?' AS ok, CASE WHEN q = 'min' THEN 'm' ELSE q END AS f, q IN ('m', 'min', 'm7', 'dim') AS mi FROM x)
SELECT id, r || q || b AS chord, none OR ok AS strict_ok,
    CASE WHEN none THEN 'N' WHEN ok THEN (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[p + 1] || f || CASE WHEN b <> '' AND p <> 7 THEN '/G' ELSE '' END END AS strict,
    CASE WHEN none OR NOT ok THEN 'N' ELSE (['C','C#','D','Eb','E','F','F#','G','Ab','A','Bb','B'])[p + 1] || f END AS lenient,
    CASE WHEN none THEN 'N' WHEN p IS NULL THEN 'X' ELSE (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[p + 1] || CASE WHEN mi THEN ':min' ELSE ':maj' END END AS majmin,
    CASE WHEN none THEN 'N' WHEN ok THEN (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[(p + 3) % 12 + 1] || f || CASE WHEN b <> '' AND p <> 7 THEN '/A#' ELSE '' END END AS moved FROM k
""")
def label_parse(spark, sf_dir):
    c = F.col("chord")
    return _chords(spark, sf_dir).select("id", "chord", L.strict(c)["ok"].alias("strict_ok"), L.strict(c)["symbol"].alias("strict"), L.lenient(c)["symbol"].alias("lenient"), L.annotated(c)["majmin"].alias("majmin"), L.transposed(c, 3).alias("moved"))


@query("""
WITH n AS (SELECT p_partkey AS id, 40 + p_size AS midi FROM part)
SELECT id, (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[midi % 12 + 1] || CAST(midi // 12 - 1 AS VARCHAR) AS name,
    len(list_filter([40, 45, 50, 55, 59, 64], lambda o: midi - o BETWEEN 0 AND 20)) AS positions, CAST(midi // 60 AS VARCHAR) || ':' || lpad(CAST(midi % 60 AS VARCHAR), 2, '0') AS clock FROM n
""")
def note_names(spark, sf_dir):
    midi = F.col("p_size") + 40
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.note_name(midi).alias("name"), F.size(X.fret_positions(midi)).cast("long").alias("positions"), X.clock(midi.cast("double")).alias("clock"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256(props) AS digest FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.sha2("props", 256).alias("digest"))


@query(f"""
WITH c AS (SELECT event_type AS label, sum(value) AS s, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(s) AS a, sum(n) AS b, count(*) AS k FROM c)
SELECT label, {half_up_sql('s / a', 6)} AS share, {half_up_sql('b::DOUBLE / (k * (n + 1))::DOUBLE', 6)} AS weight FROM c, t
""")
def class_distribution(spark, sf_dir):
    found = C.class_weights(table(spark, sf_dir, "events"), "event_type", "value")
    return found.select(F.col("event_type").alias("label"), X.half_up(F.col("share"), 6).alias("share"), X.half_up(F.col("weight"), 6).alias("weight"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3")
def common_success(spark, sf_dir):
    return C.common_success(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus"), "k", "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1")
def version_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return S.first_per(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"""
WITH f AS (SELECT user_id, event_id, value, list_transform([1, 2, 3, 4], lambda i: (value * i * 7) % 11) AS v, max(value) OVER (PARTITION BY user_id) AS peak FROM events),
u AS (SELECT user_id, value, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM f WHERE value >= greatest(0.004::DOUBLE, 0.15::DOUBLE * peak)),
m AS (SELECT user_id, i, 0.35::DOUBLE * median(x) + 0.65::DOUBLE * sum(x * value) / sum(value) AS x FROM u GROUP BY ALL), t AS (SELECT user_id, sum(x) AS t FROM m GROUP BY 1)
SELECT user_id, i, {half_up_sql('x / t', 6)} AS share FROM m JOIN t USING (user_id)
""")
def robust_chroma(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("user_id", F.array(*[F.pmod(F.col("value") * i * 7, F.lit(11)).cast("double") for i in (1, 2, 3, 4)]).alias("vector"), F.col("value").alias("level"))
    found = C.robust_mean(frames, ["user_id"])
    return found.select("user_id", F.posexplode("chroma").alias("i", "x")).select("user_id", F.col("i").cast("long").alias("i"), X.half_up(F.col("x"), 6).alias("share"))


KINDS = ("click", "error", "purchase", "signup", "view")
KINDS_SQL = "['click', 'error', 'purchase', 'signup', 'view']"
#: A user's events in order, for SQL that goes on from one to the next.
ORDERED_SQL = "WITH RECURSIVE o AS (SELECT event_id AS id, user_id, event_type AS label, value AS score, epoch_us(ts) AS x, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS k FROM events),"
#: Of the list ``rs`` of times on the right, the place of the nearest unused one to ``x`` within ``tol``, the first among equals.
NEAREST_SQL = "struct_extract(list_sort(list_transform(list_filter(range(1, len(rs) + 1), lambda j: abs(rs[j] - x) <= tol AND NOT list_contains(used, j)), lambda j: {'d': abs(rs[j] - x), 'j': j}))[1], 'j')"


@query(ORDERED_SQL + f"""
f AS (SELECT user_id, k, list_transform({KINDS_SQL}, lambda z: CASE WHEN z = label THEN ln(1 + score) ELSE 0::DOUBLE END) AS s FROM o),
b AS (SELECT user_id, k, s AS best, []::BIGINT[] AS back FROM f WHERE k = 0 UNION ALL
    SELECT f.user_id, f.k, list_transform(range(1, 6), lambda j: greatest(b.best[j], list_max(b.best) - 4) + f.s[j]), list_transform(range(1, 6), lambda j: CASE WHEN b.best[j] >= list_max(b.best) - 4 THEN j ELSE CAST(list_position(b.best, list_max(b.best)) AS BIGINT) END)
    FROM b JOIN f ON f.user_id = b.user_id AND f.k = b.k + 1),
q AS (SELECT user_id, k, CAST(list_position(best, list_max(best)) AS BIGINT) AS j FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS z FROM b) WHERE z = 1 UNION ALL
    SELECT b.user_id, b.k - 1, b.back[q.j] FROM q JOIN b ON b.user_id = q.user_id AND b.k = q.k WHERE b.k > 0)
SELECT user_id, k AS place, ({KINDS_SQL})[j] AS label FROM q
""")
def viterbi(spark, sf_dir):
    """Best path of event types over each user's events; a type scores the event's value and a bit for what it is."""
    rows = T.numbered(notes(spark, sf_dir), "user_id")
    scores = F.array(*[F.when(F.col("label") == k, F.ln(1 + F.col("score"))).otherwise(0.0) for k in KINDS])
    return T.viterbi_labels(rows.withColumn("scores", scores), "user_id", list(KINDS), 4.0)


@query(ORDERED_SQL + f"""
a AS (SELECT user_id, label, id, x, row_number() OVER (PARTITION BY user_id, label ORDER BY x, id) AS i FROM o WHERE id % 2 = 0),
r AS (SELECT user_id, label, list(x ORDER BY x, id) AS rs, list(id ORDER BY x, id) AS ids FROM o WHERE id % 2 = 1 GROUP BY ALL),
g AS (SELECT user_id, label, 0::BIGINT AS i, 0::BIGINT AS left_id, NULL::BIGINT AS got, []::BIGINT[] AS used FROM r UNION ALL
    SELECT user_id, label, i, left_id, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END FROM (
        SELECT user_id, label, i, left_id, used, {NEAREST_SQL} AS got FROM (SELECT a.user_id, a.label, a.i, a.id AS left_id, a.x, r.rs, g.used, 43200000000 AS tol FROM g JOIN a ON a.user_id = g.user_id AND a.label = g.label AND a.i = g.i + 1 JOIN r ON r.user_id = g.user_id AND r.label = g.label)))
SELECT g.user_id, g.label, g.left_id, r.ids[g.got] AS right_id FROM g JOIN r USING (user_id, label) WHERE g.got IS NOT NULL
""")
def greedy_match(spark, sf_dir):
    n = notes(spark, sf_dir).select("user_id", "label", "id", "at")
    return T.greedy_matches(n.where("id % 2 = 0"), n.where("id % 2 = 1"), ["user_id", "label"], 12.0 * 3_600_000_000)


@query(ORDERED_SQL + f"""
t AS (SELECT unnest([3600000000, 14400000000]) AS tol),
a AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY x) AS i FROM o SEMI JOIN (SELECT user_id, x FROM o WHERE id % 2 = 0) USING (user_id, x)),
r AS (SELECT user_id, list(x ORDER BY x) AS rs FROM o WHERE id % 2 = 1 GROUP BY ALL),
g AS (SELECT user_id, tol, 0::BIGINT AS i, NULL::BIGINT AS got, []::BIGINT[] AS used FROM r, t UNION ALL
    SELECT user_id, tol, i, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END FROM (
        SELECT user_id, tol, i, used, {NEAREST_SQL} AS got FROM (SELECT a.user_id, g.tol, a.i, a.x, r.rs, g.used FROM g JOIN a ON a.user_id = g.user_id AND a.i = g.i + 1 JOIN r ON r.user_id = g.user_id))),
c AS (SELECT user_id, tol, count(got) AS n FROM g GROUP BY ALL), l AS (SELECT user_id, count(*) AS nl FROM a GROUP BY 1), u AS (SELECT DISTINCT user_id FROM o),
s AS (SELECT u.user_id, t.tol, CASE WHEN r.rs IS NULL THEN 0::DOUBLE ELSE coalesce(n, 0)::DOUBLE / len(r.rs) END AS p, CASE WHEN nl IS NULL THEN 0::DOUBLE ELSE coalesce(n, 0)::DOUBLE / nl END AS r FROM u CROSS JOIN t LEFT JOIN r ON r.user_id = u.user_id LEFT JOIN l ON l.user_id = u.user_id LEFT JOIN c ON c.user_id = u.user_id AND c.tol = t.tol)
SELECT user_id, tol::DOUBLE AS tolerance, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0::DOUBLE END AS f1 FROM s
""")
def boundary_scores(spark, sf_dir):
    n = notes(spark, sf_dir).select("user_id", "at")
    other = notes(spark, sf_dir)
    return T.boundary_scores(n.where(F.lit(True)).join(other.where("id % 2 = 0").select("user_id", "at"), ["user_id", "at"], "left_semi"), other.where("id % 2 = 1").select("user_id", "at"), "user_id", [3.6e9, 1.44e10])


@query("")
def alignment_dp(spark, sf_dir):
    rows = notes(spark, sf_dir).withColumn("label", chord_of(F.col("score")))
    left, right = (T.numbered(rows.where(F.col("id") % 2 == k), "user_id").select("user_id", "place", "label") for k in (0, 1))
    return T.sequence_alignment(left, right, "user_id")


@query("")
def bootstrap_ci(spark, sf_dir):
    """Confidence of each supplier nation's mean revenue by supplier."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("value"))
    rows = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("nation"), F.col("l_suppkey").alias("id"), "value")
    return T.bootstrap_means(rows, "nation", 20260725, 500)


@query(ORDERED_SQL + """
d AS (SELECT user_id, k, label AS seen, coalesce(lag(label) OVER (PARTITION BY user_id ORDER BY k), label) AS want FROM o),
h AS (SELECT user_id, k, want AS cur, NULL::VARCHAR AS w, NULL::BIGINT AS since, 0::BIGINT AS n, false AS moved FROM d WHERE k = 0 UNION ALL
    SELECT user_id, k, CASE WHEN moved THEN w ELSE cur END, CASE WHEN moved THEN NULL ELSE w END, since, n, moved FROM (SELECT *, coalesce(w IS NOT NULL AND n >= 2 AND k - since >= 1, false) AS moved FROM (
        SELECT user_id, k, cur, w, since, CASE WHEN w IS NULL THEN 0 ELSE CASE WHEN fresh THEN 0 ELSE n END + CASE WHEN seen = w THEN 1 ELSE 0 END END AS n FROM (
            SELECT d.user_id, d.k, d.seen, h.cur, h.n, CASE WHEN d.want <> h.cur THEN d.want END AS w, d.want IS DISTINCT FROM h.w AS fresh, CASE WHEN d.want IS DISTINCT FROM h.w THEN d.k ELSE h.since END AS since FROM h JOIN d ON d.user_id = h.user_id AND d.k = h.k + 1))))
SELECT h.user_id, h.k AS place, coalesce(m.cur, h.cur) AS label FROM h LEFT JOIN h m ON m.moved AND m.user_id = h.user_id AND h.k >= m.since AND h.k < m.k
""")
def hysteresis_labels(spark, sf_dir):
    rows = T.numbered(notes(spark, sf_dir), "user_id")
    decoded = F.coalesce(F.lag("label").over(W.partitionBy("user_id").orderBy("place")), F.col("label"))
    return T.hysteresis(rows.select("user_id", "place", F.col("label").alias("observed"), decoded.alias("decoded")), "user_id", 2)


@query(ORDERED_SQL + f"""
c AS (SELECT user_id, k, label AS cur, NULL::VARCHAR AS rival, NULL::BIGINT AS since, false AS moved, list_transform({KINDS_SQL}, lambda z: CASE WHEN z = label THEN 1 - 0.6::DOUBLE ELSE 0::DOUBLE END) AS held FROM o WHERE k = 0 UNION ALL
    SELECT user_id, k, CASE WHEN moved THEN top ELSE cur END, CASE WHEN ahead AND NOT moved THEN top END, since, moved, held FROM (SELECT *, ahead AND k - since >= 1 AS moved FROM (
        SELECT user_id, k, cur, held, top, ahead, CASE WHEN ahead AND rival IS DISTINCT FROM top THEN k ELSE since END AS since FROM (SELECT *, top <> cur AND list_max(held) - held[list_position({KINDS_SQL}, cur)] >= 0.15::DOUBLE AS ahead FROM (
            SELECT *, ({KINDS_SQL})[6 - list_position(list_reverse(held), list_max(held))] AS top FROM (
                SELECT o.user_id, o.k, c.cur, c.rival, c.since, list_transform(range(1, 6), lambda j: 0.6::DOUBLE * c.held[j] + CASE WHEN ({KINDS_SQL})[j] = o.label THEN 1 - 0.6::DOUBLE ELSE 0::DOUBLE END) AS held FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1))))))
SELECT c.user_id, c.k AS place, coalesce(m.cur, c.cur) AS label FROM c LEFT JOIN c m ON m.moved AND m.user_id = c.user_id AND c.k >= m.since AND c.k < m.k
""")
def confirmed_labels(spark, sf_dir):
    rows = T.numbered(notes(spark, sf_dir), "user_id").select("user_id", "place", F.create_map("label", F.lit(1.0)).alias("candidates"))
    return T.confirmed(rows, "user_id")


@query("")
def settled_runs(spark, sf_dir):
    runs = timeline(spark, sf_dir, 0).select("user_id", F.col("start").alias("place"), "label", ((F.col("end") - F.col("start")) / 3.6e9).alias("length"))
    return T.settled(runs, "user_id", 12.0)


@query(ORDERED_SQL + """
tl AS (SELECT user_id, label, x AS s, lead(x) OVER (PARTITION BY user_id ORDER BY k) AS t FROM o WHERE id % 2 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS i FROM tl WHERE t > s),
g AS (SELECT user_id, i, s, t, label, 1 AS part FROM l WHERE i = 1 UNION ALL
    SELECT user_id, i, s, t, CASE WHEN stays THEN old ELSE label END, CASE WHEN stays THEN part ELSE part + 1 END FROM (SELECT l.*, g.label AS old, g.part, l.t - l.s < 43200000000 OR l.label = g.label AS stays FROM g JOIN l ON l.user_id = g.user_id AND l.i = g.i + 1))
SELECT user_id, min(s) AS start, max(t) AS "end", min(label) AS label FROM g GROUP BY user_id, part
""")
def absorbed_regions(spark, sf_dir):
    return T.absorbed(timeline(spark, sf_dir, 0), "user_id", 12 * 3_600_000_000)


@query("")
def lead_voice(spark, sf_dir):
    return T.lead_voices(track_notes(spark, sf_dir), "track", 0.3)


@query("")
def fret_path(spark, sf_dir):
    rows = T.numbered(track_notes(spark, sf_dir), "track").select("track", "place", "at", "end", "midi")
    return T.fretted(rows, "track")


@query("")
def chord_shapes(spark, sf_dir):
    return T.chord_shapes(track_notes(spark, sf_dir), "track", 0.3)


@query("")
def duration_decoder(spark, sf_dir):
    """Chords of each user's events as windows of half a second, by the duration-aware decoder and its check of changes."""
    labels, roots = ["C", "G", "Am", "F", "N"], [0, 7, 9, 5, -1]
    rows = T.numbered(notes(spark, sf_dir), "user_id")
    part = lambda k: F.pmod(F.col("score") * k, F.lit(1.0))
    windows = rows.select(
        "user_id", "place", (F.col("place") / 2).alias("start"), (F.col("place") / 2 + 0.5).alias("end"), F.array(*[part(k + 1) / (3 if k == 4 else 1) for k in range(5)]).alias("scores"),
        F.when(F.col("place") % 4 == 0, 1.0).when(F.col("place") % 2 == 0, 0.86).otherwise(0.72).alias("strength"), (part(7) < 0.1).alias("uncertain"), part(11).alias("confidence"), (part(13) / 10).alias("margin"),
        part(17).alias("bass_confidence"), part(19).alias("root_strength"), F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 12).cast("int")).alias("tonic"), F.when(F.col("user_id") % 2 == 0, "major").otherwise("minor").alias("mode"),
        F.lit(0.8).alias("key_confidence"), F.lit(0.0).alias("adjustment"),
    )
    return T.decoded_windows(windows, "user_id", labels, roots)


@query(ORDERED_SQL + """
p AS (SELECT user_id, k, score AS used, 0::BIGINT AS "row" FROM o WHERE k = 0 UNION ALL
    SELECT user_id, k, CASE WHEN over THEN score ELSE used + score END, CASE WHEN over THEN "row" + 1 ELSE "row" END FROM (SELECT o.user_id, o.k, o.score, p.used, p."row", p.used <> 0 AND p.used + o.score > 600 AS over FROM p JOIN o ON o.user_id = p.user_id AND o.k = p.k + 1))
SELECT user_id, k AS place, CAST("row" AS INTEGER) AS "row" FROM p
""")
def row_packing(spark, sf_dir):
    return T.packed_rows(T.numbered(notes(spark, sf_dir), "user_id").select("user_id", "place", F.col("score").alias("width")), "user_id", 600.0)


@query("")
def beat_grid(spark, sf_dir):
    return T.beat_grids(T.numbered(notes(spark, sf_dir), "user_id").select("user_id", "place", F.col("score").alias("level")), "user_id", 10.0)


@query(f"""
WITH t AS (SELECT user_id, CAST(sum(TRY_CAST(value AS DECIMAL(28,8))) AS DOUBLE) / 100 AS d, CASE WHEN user_id % 3 <> 0 THEN 0.5::DOUBLE + min(value) / 10 END AS beat, max(value) AS phase FROM events GROUP BY user_id),
b AS (SELECT user_id, d, coalesce(beat, 1) AS b, CASE WHEN beat IS NULL THEN 0::DOUBLE ELSE phase % beat END AS p FROM t), l AS (SELECT *, CASE WHEN p > 0.35::DOUBLE * b THEN p ELSE 0::DOUBLE END AS l FROM b),
n AS (SELECT *, greatest(1, CAST(ceil((d - l) / b - 0.35::DOUBLE) AS BIGINT)) AS n FROM l), k AS (SELECT *, unnest(range(CASE WHEN l > 0 THEN -1 ELSE 0 END, n)) AS k FROM n)
SELECT user_id, CAST(k + CASE WHEN l > 0 THEN 1 ELSE 0 END AS INTEGER) AS idx, {half_up_sql('CASE WHEN k < 0 OR (k = 0 AND l = 0) THEN 0::DOUBLE ELSE p + k * b END')} AS start, {half_up_sql('CASE WHEN k = n - 1 THEN d ELSE p + (k + 1) * b END')} AS "end",
    CASE WHEN (k + 4) % 4 = 0 THEN 1::DOUBLE WHEN (k + 4) % 2 = 0 THEN 0.86::DOUBLE ELSE 0.72::DOUBLE END AS strength FROM k
""")
def beat_windows(spark, sf_dir):
    # Decimals: a sum of doubles depends on their order, which decides at 0.35 of a beat.
    duration = F.sum(F.col("value").try_cast("decimal(28,8)")).cast("double") / 100
    tracks = table(spark, sf_dir, "events").groupBy("user_id").agg(duration.alias("duration"), F.when(F.col("user_id") % 3 != 0, 0.5 + F.min("value") / 10).alias("beat"), F.max("value").alias("phase"))
    return S.beat_windows(tracks, "user_id").withColumns({"start": X.half_up(F.col("start")), "end": X.half_up(F.col("end"))})


@query(f"""
WITH RECURSIVE o AS (SELECT user_id, value, epoch_us(ts) AS x, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
c AS (SELECT user_id, value, x, k, x AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.value, o.x, o.k, CASE WHEN o.x - c.anchor > 28800000000 THEN o.x ELSE c.anchor END FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1),
m AS (SELECT user_id, anchor, avg(value) AS v FROM c GROUP BY ALL), d AS (SELECT user_id, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY anchor)) AS d FROM m)
SELECT user_id, {half_up_sql('coalesce(avg(d), 0)')} AS mean_step, {half_up_sql('coalesce(max(d), 0)')} AS largest_step FROM d GROUP BY user_id
""")
def movement(spark, sf_dir):
    found = S.movement(notes(spark, sf_dir).withColumn("level", F.col("score")), "user_id", 8 * 3_600_000_000)
    return found.select("user_id", X.half_up(F.col("mean_step")).alias("mean_step"), X.half_up(F.col("largest_step")).alias("largest_step"))


@query(f"""
WITH r AS (SELECT event_id AS id, list_transform(range(1, 6), lambda i: (value * i) % 1) AS a, list_transform(range(1, 6), lambda i: (value * (i + 2)) % 1) AS b FROM events),
w AS (SELECT id, list_transform(a, lambda x: exp((x - list_max(a)) / 0.12::DOUBLE)) AS a, list_transform(b, lambda x: exp((x - list_max(b)) / 0.12::DOUBLE)) AS b FROM r),
m AS (SELECT id, list_transform(range(1, 6), lambda j: 0.6::DOUBLE * a[j] / list_sum(a) + 0.4::DOUBLE * b[j] / list_sum(b)) AS m FROM w)
SELECT id, ({KINDS_SQL})[list_position(m, list_max(m))] AS label, {half_up_sql('list_max(m)', 6)} AS score FROM m
""")
def fused_labels(spark, sf_dir):
    n = notes(spark, sf_dir)
    maps = lambda shift: F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.pmod(F.col("score") * (i + shift), F.lit(1.0)) for i in range(1, 6)]))
    return C.fused(n.select("id", maps(0).alias("rules"), maps(2).alias("learned")), F.lit(0.4)).withColumn("score", X.half_up(F.col("score"), 6))
