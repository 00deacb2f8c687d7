import duckdb
import numpy as np
from pyspark.sql import functions as F

from staveframe.llm import hnsw, queries


def clustered(n, seed=1, d=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 : n // 2 + n // 10] = x[: n // 10] + 0.02 * rng.normal(size=(n // 10, d))
    x[-60:] = x[0] + 0.03 * rng.normal(size=(60, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_recall():
    x = clustered(3000)
    g = hnsw.Graph(x)
    beam = g.audited(0.95, 4)
    i, j = g.links_from(x, 0.95, beam)
    found = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a != b}
    s = x @ x.T
    np.fill_diagonal(s, 0)
    true = set(zip(*(k.tolist() for k in np.nonzero(s >= 0.95)), strict=True))
    assert len(found & true) >= 0.98 * len(true)


def test_audit_of_queries_from_other_shards():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    q = x[:400] + 0.28 / 8 * rng.normal(size=(400, 64)) * np.linalg.norm(x[:400], axis=1, keepdims=True)
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    g = hnsw.Graph(x)
    true = set(zip(*(k.tolist() for k in np.nonzero(q @ x.T >= 0.95)), strict=True))
    beam = g.audited(0.95, 1, q)
    i, j = g.links_from(q, 0.95, beam)
    assert len(true) > 100 and len(true & set(zip(i.tolist(), j.tolist(), strict=True))) >= 0.98 * len(true)
    # No vector of the shard has a link in it: a sample without links has shown nothing, whichever side it is from.
    assert g.audited(0.95, 16) >= hnsw.WIDE and g.audited(0.95, 16, -q) >= hnsw.WIDE and g.audited(0.95, 16, q[:3]) >= hnsw.WIDE


def test_first_queries_of_a_shard_are_answered_once(spark):
    x = clustered(6000, d=8)
    rows = [(0, 0 if k < 200 else 1, k, 1, [float(v) for v in x[k]]) for k in range(6000)] + [(1, 1, 9000, 1, [1.0] * 8), (2, 0, 9001, 1, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "target int, role int, node long, copies long, vector array<double>")
    got = hnsw.linked(frame, 0.95).groupBy("node").agg(F.sum("links").alias("n")).collect()
    hit = np.array(x @ x.T >= 0.95)
    np.fill_diagonal(hit, False)
    hit[200:, 200:] = False
    want = {k: int(n) for k, n in enumerate(hit.sum(axis=1)) if n}
    found = {r.node: r.n for r in got}
    assert all(found[k] <= want.get(k, 0) for k in found) and sum(found.values()) >= 0.98 * sum(want.values())


def brute(rows):
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = {i: 0 for i, _ in rows}, {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for k, (a, x) in enumerate(good):
        for b, y in good[k + 1 :]:
            if len(x) == len(y) and x @ y >= 0.95:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (links[i], find(i) if i is not None else None) for i, _ in rows}


def test_table(spark):
    rows = [(k, [float(v) for v in x]) for k, x in enumerate(clustered(400))]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2004, [1.0, None]), (2005, [float("inf"), 1.0]), (2006, [1.0, 0.0]), (2007, [3.0, 0.0]), (2008, [0.9, 0.1]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("node", "vector", "target", "role", "shard", "label")}).repartition(3)
    got = hnsw.join(frame).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id]
        assert r.kept == (r.vec_id is None or r.component_id == r.vec_id)
    assert hnsw.join(frame.limit(0)).count() == 0


def test_planted_links_across_shards(spark):
    """Pairs at a cosine of 0.95 to 0.96, of which most fall into different shards, and components near the ends of the double range."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.96, size=(1500, 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * r
    scale = np.where(np.arange(3000) % 3 == 0, 1e200, np.where(np.arange(3000) % 3 == 1, 1e-200, 1.0))[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]) * scale)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    found = sum(got[1500 + k] == (1, k) for k in range(1500))
    assert found >= 0.99 * 1500 and all(c in (k, k - 1500) for k, (_, c) in got.items())


def test_query_like_its_sql(spark, tmp_path):
    """Planted links and chains of them, equal vectors, and vectors that link with nothing."""
    x = clustered(600)
    rows = [(7 * k + 3, v.tolist()) for k, v in enumerate(x)]
    chain = [x[5] + 0.25 * k * x[9] for k in range(1, 8)]
    rows += [(10_000 + k, v.tolist()) for k, v in enumerate(chain)] + [(20_000, x[1].tolist()), (20_001, (3 * x[1]).tolist())]
    rows += [(1, None), (2, [0.0] * 32), (30_000, [None] + [1.0] * 31), (30_001, [float("nan")] + [1.0] * 31), (30_002, [float("inf")] + [1.0] * 31)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in queries.op9_hnsw(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(con.sql(queries.OP9_SQL).fetchall())
    assert len(got) == len(rows) and sum(r[1] > 0 for r in want) > 100
    assert got == want
