"""Queries whose SQL once left ties and sums to the order of rows, on small tables with such ties."""

from functools import reduce
from operator import add

import duckdb
import pandas as pd
import pytest

from staveframe.plans import note_queries, state_queries, table_queries

QUERIES = table_queries.QUERIES | note_queries.QUERIES | state_queries.QUERIES
SQL = table_queries.SQL | note_queries.SQL | state_queries.SQL


@pytest.fixture
def both(spark, tmp_path):
    """Sorted rows of a query and of its SQL over the given tables."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, frame in tables.items():
            frame.to_parquet(f"{tmp_path}/{t}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
            con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got, want = QUERIES[name](spark, str(tmp_path)), con.sql(SQL[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        key = lambda r: tuple((v is None, 0 if v is None else v) for v in r)
        return sorted((tuple(r) for r in got.select(*columns).collect()), key=key), sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=key)

    return run


def events(values, users):
    n = len(values)
    return pd.DataFrame({"event_id": range(n), "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "user_id": users, "event_type": "click", "value": values})


def test_beat_windows_sums_exactly(both):
    values = [0.2] * 675  # 135 / 100 s are one window of a second and 0.35 of the next, which is none of its own
    assert reduce(add, values) != 135
    got, want = both("beat_windows", events=events(values, 3))
    assert got == want
    assert [(r[0], r[1]) for r in got] == [(1.35, 0)]


def test_limits_filter_takes_a_mean_at_the_limit(both):
    at, over, odd = [0.05] * 38 + [0.06] * 2, [0.05] * 37 + [0.06] * 3, [None, float("nan")]  # at: 2.02 / 40 is the limit
    assert reduce(add, at) / 40 > 0.0505
    rows = [(k, flag, d) for k, flag, values in ((1, "R", at), (1, "A", at[::-1]), (2, "R", at), (2, "N", over), (3, "A", [None]), (4, "A", odd), (5, "A", [float("-inf"), 0.01])) for d in values]
    got, want = both("limits_filter", lineitem=pd.DataFrame(rows, columns=["l_suppkey", "l_returnflag", "l_discount"]))
    assert got == want
    assert [r[0] for r in got][:2] == [1, 3] and 2 not in [r[0] for r in got]


def test_key_estimate_without_energy_and_among_equals(both):
    c_major = [1.0 if p in (0, 4, 7) else 0.0 for p in range(12)]
    vectors = [[1.0] * 64, [-1.0] * 64, [0.0] * 12, c_major, c_major[:8], [], None, [float("nan")] * 12, [float("inf")] * 12, [None] * 12, [0.0] * 12 + [1.0]]
    got, want = both("key_estimate", embeddings=pd.DataFrame({"vec_id": range(len(vectors)), "label": 0, "embedding": vectors}))
    told = lambda rows: {i: (key, confidence) for confidence, i, key in rows}
    assert told(got) == told(want)
    assert [k for k, v in told(got).items() if v[0] is None] == [1, 2, 5, 6, 7, 9, 10]  # pandas writes NaN as null
    assert told(got)[3][0] == told(got)[4][0] == "C major"


def test_region_edits_with_partitions_joined_as_it_runs(spark, both):
    """Spark joins the small partitions of both sides apart; a user's regions and edits must still meet."""
    users = [u for u in range(400) for _ in range(40)]
    frame = events([1.0] * len(users), users)
    frame.loc[frame["event_id"] % 2 == 0, "event_type"] = "a type with a long name that makes this side larger " * 20
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got, want = both("region_edits", events=frame)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want


def test_region_cleanup_rounds_no_sum_by_its_order(both):
    rows = pd.concat([pd.read_parquet("/root/testdata/sf0.01/events.parquet").assign(part=k) for k in range(6)])
    rows["user_id"] += rows["part"] * 150  # confidences at half of the last place, by other sums each
    rows["event_id"] += rows["part"] * 10_000
    got, want = both("region_cleanup", events=rows.drop(columns=["part", "props"]))
    assert got == want
