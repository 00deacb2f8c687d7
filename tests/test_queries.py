"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run and give rows."""

import os
import shutil
import subprocess
import sys
from glob import glob

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from staveframe.plans import interval_queries, metric_queries, note_queries, state_queries, table_queries

FOLDER = "/root/testdata/sf0.001"
OWN = interval_queries.QUERIES | table_queries.QUERIES | note_queries.QUERIES | metric_queries.QUERIES | state_queries.QUERIES
SQL = interval_queries.SQL | table_queries.SQL | note_queries.SQL | metric_queries.SQL | state_queries.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def told(frame, columns):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in ("i", "u", "f") else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, duck, name):
    got, want = OWN[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert told(got, columns) == told(want, columns)


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_runs(spark, name):
    assert OWN[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part():
    """The library and the entry know nothing of the optional folders but by name in the entry."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob(f"{root}/staveframe/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as file:
                assert "staveframe.llm" not in file.read()


@pytest.mark.parametrize("without_pipeline", [False, True])
def test_entry_without_the_optional_part(tmp_path, without_pipeline):
    """With the optional folders deleted, and the pipeline's file too or not, the other queries and their SQL are there and run."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *(["corpus_pipeline.py"] if without_pipeline else []))
    shutil.copytree(root, tmp_path / "repo", ignore=gone)
    code = """import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(*[e.queries()[n](spark, "FOLDER").count() > 0 for n in ("weighted_ratio", "region_edits", "viterbi")])""".replace("FOLDER", FOLDER)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path / "repo")}  # for Spark's Python workers
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=240, check=True)
    names, sql, ran = (line.split() for line in done.stdout.splitlines())
    assert names == sorted(OWN)
    assert sql == sorted(SQL)
    assert ran == ["True"] * 3
