"""A keyed table of Parquet deltas with versions, for results that are kept and refreshed.

An upsert writes its rows alone, by buckets of the key, under a path of its own; one row in the table of commits makes
them current. Readers go by that table, so they see a version whole or not at all: a write that fails, or is still
going on, is not there. Of several rows of a key the one of the latest version holds.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Deltas after which they are merged into one.
MERGE_AFTER = 16


class ChangedMeanwhile(RuntimeError):
    """Another writer has committed since this one began; nothing was changed."""


class Staged(NamedTuple):
    """Rows that are written, but not yet current: their version and path, whether they are all rows, and the commits they rest on."""

    version: int
    path: str
    whole: bool
    held: list


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and all runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and goes on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Store:
    """Rows by ``key`` under ``root``, in as many ``buckets`` for as long as it is used. Rows with a null key aren't kept. Rows of one upsert that
    share a key must be equal."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def commits(self) -> list[tuple[int, str, bool]]:
        """``version, path, whole`` of what is current, oldest first: the last version that holds all, and those after it."""
        try:
            rows = self.spark.read.schema("version long, path string, whole boolean").parquet(f"{self.root}/commits").collect()  # a row an upsert
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return []
        rows = sorted((r.version, r.path, r.whole) for r in rows)
        last = max((k for k, r in enumerate(rows) if r[2]), default=0)
        return rows[last:]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def current(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The newest row of each key; of the given buckets only if wanted, which reads no file of the others. None before
        the first commit."""
        held = self.commits()
        if not held:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{path}").withColumn("version", F.lit(version)) for version, path, _ in held]
        if buckets is not None:
            parts = [p.where(F.col("bucket").isin(buckets)) for p in parts]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if len(held) > 1:
            newest = Window.partitionBy("bucket", self.key).orderBy(F.desc("version"))
            rows = rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")
        return rows.drop("bucket", "version")

    def upsert(self, rows: DataFrame) -> int:
        """Makes the rows current in place of those with the same keys, and gives the new version."""
        return self.commit(self.stage(rows))

    def stage(self, rows: DataFrame, unique: bool = False) -> Staged:
        """Writes the rows without making them current: :meth:`staged` reads them back and :meth:`commit` makes them
        current. ``unique`` says that no key comes twice, which saves finding out."""
        return self._stage(rows, self.commits(), False, unique)

    def staged(self, staged: Staged) -> DataFrame | None:
        """The rows of a stage with their ``bucket``; None if there are none."""
        rows = self.spark.read.parquet(f"{self.root}/{staged.path}")
        return rows if rows.columns else None

    def commit(self, staged: Staged) -> int:
        """Makes the rows of a stage current, and gives the new version."""
        version = self._commit(staged)
        if len(staged.held) + 1 >= MERGE_AFTER:
            held = self.commits()
            version = self._commit(self._stage(self.current(), held, True, True))
        return version

    def _stage(self, rows: DataFrame, held: list, whole: bool, unique: bool) -> Staged:
        version = (held[-1][0] if held else 0) + 1
        path = f"data/{version}-{uuid.uuid4().hex}"
        kept = rows.where(F.col(self.key).isNotNull())
        kept = (kept if unique else kept.dropDuplicates([self.key])).withColumn("bucket", self.bucket(F.col(self.key)))
        kept.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        return Staged(version, path, whole or not held, held)

    def _commit(self, staged: Staged) -> int:
        version = staged.version
        if [c[0] for c in self.commits()] != [c[0] for c in staged.held]:
            raise ChangedMeanwhile(f"version {version} was committed by another writer")
        if self.staged(staged) is None:  # no rows at all: nothing to read back
            return version - 1
        commit = self.spark.createDataFrame([(version, staged.path, staged.whole)], "version long, path string, whole boolean")
        commit.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return version
