"""Small helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Text bytes handled at once by a Python worker. A single longer text is handled alone, whole.
CHUNK_BYTES = 2 << 20


def table(spark, sf_dir: str, name: str):
    """One table of the folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """A column by its name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashed(df) -> list:
    """The columns that a hash of a row can be made of: all but maps, which have no order."""
    return [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def give_back() -> None:
    """Returns memory that this worker no longer uses to the system; idle workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the named text column holds about ``limit`` bytes; never cuts a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
    del batches
    give_back()


def texts(column: pa.Array) -> list[str]:
    """The column's strings; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenates ``flat[s : s + n]`` for all (s, n) without a Python loop."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
