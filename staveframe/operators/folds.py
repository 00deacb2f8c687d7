"""One pass in order over the rows of each key, for algorithms whose next step needs the state after the last one.

A task streams its sorted rows: it holds the state of one key and one batch of rows, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that are handed on at once.
ROWS = 8192


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)


def whole_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt so that all of a key's are in one partition.

    Spark leaves out ``repartition(key)`` where the rows come dealt by the key already, but may still split or join these
    partitions as it runs, apart for each side of a union; a map over partitions asks for nothing that would stop it. A
    struct of the keys is dealt anew each time."""
    return rows.repartition(F.struct(*keys))


def ordered_fold(rows: DataFrame, key: str, order: list[str], begin: Callable[[Any], Any], step: Callable[[Any, dict], list[dict]], finish: Callable[[Any], list[dict]], schema: str) -> DataFrame:
    """The rows that ``step(state, row)`` gives for each row, and ``finish(state)`` after a key's last one; ``begin(key)``
    makes the state. A null key is a key of its own."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row[key] != current:
                    if state is not None:
                        out += finish(state)
                    current, state = row[key], begin(row[key])
                out += step(state, row)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
        if state is not None:
            out += finish(state)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return whole_keys(rows, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
