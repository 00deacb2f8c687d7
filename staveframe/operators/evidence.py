"""Calibration evidence: answers of a model to requests, computed once and kept by what they depend on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staveframe.sources.store import Store, cut

#: The form of an entry; another one makes entries invalid.
ENTRY = 1


class Unusable(ValueError):
    """A request or an answer that evidence must not be made of."""


def request_key(*identity: str) -> Column:
    """SHA-256 of all that an answer depends on, as JSON with its names: audio, span, capture and versions."""
    return F.sha2(F.to_json(F.struct(F.lit(ENTRY).alias("entry"), *identity), {"ignoreNullFields": "false"}), 256)


def cached(requests: DataFrame, store: Store, answer: Callable[[DataFrame], DataFrame], versions: list[str], valid: Column) -> DataFrame:
    """Requests ``(cache_key, versions, …)`` with ``status`` and the columns of the answers.

    ``answer`` is worked out for the misses alone, and gives ``cache_key`` and its columns; an entry is used if its form and
    versions are those of the request and ``valid`` holds, else it is invalid and replaced. Fresh answers are checked the
    same way before they are kept: one that isn't valid raises :class:`Unusable`. Repeated requests are answered once.
    """
    held = store.current()
    if held is None:
        marked = requests.withColumn("status", F.lit("miss"))
    else:
        same = F.col("entry") == ENTRY
        for v in versions:
            same = same & F.col(f"held_{v}").eqNullSafe(F.col(v))
        usable = held.withColumn("valid", F.coalesce(valid, F.lit(False))).select("cache_key", "entry", "valid", *[F.col(v).alias(f"held_{v}") for v in versions])
        status = F.when(F.col("entry").isNull(), "miss").when(same & F.col("valid"), "hit").otherwise("invalid")
        marked = requests.join(usable, "cache_key", "left").withColumn("status", status).select(*requests.columns, "status")
    marked = cut(marked)  # before the store changes
    todo = marked.where("status <> 'hit'").drop("status").dropDuplicates(["cache_key"])
    fresh = cut(todo.select("cache_key", *versions).join(answer(todo), "cache_key", "left").withColumn("entry", F.lit(ENTRY)))
    if fresh.where(~F.coalesce(valid, F.lit(False))).limit(1).count():
        raise Unusable("an answer does not fit its request")
    if fresh.limit(1).count():
        store.upsert(fresh)
    answers = store.current()
    return marked if answers is None else marked.join(answers.drop("entry", *versions), "cache_key", "left")


def evidence(requests: DataFrame, performers: DataFrame, store: Store, answer: Callable[[DataFrame], DataFrame], versions: list[str], valid: Column, digest: Column, sealed: str) -> DataFrame:
    """:func:`cached` for the requests ``(capture, performer, track, cache_key, …)`` of a split's performers ``(performer,
    role, fold)``, with ``role, fold, digest`` and ``parity``.

    The sealed performer in a split, or one without a fold, raises :class:`Unusable`. ``parity`` stands at the first track of
    each capture: whether its answer worked out anew has the digest of the one that was kept; if not, this raises too.
    """
    if performers.where((F.col("performer") == sealed) | F.col("fold").isNull()).limit(1).count():
        raise Unusable("the split holds a performer that calibration must not see, or one without a fold")
    chosen = requests.join(performers, "performer")
    told = cut(cached(chosen, store, answer, versions, valid).withColumn("digest", digest))
    first = told.groupBy("capture").agg(F.min("track").alias("track"))
    again = told.join(first, ["capture", "track"], "left_semi").select(*chosen.columns)
    anew = answer(again.dropDuplicates(["cache_key"])).withColumn("digest", digest).select("cache_key", F.col("digest").alias("anew"))
    out = cut(told.join(anew, "cache_key", "left").withColumn("parity", F.col("anew") == F.col("digest")).drop("anew"))
    if out.where("parity = false").limit(1).count():
        raise Unusable("kept and fresh answers differ")
    return out


def cache_stats(told: DataFrame) -> DataFrame:
    """``capture, hits, misses, invalid`` of evidence."""
    count = lambda s: F.count_if(F.col("status") == s)
    return told.groupBy("capture").agg(count("hit").alias("hits"), count("miss").alias("misses"), count("invalid").alias("invalid"))
