"""The corpus report of stored song reports, kept up to date by what changes.

Every report adds rows ``(kind, name, song, reports, occurrences, amount)``; their sums by kind, name and song are kept.
A refresh adds what new reports give and takes off what the replaced ones gave before, so that it reads the new reports
and the buckets of the store with their earlier forms, and no others. Sums are decimals, so adding and taking off is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staveframe.functions.scalars import decimal_sum, half_up
from staveframe.sources.store import Store, cut

#: A metric's mean counts for a genre if it is one of these; songs that make an error a recurring one.
GENRE_METRICS, RECURRING = ("rootAccuracy", "majorMinorAccuracy", "detailedAccuracy"), 3
TOTAL = "decimal(28,8)"
KEYS = ("kind", "name", "song")


def contributions(reports: DataFrame) -> DataFrame:
    """What each report ``(report_id, song, genre, metrics map, mismatches array of (error_type, duration), confusions array
    of (pair, seconds))`` adds, with an ``amount`` that is a double. Reports without metrics add nothing; values that are null or not finite don't count.

    Each kind is a plain explode of the columns that it needs, so that no lambda runs for a row; the reports are read once
    for each kind. An error's rows are one for each time, and one more for the report."""
    good = reports.where(F.col("metrics").isNotNull())
    genre = F.coalesce(F.when(F.col("genre") != "", F.col("genre")), F.lit("Unspecified"))
    none = F.lit("")

    def rows(of, kind, name, song=none, n=1, occurrences=0, amount=None):
        return of.select(F.lit(kind).alias("kind"), name.alias("name"), song.alias("song"), F.lit(n).cast("long").alias("reports"), F.lit(occurrences).cast("long").alias("occurrences"), (F.lit(0.0) if amount is None else amount).alias("amount"))

    value = F.col("value")
    values = good.select(genre.alias("genre"), F.explode("metrics").alias("metric", "value")).where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    wrong = good.select("song", F.explode("mismatches").alias("m"))
    confused = good.select(F.explode("confusions").alias("c"))
    parts = [
        rows(values, "metric", F.col("metric"), amount=value), rows(values.where(F.col("metric").isin(*GENRE_METRICS)), "genre", F.concat("genre", F.lit("\t"), "metric"), amount=value),
        rows(good, "songs", none), rows(good, "genre", F.concat(genre, F.lit("\t"))),
        rows(good.select("song", F.explode(F.array_distinct("mismatches.error_type")).alias("e")), "cause", F.col("e"), F.col("song")),
        rows(wrong, "cause", F.col("m.error_type"), F.col("song"), 0, 1, F.coalesce("m.duration", F.lit(0.0))),
        rows(confused, "confusion", F.col("c.pair"), amount=F.coalesce("c.seconds", F.lit(0.0))),
    ]
    return reduce(DataFrame.unionByName, parts).where("name IS NOT NULL")


def _summed(rows: DataFrame, total: Column, *more: Column) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("reports").alias("reports"), F.sum("occurrences").alias("occurrences"), total.cast(TOTAL).alias("total"), *more)


def _taken_off(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: -F.col(c) for c in ("reports", "occurrences", "amount")})


def _keyed(sums: DataFrame) -> DataFrame:
    return sums.withColumn("sum_key", F.concat_ws("\x1f", *KEYS))


def refresh(reports: DataFrame, stored: Store, sums: Store) -> None:
    """Stores the reports (of one ``report_id`` the last version holds; within a call they must be equal) and brings the
    sums up to date. Reports without an id aren't kept and add nothing. A failure between the two steps is made good by
    :func:`rebuild`.

    The reports are written once, into the store; what they add is read from there, column by column, before they become current."""
    staged = stored.stage(reports)
    new = stored.staged(staged)
    if new is None:
        return
    change = contributions(new)
    before = stored.current([r.bucket for r in new.select("bucket").distinct().collect()])  # at most one a bucket
    if before is not None:
        replaced = cut(before.join(new.select("report_id"), "report_id", "left_semi"))  # each kind reads it
        change = change.unionByName(_taken_off(contributions(replaced)))
    change = cut(_summed(change, decimal_sum(F.col("amount"))).withColumn("fresh", F.lit(True)))
    held = sums.current([r.b for r in _keyed(change).select(sums.bucket(F.col("sum_key")).alias("b")).distinct().collect()])
    if held is not None:
        both = change.unionByName(held.drop("sum_key").withColumn("fresh", F.lit(False)))
        change = _summed(both, F.sum("total"), F.bool_or("fresh").alias("fresh")).where("fresh")  # what nothing was added to stays as it is
    summed = sums.stage(_keyed(change.drop("fresh")), unique=True)
    stored.commit(staged)
    sums.commit(summed)


def rebuild(stored: Store, sums: Store) -> None:
    """The sums anew from all stored reports; sums that no report gives any more become zero."""
    everything = _keyed(_summed(contributions(stored.current()), decimal_sum(F.col("amount"))))
    held = sums.current()
    if held is not None:
        gone = held.join(everything.select("sum_key"), "sum_key", "left_anti")
        everything = everything.unionByName(gone.withColumns({"reports": F.lit(0).cast("long"), "occurrences": F.lit(0).cast("long"), "total": F.lit(0).cast(TOTAL)}))
    sums.upsert(cut(everything))


def report(sums: DataFrame) -> DataFrame:
    """``part, name, item, songs, occurrences, value, recurring`` from the sums: the mean of each metric, of the genre metrics in
    each genre and its number of songs, and for each cause and confusion what it comes to."""
    # One pass over the sums, which are many where there are many songs; of all kinds but causes a name has one row.
    by_name = sums.where("reports > 0").groupBy("kind", "name").agg(F.count("*").alias("songs"), F.sum("reports").alias("reports"), F.sum("occurrences").alias("occurrences"), F.sum("total").cast(TOTAL).alias("total"))
    kind, total = F.col("kind"), F.col("total")
    genre, cause, split = kind == "genre", kind == "cause", F.split("name", "\t")
    mean, seconds = half_up((total / F.col("reports")).cast("double")), half_up(total.cast("double"), 3)
    value = F.when((kind == "metric") | genre & (F.get(split, F.lit(1)) != ""), mean).when(cause | (kind == "confusion"), seconds)
    return by_name.select(
        kind.alias("part"), F.when(genre, F.get(split, F.lit(0))).otherwise(F.col("name")).alias("name"), F.when(genre, F.get(split, F.lit(1))).otherwise("").alias("item"), F.when(cause, F.col("songs")).otherwise(F.col("reports")).alias("songs"),
        F.when(cause, F.col("occurrences")).alias("occurrences"), value.alias("value"), F.when(cause, F.col("songs") >= RECURRING).alias("recurring"),
    )
