"""Connected components of a graph given as edges, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveframe.llm._lineage import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, component`` for every id in ``edges(a long, b long)``: the smallest id that links lead to.

    Alternating large-star and small-star steps: each round points neighbourhoods at their smallest member, until
    no edge changes. Every round is a shuffle over the edges, of which there are never more than at the start; the
    number of rounds grows with the logarithm of a component's size. An empty table gives an empty one.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    now = cut(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where(F.col("a") != F.col("b")).distinct())
    before = None
    for _ in range(most_rounds):
        now = cut(star(star(now, True), False))
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
