"""Connected components of a graph given by its edges, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node of `edges` (a, b) reaches.

    Large-star and small-star steps alternate: each node ties its larger neighbours, then its smaller ones and
    itself, to the least neighbour, until nothing changes. Steps are aggregations and joins on nodes, with partial
    sums first, so no node's neighbours are gathered; every result is written once, and the driver gets one number a round.
    """
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m")).union(e.select(F.col("b").alias("n"), F.col("a").alias("m"))) if large else e.select(F.col("b").alias("n"), F.col("a").alias("m"))
        least = both.groupBy("n").agg(F.min("m").alias("l")).select("n", F.least("n", "l").alias("l"))
        tied = both.join(least, "n")
        if large:
            out = tied.where("m > n").select(F.col("l").alias("a"), F.col("m").alias("b"))
        else:
            out = tied.select(F.col("l").alias("a"), F.col("m").alias("b")).union(least.select(F.col("l").alias("a"), F.col("n").alias("b")))
        return out.where("a < b").distinct()

    mark = None
    while True:
        e = written(star(star(e, True), False))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).union(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
