"""Running totals of owners that may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _place(order: Column, cuts: list, first: int = 0) -> Column:
    """Number of cuts below a value, by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(order > F.lit(cuts[mid]), _place(order, cuts[mid + 1 :], first + mid + 1)).otherwise(_place(order, cuts[:mid], first))


def running_before(rows: DataFrame, by: str, order: str, value: Column, name: str = "before", below: int | None = None, bins: int | None = None) -> DataFrame:
    """`rows` with the sum of `value` over the rows of the same owner `by` that stand before in `order`; with `below`, only rows where it is less than that.

    Values aren't negative, and `order` is a number, date or time, distinct for each owner. Its quantiles, which are read when this is called, cut all
    rows into `bins`; owners have a total for each bin, and a window goes over one bin of one owner. So no owner is one
    task, and bins that begin beyond `below` are never sorted. Null owners are an owner, and null orders come first.
    """
    bins = bins or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx(order, [i / bins for i in range(1, bins)], 1000)).first()[0] if bins > 1 else None
    cut = rows.withColumn("_bin", F.when(F.col(order).isNull(), -1).otherwise(_place(F.col(order), sorted(set(found or [])))))
    totals = cut.groupBy(F.col(by).alias("_by"), F.col("_bin").alias("_b")).agg(F.sum(value).alias("_t"))
    ahead = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bins
    totals = totals.select("_by", "_b", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_ahead"))
    if below is not None:
        totals = totals.where(F.col("_ahead") < below)
    near = Window.partitionBy(by, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(totals, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bin") == F.col("_b")))
    out = out.withColumn(name, F.col("_ahead") + F.coalesce(F.sum(value).over(near), F.lit(0))).drop("_bin", "_by", "_b", "_ahead")
    return out if below is None else out.where(F.col(name) < below)
