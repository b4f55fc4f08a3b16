"""Exact quantiles of groups of any size by selection, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.storage import saved
from ledgerloom.functions.tables import read, small

#: Cuts of a round, and rows of an interval that are sorted in the end.
CUTS, FEW = 64, 100_000
STEPS = (64, 32, 16, 8, 4, 2, 1)


def exact_quantiles(rows: DataFrame, by: str, value: str, qs: list[float], linear: bool = False, few: int = FEW) -> DataFrame:
    """(by, q, value): quantiles by nearest rank, the value at place ceil(n * q), or by linear interpolation between the two places around (n - 1) * q.

    Each wanted place has an interval that holds it. A round cuts the intervals at approximate quantiles of what they hold, counts the
    values of each part exactly, and goes on with the part that has the place; an interval is done when its values are equal, and sorted when
    it has at most `few` rows. State is CUTS numbers for each interval; places with the same interval share it. Rounds run when this is called. Nulls don't
    count, groups without values have no row, and null groups are a group. NaN is greater than all numbers.
    """
    return selected(rows, by, value, [(q, linear) for q in qs], few).select(by, "q", value)


def selected(rows: DataFrame, by: str, value: str, wanted: list[tuple[float, bool]], few: int = FEW) -> DataFrame:
    """(by, q, linear, value): exact_quantiles of both forms in the same rounds; wanted has pairs (q, linear)."""
    src = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = src.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda q, linear: (F.col("n") - 1) * q if linear else F.greatest(F.ceil(F.round(F.col("n") * q, 9)) - 1, F.lit(0))
    places = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(linear).alias("linear"), place(q, linear).cast("double").alias("at")) for q, linear in wanted])
    t = sizes.select("g", "n", "lo", "hi", F.explode(places).alias("w")).select("g", "n", "lo", "hi", "w.q", "w.linear", "w.at")
    ranks = F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))
    state = saved(t.select("g", "q", "linear", "at", ranks.alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside")), "quantiles")

    def within(s: DataFrame) -> DataFrame:
        """Rows of the intervals s (g, lo, hi, ...)."""
        s = small(s.withColumnRenamed("g", "sg"))
        return src.join(s, F.col("g").eqNullSafe(F.col("sg")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("sg")

    intervals = lambda s: s.select("g", "lo", "hi").distinct()
    same = lambda s, x: F.col("g").eqNullSafe(F.col(f"{x}g")) & (F.col("lo") == F.col(f"{x}lo")) & (F.col("hi") == F.col(f"{x}hi"))
    while (state.where("lo < hi").agg(F.max("inside")).first()[0] or 0) > few:
        open_ = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
        cuts = within(intervals(state.where(open_))).groupBy("g", "lo", "hi").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [i / CUTS for i in range(CUTS)], 20 * CUTS))).alias("cuts"))
        inner = within(saved(cuts, "cuts").withColumnsRenamed({"lo": "ilo", "hi": "ihi"}).withColumns({"lo": F.col("ilo"), "hi": F.col("ihi")}))
        cell = F.lit(0)
        for step in STEPS:  # cuts below the value, by binary search
            inner = inner.withColumn("cell", cell)
            cell = F.col("cell") + F.when(F.get("cuts", F.col("cell") + (step - 1)) < F.col("v"), step).otherwise(0)
        parts = inner.withColumn("cell", cell).groupBy("g", "ilo", "ihi", "cell").agg(F.count("*").alias("n"), F.min("v").alias("plo"), F.max("v").alias("phi"))
        up = Window.partitionBy("g", "ilo", "ihi").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CUTS + 1 rows at most
        parts = parts.withColumn("under", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumnRenamed("g", "ig")
        one = state.where(open_).join(small(saved(parts, "parts")), same(state, "i") & (F.col("below") + F.col("under") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("under") + F.col("n")))
        one = one.select("g", "q", "linear", "at", "rank", F.col("plo").alias("lo"), F.col("phi").alias("hi"), (F.col("below") + F.col("under")).alias("below"), F.col("n").alias("inside"))
        state = saved(state.where(~open_).unionByName(one), "quantiles")

    order = F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("v"))  # `few` rows at most
    last = within(intervals(state.where("lo < hi"))).withColumn("i", order).withColumnsRenamed({"g": "ig", "lo": "ilo", "hi": "ihi"})
    found = last.join(small(state.where("lo < hi")), same(state, "i") & (F.col("i") - 1 == F.col("rank") - F.col("below"))).select("g", "q", "linear", "at", "rank", "v")
    found = found.unionByName(state.where("lo = hi").select("g", "q", "linear", "at", "rank", F.col("lo").alias("v")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    return found.groupBy("g", "q", "linear").agg((low + (high - low) * F.max(F.when(F.col("linear"), F.col("at") - F.floor("at")).otherwise(0.0))).alias("v")).select(F.col("g").alias(by), "q", "linear", F.col("v").alias(value))


# queries


def ag2_selected(spark, d):
    """Nearest-rank and interpolated quantiles of prices; intervals of 500 rows are sorted, so that the small tables take rounds as well."""
    l = read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    both = selected(l, "l_returnflag", "price", [(0.5, False), (0.95, False), (0.99, False), (0.5, True), (0.95, True)], few=500)
    return both.select("l_returnflag", F.when(F.col("linear"), "linear").otherwise("nearest").alias("form"), "q", F.round("price", 4).alias("price"))


QUERIES = {"ag2_selected": ag2_selected}
SQL = {
    "ag2_selected": " UNION ALL ".join(
        [f"SELECT l_returnflag, 'nearest' AS form, {q}::DOUBLE AS q, round(quantile_disc(l_extendedprice::DOUBLE, {q}), 4) AS price FROM lineitem GROUP BY 1" for q in (0.5, 0.95, 0.99)]
        + [f"SELECT l_returnflag, 'linear', {q}::DOUBLE, round(quantile_cont(l_extendedprice::DOUBLE, {q}), 4) FROM lineitem GROUP BY 1" for q in (0.5, 0.95)]
    )
}
