import math
import random

from pyspark.sql import functions as F

from ledgerloom.operators import observability, quantiles


def plain(values, q, linear):
    s = sorted(values)
    if not linear:
        return s[max(math.ceil(round(len(s) * q, 9)) - 1, 0)]
    at = (len(s) - 1) * q
    low, high = s[math.floor(at)], s[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def data():
    rnd = random.Random(7)
    return [(g, v) for g in ("a", "b", None) for v in [rnd.choice([0.0, rnd.random(), rnd.expovariate(1) * 1e6, -5.0]) for _ in range(3000 if g == "a" else 700)]] + [("c", 1.0), ("d", None)]


def test_selection_of_both_forms(spark):
    rows = data()
    wanted = [(q, linear) for q in (0.0, 0.3, 0.5, 0.99, 1.0) for linear in (False, True)]
    got = {(r.g, r.q, r.linear): r.v for r in quantiles.selected(spark.createDataFrame(rows, "g string, v double"), "g", "v", wanted, few=5).collect()}
    assert len(got) == 4 * len(wanted)
    for (g, q, linear), v in got.items():
        assert math.isclose(v, plain([x for h, x in rows if h == g and x is not None], q, linear), rel_tol=1e-12)


def test_places_share_a_scan(spark):
    """Rounds read each row once, whatever the number of places."""
    seen = spark.sparkContext.accumulator(0)
    looked = F.udf(lambda v: (seen.add(1), v)[1], "double").asNondeterministic()
    rows = spark.createDataFrame([("a", float(i * 37 % 1009)) for i in range(1009)], "g string, v double").withColumn("v", looked("v"))
    runs = []
    for qs in ([0.5], [0.1, 0.3, 0.5, 0.7, 0.9]):
        seen.value = 0
        quantiles.exact_quantiles(rows, "g", "v", qs, few=100).collect()
        runs.append(seen.value)
    assert runs[0] == runs[1] and runs[0] % 1009 == 0


def test_percentiles_need_no_whole_group(spark):
    df = spark.createDataFrame(data(), "g string, v double")
    wide = observability.percentiles(df, "g", "v", {"p50": (0.5, True), "p90": (0.9, False)})
    got = {r.g: (r.p50, r.p90) for r in wide.collect()}
    want = {r.g: (r.p50, r.p90) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("p50"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY v)").alias("p90")).collect()}
    assert got.keys() == want.keys() and got["d"] == (None, None)
    assert all(a == b or math.isclose(a, b, rel_tol=1e-12) for g in got for a, b in zip(got[g], want[g]))
    assert "percentile" not in wide._jdf.queryExecution().optimizedPlan().toString().lower()
