"""Orders over whole tables by ranges, percentiles by counted ranges, smoothing of fractions."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import report, selection, series
from framelark.sources import tables


def explained(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("keys", [(), ("camera",)])
def test_sparse_and_text_orders(spark, keys):
    rng = random.Random(1)
    at = rng.sample(range(10**12), 900)  # some 10 ** 9 apart
    rows = [(("a", "b", None)[k % 3], t, f"f{t:013d}.png", rng.randrange(1000)) for k, t in enumerate(at)]
    df = spark.createDataFrame(rows, "camera string, t long, name string, v long").repartition(4)
    want, top, best = {}, {}, {}
    for camera, t, _, v in sorted(rows, key=lambda r: r[1]):
        own = camera if keys else 0
        want[t] = top[own] = top.get(own, 0) + 1
        best[t] = top[own, "v"] = max(top.get((own, "v"), 1), v)
    for order in ("t", "name"):
        got = series.numbered(df, order, "place", 1, keys)
        assert got.columns == [*df.columns, "place"]
        assert {r.t: r.place for r in got.collect()} == want
    assert {r.t: r.top for r in series.running_max(df, "t", "v", "top", 1, keys).collect()} == best


def test_a_listing_over_several_tasks(spark):
    names = spark.range(5000).select(F.lit("c").alias("camera"), F.format_string("%05d.png", "id").alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so few rows into one task
    try:
        ranges = series.in_ranges(names, ["camera"], "name").groupBy("_range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 2500
    assert [r.position for r in tables.positions(names, ["camera"]).orderBy("name").collect()] == list(range(1, 5001))
    assert tables.positions(names.limit(0), ["camera"]).count() == 0


def test_order_of_bits(spark):
    x = [float("-inf"), -1e308, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e308, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, v double").coalesce(1).orderBy("k").select(selection.ordered_bits(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(x) - 1


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_percentile(spark, share):
    rng = np.random.default_rng(5)
    groups = {"ties": np.round(rng.normal(size=400), 1), "wide": np.exp(rng.normal(size=301) * 80) * rng.choice([-1, 1], 301), "one": np.array([3.25]), "two": np.array([-1.0, 2.0]), None: rng.normal(size=50)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("two", None), ("none", None)]
    df = spark.createDataFrame(rows, "dataset string, error double").repartition(3)
    got = {r._key.dataset: r.percentile for r in selection.percentile(df, "error", share, ("dataset",)).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k] == pytest.approx(np.quantile(x, share), rel=1e-12)
    every = np.concatenate(list(groups.values()))
    assert selection.percentile(df, "error", share).first().percentile == pytest.approx(np.quantile(every, share), rel=1e-12)


def test_overall_counts_ranges(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.0), (None, 4.0)], "dataset string, error double")
    out = report.overall(df, "error", ("dataset",))
    assert "percentile(" not in explained(out)
    assert {r.dataset: (r.overall_mean_px, r.percentile_95_px) for r in out.collect()} == {"a": (None, None), "b": (1.5, pytest.approx(1.95)), None: (4.0, 4.0)}
    assert report.overall(df.limit(0)).collect()[0].percentile_95_px is None


@pytest.mark.parametrize("size", [1e-6, 1.0, 1e9])
def test_smoothing_of_fractions(spark, size):
    rng = np.random.default_rng(6)
    n, window = 700, 31
    y = (np.cumsum(rng.normal(size=n)) + rng.normal(size=n)) * size
    df = spark.createDataFrame([(1000 * k, float(v)) for k, v in enumerate(y)], "t long, v double").repartition(3)
    got = [r.smooth for r in series.savgol(df, "t", "v", window).orderBy("t").collect()]
    for k in range(n):
        c = min(max(k, window // 2), n - 1 - window // 2)
        x = np.arange(-(window // 2), window // 2 + 1)
        want = np.polyval(np.polyfit(x, y[c + x], 2), k - c)
        assert abs(got[k] - want) < 1e-9 * np.abs(y).max()


def test_smoothing_needs_every_value(spark):
    df = spark.range(60).select("id", F.when(F.col("id") != 30, F.col("id") * 0.5).alias("v"))
    with pytest.raises(Exception, match="null, NaN or infinite"):
        series.savgol(df, "id", "v", 11).collect()
