"""Averages and strength of series that are split over many ranges, against plain loops over whole series."""

import random

import numpy as np
import pytest

from tidewire.operators import indicators

NAMES = ["sma_20", "sma_50", "sma_200", "ema_20", "ema_50", "ema_200", "rsi_14"]


def sma_of(x, n):
    return [None if i < n - 1 else float(np.mean(x[i - n + 1 : i + 1])) for i in range(len(x))]


def plain(series):
    some = lambda v: [None if np.isnan(y) else float(y) for y in v]
    x = np.array(series, float)
    columns = [*(sma_of(x, n) for n in (20, 50, 200)), *(some(indicators.ema_of(x, n)) for n in (20, 50, 200)), some(indicators.rsi_of(x))]
    return list(zip(*columns, strict=True))


@pytest.mark.parametrize("range_rows", [10_000, 400, 30])
def test_series_of_any_length_in_any_number_of_ranges(spark, range_rows):
    rng = random.Random(range_rows)
    lengths = {"one": 1, "short": 14, "fifteen": 15, "twenty": 20, "mid": 63, "edge": 199, "full": 200, None: 210, "long": 900 if range_rows > 100 else 420}
    series = {(k, j): [100 + rng.gauss(0, 5) if k != "mid" else 7.0 for _ in range(n)] for k, n in lengths.items() for j in (1, 2) if j == 1 or n < 100}
    rows = [(k, j, t, v, "x") for (k, j), x in series.items() for t, v in enumerate(x)]
    rows += [("long", 1, 10_000, None, "no value"), ("long", 1, 10_001, float("nan"), "no value")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, t long, v double, bar string").repartition(5)
    got = {}
    for r in indicators.indicator_set(df, ["k", "j"], "t", "v", range_rows=range_rows).collect():
        got.setdefault((r.k, r.j), []).append(r)
    assert set(got) == set(series)
    for key, found in got.items():
        found.sort(key=lambda r: r.t)
        assert [r.bar for r in found] == list(range(1, len(series[key]) + 1)) and [r.v for r in found] == series[key]
        for r, want in zip(found, plain(series[key]), strict=True):
            for name, w in zip(NAMES, want, strict=True):
                assert (r[name] is None) == (w is None), (key, r.bar, name)
                assert w is None or abs(r[name] - w) < 1e-7, (key, r.bar, name)
        short = len(found) < 200
        assert {(r.disabled, r.disabled_reason) for r in found} == {("sma_200,ema_200", "insufficient_history") if short else (None, None)}
    assert indicators.indicator_set(df.limit(0), ["k"], "t", "v").count() == 0


def test_a_split_series_is_dealt_to_many_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("t"), (F.col("id") % 17).cast("double").alias("v"))
    out = indicators.indicator_set(df, ["k"], "t", "v", range_rows=300)
    sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) >= 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_a_scan_in_blocks_is_the_loop():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 1000):
        v, y, want = rng.normal(size=n), 3.0, []
        for x in v:
            y = 0.9 * y + 0.2 * x
            want.append(y)
        assert np.allclose(indicators.linear_scan(v, 0.9, 0.2, 3.0), want)
