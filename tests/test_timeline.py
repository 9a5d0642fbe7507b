import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.operators import clean, islands, relational, resample, timeline
from panelmill.functions import names


def month(y, m):
    return (pd.Timestamp(y, m, 1) + pd.offsets.MonthEnd(0)).date()


def monthly(spark, months, prices):
    return spark.createDataFrame([("a", month(2020, m), float(p)) for m, p in zip(months, prices)], "entity string, month date, p double")


def test_gap_months(spark):
    df = timeline.gap_aware_return(monthly(spark, [1, 2, 4, 5], [1, 2, 3, 6]), "entity", "month", "p", "r")
    rates = spark.createDataFrame([(month(2020, m), 0.01) for m in range(1, 13)], "month date, rate double")
    out = timeline.next_period_target(df, "entity", "month", "r", rates, "rate", "t").orderBy("month").collect()
    assert [r.r for r in out] == [None, 1.0, None, 1.0]
    assert [r.r_gap for r in out] == [False, False, True, False]
    assert [None if r.t is None else round(r.t, 9) for r in out] == [0.99, None, 0.99, None]
    assert [r.t_gap for r in out] == [False, True, False, False]


def test_momentum_needs_a_full_frame(spark):
    n = 12
    rows = [("a", month(2019 + (k // 12), k % 12 + 1), 0.1 if k != 3 else None) for k in range(n)]
    df = spark.createDataFrame(rows, "entity string, month date, r double")
    w = Window.partitionBy("entity").orderBy("month")
    out = [r[0] for r in df.select("month", timeline.compounded_return("r", 6, w).alias("m")).orderBy("month").select("m").collect()]
    assert out[:10] == [None] * 10  # short at first, then the missing value stays in the frame until row 9
    assert out[10] == pytest.approx(1.1**6 - 1)


def test_rolling_short_history(spark):
    df = spark.createDataFrame([("a", month(2019, k), 1.0) for k in range(1, 12)], "entity string, month date, x double")
    w = Window.partitionBy("entity").orderBy("month")
    assert df.select(timeline.rolling("x", "mean", 12, w).alias("m")).filter("m is not null").count() == 0


@pytest.mark.parametrize("block_rows", [None, 40])
def test_rolling_pair_moments_equal_pandas(spark, block_rows):
    rng = np.random.default_rng(1)
    frames = []
    for entity, n in [("long", 400), ("short", 20)]:
        days = pd.bdate_range("2015-01-01", periods=n * 2)[rng.permutation(n * 2)[:n]].sort_values()
        frames.append(pd.DataFrame({"entity": entity, "date": days.date, "x": 1e4 + rng.normal(size=n), "y": rng.normal(size=n)}))
    pdf = pd.concat(frames, ignore_index=True)
    out = timeline.rolling_pair_moments(spark.createDataFrame(pdf), "entity", "date", "x", "y", 30, 10, block_rows).toPandas()
    assert len(out) == len(pdf)
    out = out.sort_values(["entity", "date"]).reset_index(drop=True)
    for entity, g in pdf.sort_values(["entity", "date"]).groupby("entity"):
        got = out[out.entity == entity].reset_index(drop=True)
        g = g.reset_index(drop=True)
        np.testing.assert_allclose(got["var_x"], g.x.rolling(30, min_periods=10).var(), rtol=1e-7, equal_nan=True)
        np.testing.assert_allclose(got["cov"], g.x.rolling(30, min_periods=10).cov(g.y), rtol=1e-6, atol=1e-9, equal_nan=True)


def test_constant_market_gives_no_beta(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(k), float(k % 3), 7.5) for k in range(20)]
    df = spark.createDataFrame(rows, "entity string, date date, r double, m double")
    out = timeline.rolling_beta(df, "entity", "date", "r", "m", 10, 5)
    assert out.filter("beta_12m is not null").count() == 0


def test_positions_and_blocks(spark):
    df = spark.createDataFrame([("a", dt.date(2010, 1, 1) + dt.timedelta(40 * k)) for k in range(50)], "entity string, date date")
    pos = timeline.history_positions(df, "entity", "date")
    assert [r[0] for r in pos.orderBy("date").select("__pos").collect()] == list(range(50))
    blocks = timeline.history_blocks(pos, 3, 10)
    assert blocks.filter("not __halo").count() == 50
    assert blocks.filter("__halo and __block = 1").orderBy("__pos").select("__pos").collect() == [(7,), (8,), (9,)]


def bars(spark, rows):
    return spark.createDataFrame(rows, "entity string, date date, open double, high double, low double, close double, adj_close double, volume double")


def test_flags(spark):
    d = [dt.date(2020, 1, k) for k in range(1, 6)]
    nan = None
    df = bars(spark, [
        ("a", d[0], 1.0, nan, 1.0, 1.0, 1.0, 5.0),   # missing high: not an OHLC violation
        ("a", d[1], 1.0, 0.5, 0.7, 1.0, 1.0, 5.0),   # high below low
        ("a", d[2], 1.0, 1.0, 1.0, 1.0, 0.0, 5.0),   # zero price
        ("a", d[3], 5.0, 5.0, 5.0, 5.0, 5.0, 5.0),   # jump from zero
        ("a", d[4], 5.0, 5.0, 5.0, 5.0, 25.0, 5.0),  # +400 %
    ])
    out = clean.flag_bars(df, "entity", "date").orderBy("date").collect()
    assert [r.bad_ohlc for r in out] == [False, True, False, False, False]
    assert [r.missing_core for r in out] == [True, False, False, False, False]
    assert [r.nonpositive_price for r in out] == [False, False, True, False, False]
    assert [r.extreme_return for r in out] == [False, False, True, True, True]


def test_drop_repeats_keeps_last(spark):
    rows = [("a", dt.date(2020, 1, 1), k, float(k)) for k in (3, 1, 2)] + [("b", dt.date(2020, 1, 1), 1, 9.0)]
    out = clean.drop_repeats(spark.createDataFrame(rows, "entity string, date date, o int, x double"), "entity", "date", ["o"])
    assert {(r.entity, r.x, r.dropped_rows) for r in out.collect()} == {("a", 3.0, 2), ("b", 9.0, 0)}
    rows += [("a", None, 1, 1.0), ("a", None, None, 2.0), (None, dt.date(2020, 1, 1), 1, None)]
    out = clean.drop_repeats(spark.createDataFrame(rows, "entity string, date date, o int, x double"), "entity", "date", ["o"])
    assert {(r.entity, r.date, r.x, r.dropped_rows) for r in out.collect() if None in (r.entity, r.date)} == {("a", None, 1.0, 1), (None, dt.date(2020, 1, 1), None, 0)}
    assert out.count() == 4


def test_hot_key_is_pruned_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = relational.keep_last(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_last_non_null_and_top_mean(spark):
    d = [dt.date(2020, 1, k) for k in range(1, 5)]
    df = spark.createDataFrame([("a", d[0], 3.0), ("a", d[1], 1.0), ("a", d[2], 2.0), ("a", d[3], None), ("b", d[0], None)], "k string, d date, x double")
    last = df.groupBy("k").agg(resample.last_value("x", "d").alias("x")).orderBy("k").collect()
    assert [r.x for r in last] == [2.0, None]
    top = resample.mean_of_top(df, ["k"], "x", 5, "m").orderBy("k").collect()
    assert [r.m for r in top] == [2.0, None]
    assert resample.mean_of_top(df, ["k"], "x", 2, "m").filter("k = 'a'").first().m == 2.5


def test_fragmented(spark):
    rows = [("a", month(2020, m)) for m in (1, 2, 6)] + [("b", month(2020, m)) for m in (1, 4, 5)]
    df = spark.createDataFrame(rows, "entity string, month date")
    kept, other = timeline.remove_fragmented(df, [df], "entity", "month", 2)
    assert {r.entity for r in kept.collect()} == {"b"} == {r.entity for r in other.collect()}


def test_islands(spark):
    values = [1, 1, 2, None, None, 2]
    df = spark.createDataFrame([("a", dt.date(2020, 1, k + 1), v) for k, v in enumerate(values)], "k string, d date, v int")
    runs = islands.value_runs(df, ["k"], "d", "v").orderBy("run").collect()
    assert [(r.value, r.length) for r in runs] == [(1, 2), (2, 1), (None, 1), (None, 1), (2, 1)]
    best = islands.longest_run(df, ["k"], "d", "v").first()
    assert (best.value, best.length, best.start) == (1, 2, dt.date(2020, 1, 1))


def test_month_sequence(spark):
    df = spark.createDataFrame([(month(2019, 11),), (month(2020, 2),), (month(2020, 3),)], "month date")
    assert [r[0] for r in islands.month_sequence_gaps(df, "month").orderBy("month").collect()] == [month(2019, 12), month(2020, 1)]


def random_bars(seed=3, entities=3, days=500):
    rng = random.Random(seed)
    rows = []
    for e in range(entities):
        price = 50.0
        for k in range(days):
            price *= math.exp(rng.gauss(0, 0.02))
            rows.append((f"e{e}", dt.date(2018, 1, 1) + dt.timedelta(k), price, price * 1.01, price * 0.99, price, price, float(rng.randint(0, 50))))
    return rows


def test_no_look_ahead(spark):
    """Changing prices after a date leaves all earlier features untouched."""
    cut = dt.date(2019, 3, 31)
    rows = random_bars()
    changed = [r if r[1] <= cut else (*r[:2], *[v * 3 for v in r[2:7]], r[7]) for r in rows]
    market = spark.createDataFrame([(dt.date(2018, 1, 1) + dt.timedelta(k), math.sin(k)) for k in range(500)], "date date, market_ret double")

    def features(data):
        b = bars(spark, data)
        m = timeline.gap_aware_return(resample.resample_monthly(b, "entity", "date"), "entity", "month", "last_adj_close", "ret_1m")
        risk = resample.monthly_risk(resample.daily_returns(b, "entity", "date"), market, "entity", "date", 60, 30)
        out = timeline.price_trends(m, "entity", "month").join(risk, ["entity", "month"], "left")
        return out.filter(F.col("month") <= F.lit(cut)).orderBy("entity", "month").collect()

    assert features(rows) == features(changed)


def test_resample_equals_pandas(spark):
    pdf = pd.DataFrame(random_bars(), columns=names.BAR_COLUMNS)
    got = resample.resample_monthly(bars(spark, random_bars()), "entity", "date").toPandas().sort_values(["entity", "month"]).reset_index(drop=True)
    pdf["month"] = pd.to_datetime(pdf.date).dt.to_period("M")
    pdf["ret"] = pdf.groupby("entity").adj_close.pct_change()
    pdf["dv"] = pdf.adj_close * pdf.volume
    g = pdf.groupby(["entity", "month"])
    np.testing.assert_allclose(got.rmax5_21d, g.ret.apply(lambda v: v.nlargest(5).mean()).to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(got.std_dolvol_1m, g.dv.std().to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(got.zerotrade_1m, g.volume.apply(lambda v: (v == 0).mean()).to_numpy())
    np.testing.assert_allclose(got.last_adj_close, g.adj_close.last().to_numpy())
