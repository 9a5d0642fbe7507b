import numpy as np
import pandas as pd
import pytest

from panelmill.operators import crosssection, evaluate, quantiles
from panelmill.operators.quantiles import group_clip_bounds, group_quantiles


def skewed(n=6000, seed=2):
    """One group holds two thirds of the rows; ties, missing values, an all-missing group, a missing group name."""
    rng = np.random.default_rng(seed)
    g = np.where(np.arange(n) % 3 < 2, "hot", np.where(np.arange(n) % 2 == 0, "b", "c"))
    x = np.where(rng.random(n) < 0.3, 7.0, rng.normal(size=n).round(2))
    x[rng.random(n) < 0.2] = np.nan
    x[g == "c"] = np.nan
    g = np.where(np.arange(n) % 50 == 1, None, g)
    return pd.DataFrame({"g": g, "x": x, "y": rng.lognormal(size=n)})


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double, y double")


def test_quantiles_equal_pandas(spark):
    pdf = skewed()
    probabilities = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    out = group_quantiles(to_spark(spark, pdf), ["g"], ["x", "y"], probabilities).toPandas()
    assert len(out) == 8
    for _, row in out.iterrows():
        v = pdf.loc[pdf.g.isna() if row.g is None else pdf.g == row.g, row.feature].dropna()
        assert row.n == len(v)
        for i, p in enumerate(probabilities):
            if len(v):
                assert row[f"q{i}"] == pytest.approx(v.quantile(p), abs=1e-12)
            else:
                assert row[f"q{i}"] is None or np.isnan(row[f"q{i}"])


def test_quantiles_without_keys(spark):
    pdf = skewed(500)
    row = group_quantiles(to_spark(spark, pdf), [], ["y"], [0.25]).first()
    assert row.q0 == pytest.approx(pdf.y.quantile(0.25))


def test_clip_bounds_are_those_of_the_filled_sample(spark):
    pdf = skewed()
    out = group_clip_bounds(to_spark(spark, pdf), ["g"], ["x"], 0.01, 0.99).toPandas().set_index("g")
    for g in ("hot", "b"):
        v = pdf.loc[pdf.g == g, "x"]
        filled = v.fillna(v.median())
        assert out.loc[g, "median"] == pytest.approx(v.median())
        assert out.loc[g, "lower"] == pytest.approx(filled.quantile(0.01))
        assert out.loc[g, "upper"] == pytest.approx(filled.quantile(0.99))


def test_filled_block_sizes(spark):
    """Few values and many gaps: the bounds fall into the filled block."""
    pdf = pd.DataFrame({"g": ["a"] * 50, "x": [3.0, 1.0, 2.0] + [np.nan] * 47, "y": 0.0})
    row = group_clip_bounds(to_spark(spark, pdf), ["g"], ["x"], 0.01, 0.99).first()
    filled = pdf.x.fillna(2.0)
    assert (row.median, row.lower, row.upper) == pytest.approx((2.0, filled.quantile(0.01), filled.quantile(0.99)))


def test_impute_and_winsorize_equal_pandas(spark):
    pdf = skewed()
    df = to_spark(spark, pdf)
    out = crosssection.impute_and_winsorize(df, "g", ["x", "y"]).toPandas()
    parts = []
    for _, g in pdf.groupby("g", dropna=False):
        f = g[["x", "y"]].fillna(g[["x", "y"]].median()).fillna(0.0)
        parts.append(f.clip(f.quantile(0.01), f.quantile(0.99), axis=1))
    want = pd.concat(parts)
    np.testing.assert_allclose(np.sort(out.x), np.sort(want.x), atol=1e-12)
    np.testing.assert_allclose(np.sort(out.y), np.sort(want.y), atol=1e-12)


def test_winsor_small_example(spark):
    pdf = pd.DataFrame({"g": "a", "x": [1.0, 2.0, 4.0, 10.0], "y": 0.0})
    row = group_clip_bounds(to_spark(spark, pdf), ["g"], ["x"], 0.01, 0.99).first()
    assert (round(row.lower, 9), round(row.upper, 9)) == (1.03, 9.82)


def test_one_hot(spark):
    df = spark.createDataFrame([("13",), ("2",), ("x",), (None,)], "sic2 string")
    out, labels = crosssection.one_hot(df, "sic2", "sic2")
    assert labels == ["sic2_missing", "sic2_2", "sic2_13"]
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 0, 0)]


def test_interactions_are_state_major(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0, 7.0)], "a double, b double, s double, t double")
    out, made = crosssection.interactions(df, ["a", "b"], ["s", "t"])
    assert made == ["a_x_s", "b_x_s", "a_x_t", "b_x_t"]
    assert tuple(out.select(*made).first()) == (10.0, 15.0, 14.0, 21.0)


def predictions(spark, rows):
    return spark.createDataFrame(rows, "model string, sample string, month date, realized_target double, prediction double, benchmark double")


def test_uneven_months_and_constant_forecast(spark):
    import datetime as dt

    a, b = dt.date(2020, 1, 31), dt.date(2020, 2, 29)
    rows = [("m", "s", a, 2.0, 0.0, 1.0)] + [("m", "s", b, 1.0, 0.0, 1.0)] * 9
    row = evaluate.forecast_metrics(predictions(spark, rows), ["model", "sample"]).first()
    assert row.pooled_mse == pytest.approx(1.3) and row.monthly_mse == pytest.approx(2.5)
    assert row.prediction_target_correlation is None and row.months == 2
    perfect = [("m", "s", a, 1.0, 1.0, 1.0)] * 2
    assert evaluate.forecast_metrics(predictions(spark, perfect), ["model"]).first().oos_r2 is None


def test_metrics_equal_numpy(spark):
    import datetime as dt

    rng = np.random.default_rng(0)
    n = 300
    y, p = 5 + rng.normal(size=n), rng.normal(size=n)
    rows = [("m", "s", dt.date(2020, 1 + k % 5, 28), float(y[k]), float(p[k]), 5.0) for k in range(n)]
    row = evaluate.forecast_metrics(predictions(spark, rows), ["model"]).first()
    assert row.prediction_target_correlation == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert row.prediction_std == pytest.approx(np.std(p))
    assert row.oos_r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - 5) ** 2).sum())


def test_distribution_summary_keeps_every_group(spark):
    rows = [("a", 1.0, None), ("a", 3.0, None), ("b", 2.0, "x"), ("b", None, "y"), (None, 5.0, "x"), (None, 7.0, "x")]
    out = evaluate.distribution_summary(spark.createDataFrame(rows, "g string, v double, c string"), ["g"], "v", {"kinds": "c"}).collect()
    assert {(r.g, r.observations, r.mean, r.median, r.kinds) for r in out} == {("a", 2, 2.0, 2.0, 0), ("b", 2, 2.0, 2.0, 2), (None, 2, 6.0, 6.0, 1)}


@pytest.mark.parametrize(("gather", "most"), [(50_000, 1 << 19), (3, 1 << 19), (0, 0)])
def test_radix_quantiles_equal_numpy(spark, monkeypatch, gather, most):
    """Ties, signed zeros, tiny and huge values, groups of 1 to 2,000 rows, NULL keys and groups without a value; bins refined down to the last bit."""
    monkeypatch.setattr(quantiles, "GATHER", gather)
    monkeypatch.setattr(quantiles, "MOST_BINS", most)
    rng = np.random.default_rng(gather)
    rows = []
    for g, n in enumerate((5, 1, 200, 2000, 40, 3)):
        for _ in range(n):
            x = None if g == 5 or rng.random() < 0.1 else float(rng.choice([0.0, -0.0, rng.normal(), rng.normal() * 1e-300, rng.normal() * 1e300, -5.5, 7.0]))
            rows.append((None if g == 4 else g, x, float(rng.integers(-3, 3))))
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(5)
    got = {(r.g, r.feature): r for r in quantiles.group_quantiles(df, ["g"], ["x", "y"], [0.01, 0.5, 0.83]).collect()}
    assert len(got) == 12
    for g in (0, 1, 2, 3, None, 5):
        own = [r for r in rows if r[0] == g]
        for place, feature in ((1, "x"), (2, "y")):
            present = np.array([r[place] for r in own if r[place] is not None])
            r = got[g, feature]
            assert (r.n, r.total) == (len(present), len(own))
            want = np.quantile(present, [0.01, 0.5, 0.83]) if len(present) else [None] * 3
            for a, b in zip((r.q0, r.q1, r.q2), want):
                assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12, abs=0)
