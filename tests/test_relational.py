import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelmill.operators import accounting, folds, quality, relational


def d(k):
    return dt.date(2019, 1, 1) + dt.timedelta(days=k)


@pytest.mark.parametrize("split", [None, "year", "month"])
def test_asof_equals_brute_force(spark, split):
    rng = random.Random(5)
    left = [(rng.choice("abc"), d(rng.randint(0, 900)), k) for k in range(120)]
    right = list({(rng.choice("abcd"), d(rng.randint(0, 900))): None for _ in range(40)})
    right = [(k, t, i) for i, (k, t) in enumerate(right)]
    ldf = spark.createDataFrame(left, "k string, t date, id int")
    rdf = spark.createDataFrame(right, "k string, rt date, v int")
    got = {r.id: r.v for r in relational.asof_join(ldf, rdf, ["k"], "t", "rt", split).collect()}
    want = {}
    for k, t, i in left:
        past = [(rt, v) for rk, rt, v in right if rk == k and rt <= t]
        want[i] = max(past)[1] if past else None
    assert got == want


def test_stale_edges(spark):
    panel = spark.createDataFrame([("a", dt.date(2021, m, 28)) for m in (5, 6)] + [("a", dt.date(2020, 6, 30)), ("a", dt.date(2020, 5, 31))], "entity string, month date")
    panel = panel.withColumn("month", F.last_day("month"))
    reports = spark.createDataFrame([("a", "c", dt.date(2019, 11, 30), 5.0)], "entity string, company string, datadate date, x double")
    available = accounting.with_availability(reports)  # available 2020-05-31
    out = {r.month: r for r in accounting.merge_reports(panel, available).collect()}
    assert out[dt.date(2020, 5, 31)].x == 5.0  # on the month itself
    assert out[dt.date(2021, 5, 31)].x == 5.0  # 12 months old
    late = out[dt.date(2021, 6, 30)]           # 13 months old
    assert late.x is None and late.company is None and late.has_compustat_annual == 0 and late.stale_report


def test_two_companies_one_month(spark):
    rows = [("a", "2", dt.date(2019, 1, 15), 1.0), ("a", "1", dt.date(2019, 1, 20), 2.0), ("a", "0", dt.date(2019, 1, 20), 3.0)]
    out = accounting.with_availability(spark.createDataFrame(rows, "entity string, company string, datadate date, x double")).collect()
    assert [r.x for r in out] == [2.0]


def test_growth_spacing(spark):
    rows = [("c", dt.date(2018, 12, 31), 10.0), ("c", dt.date(2019, 12, 31), 12.0), ("c", dt.date(2021, 12, 31), 20.0), ("c", dt.date(2022, 12, 31), 0.0), ("c", dt.date(2023, 12, 31), 5.0)]
    df = spark.createDataFrame(rows, "company string, datadate date, at double")
    full = df.select("*", *[F.lit(1.0).alias(c) for c in ("sale", "capx", "ppegt", "invt")])
    out = accounting.report_growth(full).orderBy("datadate").collect()
    assert [None if r.asset_growth is None else round(r.asset_growth, 6) for r in out] == [None, 0.2, None, -1.0, None]


def test_join_checks(spark):
    one = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    two = spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(ValueError, match="duplicate"):
        relational.join_checked(two, one, ["k"])
    assert relational.join_checked(one, two, ["k"]).count() == 2
    with pytest.raises(ValueError):
        relational.join_checked(one, two, ["k"], validate="one_to_one")
    with pytest.raises(ValueError, match="missing columns"):
        relational.require_columns(one, ["k", "nope"])


def test_period_joins(spark):
    panel = spark.createDataFrame([("a", dt.date(2020, 1, 31)), ("a", dt.date(2020, 2, 29))], "entity string, month date")
    dim = spark.createDataFrame([(dt.date(2020, 1, 31), 1.0), (dt.date(2020, 2, 29), 2.0), (dt.date(2020, 3, 31), 3.0)], "month date, x double")
    assert [r.x for r in relational.join_lagged_period(panel, dim, "month", "month").orderBy("month").collect()] == [None, 1.0]
    assert [r.x for r in relational.join_lead_period(panel, dim, "month").orderBy("month").collect()] == [2.0, 3.0]


def test_sets_and_upsert(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {r.k for r in relational.union_keys("k", a, b).collect()} == {1, 2, 3}
    assert tuple(relational.same_keys(a, b, ["k"]).first()) == (1, 1, False)
    assert tuple(relational.same_keys(a, a, ["k"]).first()) == (0, 0, True)
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert {tuple(r) for r in relational.upsert(old, new, ["k"]).collect()} == {(1, "o"), (2, "n"), (3, "n")}


def test_stable_sample_ignores_partitioning(spark):
    df = spark.range(1000)
    one = relational.stable_sample(df.repartition(7), ["id"], 20).collect()
    two = relational.stable_sample(df.coalesce(1), ["id"], 20).collect()
    assert one == two


def test_folds(spark):
    df = spark.createDataFrame([(dt.date(y, 6, 30), y) for y in range(2003, 2008)], "t date, y int")
    f = folds.fold_table(spark, [2005, 2006])
    rows = folds.expand_folds(df, f, "t").collect()
    assert {(r.fold_number, r.y) for r in rows if r.role == "validation"} == {(1, 2005), (2, 2006)}
    assert {(r.fold_number, r.y) for r in rows if r.role == "train"} == {(1, 2003), (1, 2004), (2, 2003), (2, 2004), (2, 2005)}
    assert folds.fold_problems(folds.fold_bounds(df, f, "t")).count() == 0
    assert [r.empty for r in folds.fold_problems(folds.fold_bounds(df, folds.fold_table(spark, [2010]), "t")).collect()] == [True]


def test_ties_pick_first_candidate(spark):
    rows = [("f", "f_002", 1.0), ("f", "f_001", 1.0), ("f", "f_003", 2.0)]
    df = spark.createDataFrame(rows, "model_family string, candidate_id string, average_monthly_mse double")
    assert [r.candidate_id for r in folds.select_minimum(df).collect()] == ["f_001"]


def test_expect(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, float("inf"))], "k int, x double")
    checks = [quality.no_nulls(["x"]), quality.no_infinities(["x"])]
    got = {r.check: r.failures for r in quality.expect(df, checks, unique=["k"]).collect()}
    assert got == {"null_values": 1, "infinite_values": 1, "duplicate_keys": 1}
    with pytest.raises(ValueError, match="null_values=1"):
        quality.expect(df, checks, strict=True)
    assert quality.expect(df.filter("x = 1.0"), checks, unique=["k"], strict=True).count() == 3


def test_table_diff(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5)], "k int, x double")
    row = quality.table_diff(a, b, ["k"], ["x"], 1e-12).first()
    assert (row.max_abs_diff, row.unmatched_keys, row.ok) == (0.5, 0, False)
    assert quality.table_diff(a, a, ["k"], ["x"], 1e-12).first().ok


def test_two_rows_for_a_period_are_an_error(spark):
    left = spark.createDataFrame([(1, 10), (2, 20)], "m int, v int")
    once = spark.createDataFrame([(1, 9, None)], "m int, a int, b int")
    assert sorted(relational.join_period(left, once, "m").collect()) == [(1, 10, 9, None), (2, 20, None, None)]
    twice = spark.createDataFrame([(1, 9, 1), (1, 2, 3)], "m int, a int, b int")
    with pytest.raises(Exception, match="two rows for m 1"):
        relational.join_period(left, twice, "m").collect()


def test_missing_rows_are_no_null_mismatch(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double"), spark.createDataFrame([(1, None)], "k int, x double")
    row = quality.table_diff(a, b, ["k"], ["x"], 1e-9).first()
    assert (row.null_mismatches, row.unmatched_keys) == (1, 1)
