import pytest
import datetime as dt

from pyspark.sql import functions as F

from panelmill.functions import scalars as s

D = dt.date


def one(spark, *cols, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return tuple(row.select(*cols).first())


def test_month_ends(spark):
    df = spark.createDataFrame([(D(2020, 1, 31),), (D(2020, 2, 29),), (D(2019, 8, 31),)], "d date")
    rows = df.select(s.shift_month_end("d", 1).alias("n"), s.shift_month_end("d", 6).alias("a")).collect()
    assert [r.n for r in rows] == [D(2020, 2, 29), D(2020, 3, 31), D(2019, 9, 30)]
    assert [r.a for r in rows] == [D(2020, 7, 31), D(2020, 8, 31), D(2020, 2, 29)]


def test_safe_ratio_has_one_missing_value(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1.0, 2.0), (1.0, 0.0), (1.0, None), (1.0, nan), (inf, 1.0), (1.0, inf), (0.0, 0.0)]
    df = spark.createDataFrame(data, "n double, d double")
    assert [r[0] for r in df.select(s.safe_ratio("n", "d")).collect()] == [0.5] + [None] * 6


def test_coercions(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("NaN",), (None,), ("2e400",)], "t string")
    assert [r[0] for r in df.select(s.to_double("t")).collect()] == [1.5, None, None, None, None]
    codes = spark.createDataFrame([("199001",), ("199913",), ("x",), (None,)], "t string")
    assert [r[0] for r in codes.select(s.parse_yyyymm("t")).collect()] == [D(1990, 1, 31), None, None, None]


def test_symbols_and_booleans(spark):
    df = spark.createDataFrame([(" brk.b ",), ("a b.c",), ("nan",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(s.clean_symbol("t")).collect()] == ["BRK-B", "AB-C", None, None, None]
    flags = spark.createDataFrame([(" True",), ("1",), ("0",), ("yes",), (None,)], "t string")
    assert [r[0] for r in flags.select(s.parse_bool("t")).collect()] == [True, True, False, False, False]


def test_clip_and_logs(spark):
    df = spark.createDataFrame([(5.0, 1.0, 3.0), (0.0, 1.0, 3.0), (2.0, None, 3.0), (None, 1.0, 3.0)], "x double, a double, b double")
    assert [r[0] for r in df.select(s.clip("x", "a", "b")).collect()] == [3.0, 1.0, 2.0, None]
    logs = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,)], "x double")
    assert [r[0] for r in logs.select(s.positive_log("x")).collect()] == [None, None, 0.0, None]
    assert [r[0] for r in logs.select(s.sqrt_nonnegative("x")).collect()] == [0.0, 0.0, 1.0, None]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2.0)], ["Effective Date", "Added-Ticker"])
    assert s.normalize_columns(df).columns == ["effective_date", "added_ticker"]
    assert s.find_column(df, ["added", "ticker"]) == "Added-Ticker"
    for words in (["removed"], ["e"]):
        with pytest.raises(ValueError, match="columns match"):
            s.find_column(df, words)
    with pytest.raises(ValueError, match="collides"):
        s.normalize_columns(spark.createDataFrame([(1, 2)], ["Adj Close", "adj-close"]))
    assert df.select(s.optional_column(df, "nope").alias("x")).first().x is None


def test_parameter_text(spark):
    df = spark.createDataFrame([("{'alpha': np.float64(0.015), 'l1_ratio': 0.85}",)], "t string")
    assert df.select(s.parameters_from_text("t")).first()[0] == {"alpha": 0.015, "l1_ratio": 0.85}
