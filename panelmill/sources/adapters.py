"""Panel-shaped views over the star-schema tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.functions.scalars import month_end
from panelmill.operators.timeline import gap_aware_return
from panelmill.operators.resample import last_value

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades: supplier = entity, ship date = day."""
    line = table(spark, sf_dir, "lineitem")
    px = 100 * (1 + F.col("l_discount") + F.col("l_tax"))
    return line.select(
        F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date"), px.alias("px"),
        F.col("l_quantity").alias("q"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, one row per entity and day."""
    lines = priced_lines(spark, sf_dir)
    vwap = F.round(F.sum(F.col("px") * F.col("q")) / F.sum("q"), 6)
    return lines.groupBy("entity", "date").agg(
        F.round(F.avg("px"), 6).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        vwap.alias("close"), vwap.alias("adj_close"), F.sum("q").alias("volume"),
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per order line: repeated days, missing volumes, swapped highs and lows, zero prices."""
    lines = priced_lines(spark, sf_dir)
    swapped = F.col("l_orderkey") % 50 == 0
    top, bottom = F.col("px") + 1, F.col("px") - 1
    return lines.select(
        "entity", "date",
        F.col("px").alias("open"),
        F.when(swapped, bottom).otherwise(top).alias("high"),
        F.when(swapped, top).otherwise(bottom).alias("low"),
        F.col("px").alias("close"),
        F.when(F.col("l_partkey") % 211 != 0, F.col("px")).otherwise(F.lit(0.0)).alias("adj_close"),
        F.when(F.col("q") != 1, F.col("q")).alias("volume"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


RAW_BAR_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("adj_close"), F.count(F.lit(1)).cast("double").alias("level")
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(month_end("o_orderdate").alias("month")).agg((F.count(F.lit(1)) / 1e6).alias("rate"))


MACRO = ["m1", "m2", "m3", "m4"]


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")

    def share(priority: str):
        return F.avg((F.col("o_orderpriority") == priority).cast("double"))

    return orders.groupBy(month_end("o_orderdate").alias("month")).agg(
        (F.avg("o_totalprice") / 1e5).alias("m1"), (F.stddev_samp("o_totalprice") / 1e5).alias("m2"),
        share("1-URGENT").alias("m3"), share("5-LOW").alias("m4"),
    )


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end price per entity with the gap-aware return."""
    b = bars(spark, sf_dir)
    monthly = b.groupBy("entity", month_end("date").alias("month")).agg(last_value("adj_close", "date").alias("last_adj_close"))
    return gap_aware_return(monthly, "entity", "month", "last_adj_close", "ret_1m")


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual reports in the raw layout (text keys, some items absent, some missing)."""
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per = line.groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("at"), F.round(F.sum(net), 4).alias("sale"),
        F.round(F.sum("l_quantity"), 2).alias("invt"), F.round(F.sum("l_tax"), 2).alias("dlc"), F.count(F.lit(1)).alias("lines"),
    )
    joined = per.join(supplier, "l_suppkey", "left")
    n = F.col("lines")

    def sometimes(c, modulus: int):
        return F.when(n % modulus != 0, c)

    return joined.select(
        F.concat(F.lit(" s"), F.col("l_suppkey")).alias("tic"),
        F.col("l_suppkey").cast("string").alias("gvkey"),
        F.concat_ws("-", F.col("yr").cast("string"), F.lit("12"), F.lit("31")).alias("datadate"),
        F.when(n % 97 == 0, "X").otherwise("C").alias("consol"),
        "at", "sale", "invt", "dlc",
        sometimes(F.col("at") * 0.4, 5).alias("ceq"),
        sometimes(F.col("at") * 0.3, 3).alias("seq"),
        (F.col("at") * 0.55).alias("lt"),
        sometimes(F.col("sale") * 0.6, 4).alias("cogs"),
        sometimes(F.col("sale") * 0.05, 2).alias("xrd"),
        sometimes(F.col("sale") * 0.12, 7).alias("oiadp"),
        (F.col("sale") * 0.02 - F.col("invt")).alias("oancf"),
        F.when(n % 6 == 0, 0.0).otherwise(F.col("invt") * 3).alias("lct"),
        (F.col("invt") * 5).alias("act"),
        (F.col("invt") * 2).alias("ppegt"),
        (F.col("invt") + F.col("dlc")).alias("capx"),
        (F.col("invt") / 10).alias("csho"),
        (-F.col("at") / 1e5).alias("prcc_f"),
        sometimes(F.col("dlc"), 8).alias("dvt"),
        F.col("dlc").alias("che"),
        F.col("dlc").alias("rect"),
        (F.col("sale") * 0.01).alias("ib"),
        (F.col("s_nationkey") * 100 + 5).cast("string").alias("sic"),
    )


def panel_predictions(spark: SparkSession, sf_dir: str, split: str = "1999-12-31") -> DataFrame:
    """Long prediction table: the month return forecast by its mean, its lag and half its lag."""
    m = monthly_prices(spark, sf_dir)
    w = Window.partitionBy("entity").orderBy("month")
    base = m.select("entity", "month", F.col("ret_1m").alias("realized_target"), F.lag("ret_1m").over(w).alias("lag1")).dropna()
    in_sample = F.col("month") <= F.lit(split).cast("date")
    mean = base.filter(in_sample).agg(F.round(F.avg("realized_target"), 9)).scalar()
    with_mean = base.withColumn("mean", mean)
    forecasts = F.explode(
        F.array(
            F.struct(F.lit("historical_mean").alias("model"), F.col("mean").alias("prediction")),
            F.struct(F.lit("lag").alias("model"), F.col("lag1").alias("prediction")),
            F.struct(F.lit("half_lag").alias("model"), (F.col("lag1") * 0.5).alias("prediction")),
        )
    )
    long = with_mean.select("entity", "month", "realized_target", forecasts.alias("f"), F.col("mean").alias("benchmark"))
    sample = F.when(F.col("month") <= F.lit(split).cast("date"), "validation").otherwise("test")
    return long.select(
        F.col("f.model").alias("model"), sample.alias("sample"), "entity", "month", "realized_target",
        F.col("f.prediction").alias("prediction"), "benchmark",
    )

