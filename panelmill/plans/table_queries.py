"""Queries on sources, projections, filters, joins and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelmill.functions import names, scalars
from panelmill.operators import crosssection, quality, relational
from panelmill.plans.registry import query, r, rounded, with_views
from panelmill.plans.views_sql import BARS, MARKET, PRICES, RATES
from panelmill.session import shared_folder
from panelmill.sources import adapters as src
from panelmill.sources import readers, sinks

# --- sources -----------------------------------------------------------------------


@query(
    "parquet_scan",
    "SELECT l_orderkey, l_suppkey, round(l_extendedprice, 2) + 0.0 AS l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_quantity < 10",
)
def parquet_scan(spark, sf):
    line = readers.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"])
    kept = line.filter((F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10))
    return rounded(kept.select("l_orderkey", "l_suppkey", "l_extendedprice"), 2)


@query(
    "factor_text_lines",
    """SELECT last_day(CAST(o_orderdate AS DATE)) AS month, round(count(*) / 100.0, 6) + 0.0 AS rate FROM orders
GROUP BY 1 HAVING month(last_day(CAST(o_orderdate AS DATE))) <> 7""",
)
def factor_text_lines(spark, sf):
    """Text lines as a factor archive has them: header, months, a block of annual rows, a bad number."""
    orders = src.table(spark, sf, "orders")
    n = F.count(F.lit(1)).cast("string")
    month = orders.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("k"), F.month("o_orderdate").alias("m")).agg(n.alias("n"))
    value = F.when(F.col("m") == 7, F.lit("n/a")).otherwise(F.col("n"))
    lines = month.select(F.concat(F.lit(" "), "k", F.lit(", 1.0,  -0.5, 0.2, "), value).alias("value"))
    annual = orders.groupBy(F.date_format("o_orderdate", "yyyy").alias("k")).agg(n.alias("n"))
    noise = annual.select(F.concat("k", F.lit(", 1, 2, 3, "), "n").alias("value"))
    header = annual.select(F.lit(",Mkt-RF,SMB,HML,RF").alias("value"))
    return rounded(readers.parse_factor_lines(lines.unionByName(noise).unionByName(header)), 6)


@query(
    "macro_states",
    """WITH m AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, avg(o_totalprice) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
  CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)
SELECT month, round(ln(lo / a), 8) + 0.0 AS wg_dp, round(CASE WHEN month(month) <> 3 THEN ln(hi / a) END, 8) + 0.0 AS wg_ep, round(n / 100, 8) + 0.0 AS wg_bm,
  round(n / 1000, 8) + 0.0 AS wg_ntis, round(lo / 1e6, 8) + 0.0 AS wg_tbl, round(hi / 1e6 - lo / 1e6, 8) + 0.0 AS wg_tms, round(hi - lo, 4) + 0.0 AS wg_dfy,
  round(n, 4) + 0.0 AS wg_svar FROM m WHERE month BETWEEN DATE '1996-01-31' AND DATE '2000-12-31'""",
)
def macro_states(spark, sf):
    orders = src.table(spark, sf, "orders")
    m = orders.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("yyyymm"), F.month("o_orderdate").alias("k")).agg(
        F.avg("o_totalprice").alias("a"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count(F.lit(1)).cast("double").alias("n")
    )
    c = F.col
    text = {
        "Index": c("a"), "D12": c("lo"), "b/m": c("n") / 100, "tbl": c("lo") / 1e6, "AAA": c("lo"), "BAA": c("hi"),
        "lty": c("hi") / 1e6, "ntis": c("n") / 1000, "svar": c("n"),
    }
    earnings = F.when(c("k") == 3, F.lit("-")).otherwise(c("hi").cast("string"))
    raw = m.select("yyyymm", earnings.alias("E12"), *[e.cast("string").alias(k) for k, e in text.items()])
    return rounded(readers.macro_states(raw, "1996-01-31", "2000-12-31"), 8, wg_dfy=4, wg_svar=4)


@query(
    "load_report",
    """SELECT c_custkey AS entity, CASE WHEN count(o_orderkey) > 0 THEN 'downloaded' ELSE 'failed' END AS status,
  CASE WHEN count(o_orderkey) > 0 THEN '' ELSE 'no_data' END AS reason, count(o_orderkey) AS rows, min(CAST(o_orderdate AS DATE)) AS first_date,
  max(CAST(o_orderdate AS DATE)) AS last_date FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def load_report(spark, sf):
    orders = src.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("date"))
    customers = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"))
    return quality.load_report(orders, customers, "entity", "date")


@query(
    "differing_files",
    with_views(BARS)
    + """, f AS (SELECT entity, count(*) AS n, min(date) AS a, max(date) AS z, CASE entity % 7 WHEN 0 THEN 'volume' WHEN 1 THEN 'high,low' ELSE '' END AS missing FROM bars GROUP BY entity)
SELECT CAST(s_suppkey AS VARCHAR) AS entity, CASE WHEN n IS NULL OR missing <> '' THEN 'failed' ELSE 'downloaded' END AS status,
  CASE WHEN missing <> '' THEN 'missing_columns:' || missing WHEN n IS NULL THEN 'no_data' ELSE '' END AS reason, CASE WHEN missing = '' THEN n ELSE 0 END AS rows,
  CASE WHEN missing = '' THEN CAST(a AS VARCHAR) END AS first_date, CASE WHEN missing = '' THEN CAST(z AS VARCHAR) END AS last_date
FROM supplier LEFT JOIN f ON s_suppkey = entity""",
)
def differing_files(spark, sf):
    """Load report of one CSV file per entity, some of which lack columns or have them in another order."""
    folder = f"{shared_folder(spark).rstrip('/')}/panelmill/{uuid.uuid4().hex}"
    bars = src.bars(spark, sf).withColumn("close", F.col("adj_close")).withColumn("kind", F.least(F.pmod("entity", F.lit(7)), F.lit(3)).cast("int"))
    kinds = [["date", "high", "low", "close"], ["date", "close", "volume"], ["volume", "close", "low", "high", "date"], ["date", "high", "low", "close", "volume"]]
    sinks.write_differing_csv(bars, folder, "entity", "date", "kind", kinds)
    rows, missing = readers.read_differing_files(spark, f"{folder}/*/*/*", ["date", "high", "low", "close", "volume"], lambda path: F.regexp_extract(path, r"entity=([^/]+)", 1))
    suppliers = src.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("entity"))
    return quality.load_report(rows, suppliers, "entity", "date", missing)


@query(
    "panel_round_trip",
    with_views(PRICES) + "SELECT entity, month, round(ret_1m, 8) + 0.0 AS ret_1m, year(month) AS year FROM prices WHERE year(month) >= 1998",
)
def panel_round_trip(spark, sf):
    """A panel written by year and read back with a filter that prunes the folders."""
    path = f"{shared_folder(spark).rstrip('/')}/panelmill/{uuid.uuid4().hex}"
    sinks.write_panel(src.monthly_prices(spark, sf).select("entity", "month", "ret_1m"), path)
    back = readers.read_parquet(spark, path, ["entity", "month", "ret_1m", "year"])
    return rounded(back.where("year >= 1998").withColumn("year", F.col("year").cast("long")), 8)


@query(
    "report_round_trip",
    """SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_date FROM orders GROUP BY 1""",
)
def report_round_trip(spark, sf):
    """A report written as one CSV file and read back with a schema and a choice of columns; names with commas and quotes survive."""
    path = f"{shared_folder(spark).rstrip('/')}/panelmill/{uuid.uuid4().hex}"
    report = src.table(spark, sf, "orders").groupBy(F.concat(F.lit('"a", '), "o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min(F.col("o_orderdate").cast("date")).cast("string").alias("first_date"))
    sinks.write_report(report, path)
    back = readers.read_csv(spark, path, "priority string, n long, total double, first_date string", ["priority", "n", "total", "first_date"])
    return back.withColumn("priority", F.regexp_replace("priority", '^"a", ', ""))


@query(
    "contract_round_trip",
    "SELECT CAST(row_number() OVER (ORDER BY c) - 1 AS INT) AS ordinal, c AS predictor FROM (SELECT DISTINCT 'x_' || o_orderpriority AS c FROM orders)",
)
def contract_round_trip(spark, sf):
    """Predictor names written and read back in their order."""
    path = f"{shared_folder(spark).rstrip('/')}/panelmill/{uuid.uuid4().hex}"
    priorities = src.table(spark, sf, "orders").select("o_orderpriority").distinct().collect()  # five of them
    sinks.write_contract(spark, sorted(f"x_{r[0]}" for r in priorities), path)
    return spark.createDataFrame(list(enumerate(readers.read_contract(spark, path))), "ordinal int, predictor string")


_MANIFEST = """WITH o AS (SELECT 'orders_' || o_orderpriority AS file, CAST(o_orderdate AS DATE) AS d FROM orders),
old AS (SELECT file, min(d) AS a, max(d) AS b FROM o WHERE d < DATE '1998-01-01' GROUP BY file),
new AS (SELECT file, min(d) AS a, max(d) AS b FROM o WHERE file IN ('orders_1-URGENT', 'orders_2-HIGH') GROUP BY file)"""


@query(
    "manifest_upsert",
    _MANIFEST
    + """SELECT file, 'old' AS source, CAST(a AS VARCHAR) AS coverage_start, CAST(b AS VARCHAR) AS coverage_end FROM old WHERE file NOT IN (SELECT file FROM new)
UNION ALL SELECT file, 'new', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM new""",
)
def manifest_upsert(spark, sf):
    orders = src.table(spark, sf, "orders").select(
        F.concat(F.lit("orders_"), "o_orderpriority").alias("file"), F.col("o_orderdate").cast("date").alias("d")
    )

    def coverage(df, source):
        return df.groupBy("file").agg(
            F.lit(source).alias("source"), F.lit("today").alias("created_on"), F.min("d").cast("string").alias("coverage_start"),
            F.max("d").cast("string").alias("coverage_end"), F.lit("").alias("notes"),
        )

    old = coverage(orders.filter(F.col("d") < F.lit("1998-01-01").cast("date")), "old")
    new = coverage(orders.filter(F.col("file").isin("orders_1-URGENT", "orders_2-HIGH")), "new")
    return sinks.update_manifest(old, new).select("file", "source", "coverage_start", "coverage_end")


@query(
    "manifest_in_place",
    _MANIFEST
    + """SELECT file, 'old' AS source, CAST(a AS VARCHAR) AS coverage_start, CAST(b AS VARCHAR) AS coverage_end FROM old WHERE file NOT IN (SELECT file FROM new)
UNION ALL SELECT file, 'new', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM new""",
)
def manifest_in_place(spark, sf):
    """A stored manifest that is updated twice, the second time twice over, and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/panelmill/{uuid.uuid4().hex}"
    orders = src.table(spark, sf, "orders").select(F.concat(F.lit("orders_"), "o_orderpriority").alias("file"), F.col("o_orderdate").cast("date").alias("d"))
    new = orders.filter(F.col("file").isin("orders_1-URGENT", "orders_2-HIGH"))
    for df, source in ((orders.filter(F.col("d") < F.lit("1998-01-01").cast("date")), "old"), (new, "new"), (new, "new")):
        rows = df.groupBy("file").agg(
            F.lit(source).alias("source"), F.current_date().cast("string").alias("created_on"), F.min("d").cast("string").alias("coverage_start"),
            F.max("d").cast("string").alias("coverage_end"), F.lit("").alias("notes"),
        )
        sinks.store_manifest(spark, path, rows)
    return readers.read_version(spark, path).select("file", "source", "coverage_start", "coverage_end")


@query(
    "key_value_summary",
    """SELECT 'rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'customers', CAST(count(DISTINCT o_custkey) AS VARCHAR) FROM orders
UNION ALL SELECT 'first_day', CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) FROM orders UNION ALL SELECT 'last_day', CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) FROM orders""",
)
def key_value_summary(spark, sf):
    day = F.col("o_orderdate").cast("date")
    items = {"rows": F.count(F.lit(1)), "customers": F.countDistinct("o_custkey"), "first_day": F.min(day), "last_day": F.max(day)}
    return quality.key_value_summary(src.table(spark, sf, "orders"), items)


@query(
    "column_helpers",
    "SELECT c_custkey AS c_cust_key, CAST(NULL AS DOUBLE) AS absent, round(c_acctbal, 2) + 0.0 AS balance, c_nationkey AS found FROM customer",
)
def column_helpers(spark, sf):
    """Name normalisation, a column that does not exist, and a column found by words in its name."""
    customer = src.table(spark, sf, "customer")
    wild = customer.withColumnsRenamed({"c_custkey": " C Cust-Key ", "c_nationkey": "Nation_of_Customer key", "c_acctbal": "Balance"})
    found = scalars.find_column(wild, ["customer", "nation"])
    out = wild.withColumn("found", F.col(f"`{found}`"))
    tidy = scalars.normalize_columns(out)
    return rounded(tidy.select("c_cust_key", scalars.optional_column(tidy, "absent").alias("absent"), "balance", "found"), 2)


# --- projections and filters -----------------------------------------------------------
@query(
    "symbol_cleaning",
    """SELECT p_partkey, upper(trim(p_name)) AS code, CASE WHEN p_size % 10 = 0 THEN NULL ELSE replace(replace(upper(trim(p_name || '.' || p_type)), '.', '-'), ' ', '') END AS symbol
FROM part""",
)
def symbol_cleaning(spark, sf):
    raw = F.when(F.col("p_size") % 20 == 0, " nan ").when(F.col("p_size") % 10 == 0, "  ").otherwise(F.concat_ws(".", "p_name", "p_type"))
    return src.table(spark, sf, "part").select(
        "p_partkey", scalars.normalize_code(F.concat(F.lit(" "), "p_name")).alias("code"), scalars.clean_symbol(raw).alias("symbol")
    )


@query(
    "coerced_types",
    """SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS bad_number,
  CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) END AS day, CASE WHEN event_id % 5 <> 0 THEN round(value, 4) + 0.0 END AS finite FROM events""",
)
def coerced_types(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("2024-13-45")).otherwise(F.col("ts").cast("date").cast("string"))
    odd = F.when(F.col("event_id") % 10 == 0, float("inf")).when(F.col("event_id") % 10 == 5, float("nan")).otherwise(F.col("value"))
    out = src.table(spark, sf, "events").select(
        "event_id",
        scalars.to_double(F.regexp_extract("props", "([0-9]+)", 1)).alias("number"),
        scalars.to_double("props").alias("bad_number"),
        scalars.to_date_or_null(text).alias("day"),
        scalars.finite(odd).alias("finite"),
    )
    return rounded(out, 4)


@query(
    "sentinel_and_equality_filters",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' AND o_orderstatus IS NOT NULL AND o_orderpriority = '1-URGENT'",
)
def sentinel_filters(spark, sf):
    orders = src.table(spark, sf, "orders")
    valid = orders.filter(F.col("o_orderstatus").isNotNull() & ~F.col("o_orderstatus").isin("P", "NONE"))
    kept = relational.equal_where_present(valid, {"o_orderpriority": "1-URGENT", "no_such_column": "x"})
    return kept.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "range_filters",
    """SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS month FROM orders WHERE last_day(CAST(o_orderdate AS DATE)) BETWEEN DATE '1996-01-31' AND DATE '1998-06-30'
AND nullif(o_orderkey % 4, 0) IS NOT NULL AND year(o_orderdate) BETWEEN 1995 AND 1997""",
)
def range_filters(spark, sf):
    orders = src.table(spark, sf, "orders").withColumn("month", scalars.month_end("o_orderdate"))
    target = F.nullif(F.col("o_orderkey") % 4, F.lit(0))
    inside = F.col("month").between(F.lit("1996-01-31").cast("date"), F.lit("1998-06-30").cast("date"))
    return orders.filter(inside & target.isNotNull() & F.year("o_orderdate").between(1995, 1997)).select("o_orderkey", "month")


@query(
    "sample_split",
    """WITH s AS (SELECT 'train' AS sample, o_orderdate AS d FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-12-31'
UNION ALL SELECT 'validation', o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-12-31' AND CAST(o_orderdate AS DATE) <= DATE '1999-12-31'
UNION ALL SELECT 'development', o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1999-12-31'
UNION ALL SELECT 'test', o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1999-12-31')
SELECT sample, count(*) AS rows, min(CAST(d AS DATE)) AS first_day, max(CAST(d AS DATE)) AS last_day FROM s GROUP BY sample""",
)
def sample_split(spark, sf):
    orders = src.table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    samples = relational.split_by_time(orders, "day", "1997-12-31", "1999-12-31")
    parts = [
        df.agg(F.lit(name).alias("sample"), F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
        for name, df in samples.items()
    ]
    return relational.union_all(*parts)


@query(
    "drop_first_period",
    """WITH m AS (SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS month FROM orders) SELECT o_orderkey, month FROM m WHERE month > (SELECT min(month) FROM m)""",
)
def drop_first_period(spark, sf):
    m = src.table(spark, sf, "orders").select("o_orderkey", scalars.month_end("o_orderdate").alias("month"))
    return relational.drop_first_period(m, "month")


@query(
    "conditional_nulls",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE round(o_totalprice, 2) + 0.0 END AS o_totalprice,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority, (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END) IS NULL AS any_missing FROM orders""",
)
def conditional_nulls(spark, sf):
    orders = src.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    out = scalars.null_out(orders, F.col("o_orderstatus") == "P", ["o_totalprice", "o_orderpriority"])
    both = out.withColumn("any_missing", scalars.any_null(["o_totalprice", "o_orderpriority"]) & scalars.all_null(["o_totalprice", "o_orderpriority"]))
    return rounded(both.drop("o_orderstatus"), 2)


_PREDICTOR = "CASE WHEN p_size % 5 = 0 THEN 'sic2_' || p_size WHEN p_size % 5 = 1 THEN replace(p_name, ' ', '_') || '_x_wg_dp' WHEN p_size % 5 = 2 THEN 'wg_tbl' WHEN p_size % 5 = 3 THEN 'vix_avg_1m' ELSE replace(p_name, ' ', '_') END"


@query(
    "predictor_families",
    f"""SELECT p_partkey, {_PREDICTOR} AS predictor, CASE p_size % 5 WHEN 0 THEN 'sic2' WHEN 1 THEN 'characteristic_macro_interaction' WHEN 2 THEN 'welch_goyal'
  WHEN 3 THEN 'market_vix' ELSE 'stock_characteristic' END AS predictor_group FROM part""",
)
def predictor_families(spark, sf):
    size, word = F.col("p_size") % 5, F.translate("p_name", " ", "_")
    predictor = (
        F.when(size == 0, F.concat(F.lit("sic2_"), "p_size")).when(size == 1, F.concat(word, F.lit("_x_wg_dp")))
        .when(size == 2, "wg_tbl").when(size == 3, "vix_avg_1m").otherwise(word)
    )
    part = src.table(spark, sf, "part").select("p_partkey", predictor.alias("predictor"))
    return part.withColumn("predictor_group", names.predictor_group("predictor"))


@query(
    "display_names_and_booleans",
    """SELECT o_orderkey, o_orderstatus AS model, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS display_name,
  o_orderkey % 4 IN (0, 2) AS flag FROM orders""",
)
def display_names_and_booleans(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, " TRUE").when(k == 1, "False").when(k == 2, "1").otherwise("yes")
    orders = src.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("model"), scalars.parse_bool(text).alias("flag"))
    return names.add_display_names(orders, names={"F": "Filled", "O": "Open"})


@query("stable_sample", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")
def stable_sample(spark, sf):
    orders = src.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    return relational.stable_sample(orders, ["o_orderkey"], 500).select("o_orderkey", "o_totalprice")


@query(
    "design_matrix",
    """SELECT c_custkey, 3 AS width, round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE), 1) + 0.0 AS first_value, CAST(c_nationkey AS DOUBLE) AS last_value FROM customer""",
)
def design_matrix(spark, sf):
    out = crosssection.as_vector(src.table(spark, sf, "customer"), ["c_acctbal", "c_custkey", "c_nationkey"])
    parts = out.select(
        "c_custkey", F.size("features").alias("width"), F.get("features", F.lit(0)).cast("double").alias("first_value"),
        F.get("features", F.lit(2)).cast("double").alias("last_value"),
    )
    return rounded(parts, 1)


@query(
    "parameter_text",
    """SELECT p_partkey, round(p_size / 100.0, 6) + 0.0 AS alpha, round(p_retailprice, 2) + 0.0 AS l1_ratio FROM part""",
)
def parameter_text(spark, sf):
    text = F.concat(
        F.lit("{'alpha': np.float64("), (F.col("p_size") / 100).cast("string"), F.lit("), 'l1_ratio': "), F.col("p_retailprice").cast("string"), F.lit("}")
    )
    parsed = src.table(spark, sf, "part").select("p_partkey", scalars.parameters_from_text(text).alias("m"))
    return rounded(parsed.select("p_partkey", F.col("m")["alpha"].alias("alpha"), F.col("m")["l1_ratio"].alias("l1_ratio")), 6, l1_ratio=2)


# --- joins -------------------------------------------------------------------------------
@query(
    "period_join",
    with_views(PRICES, RATES) + f"SELECT entity, p.month, {r('ret_1m rate', 8)} FROM prices p LEFT JOIN rates x ON p.month = x.month",
)
def period_join(spark, sf):
    m = src.monthly_prices(spark, sf).select("entity", "month", "ret_1m")
    return rounded(relational.join_period(m, src.rates(spark, sf), "month"), 8)


@query(
    "composite_key_join",
    with_views(PRICES)
    + """, volumes AS (SELECT l_suppkey AS entity, last_day(CAST(l_shipdate AS DATE)) AS month, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)
SELECT entity, month, round(ret_1m, 8) + 0.0 AS ret_1m, round(volume, 2) + 0.0 AS volume FROM prices LEFT JOIN volumes USING (entity, month)""",
)
def composite_key_join(spark, sf):
    m = src.monthly_prices(spark, sf).select("entity", "month", "ret_1m")
    line = src.table(spark, sf, "lineitem")
    volumes = line.groupBy(F.col("l_suppkey").alias("entity"), scalars.month_end("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("volume"))
    return rounded(m.join(volumes, ["entity", "month"], "left"), 8, volume=2)


@query(
    "inner_date_join",
    with_views(BARS, MARKET) + "SELECT entity, date, round(b.adj_close, 6) + 0.0 AS price, round(level, 2) + 0.0 AS level FROM bars b JOIN market m USING (date) WHERE level > 2",
)
def inner_date_join(spark, sf):
    market = src.market(spark, sf).select("date", F.when(F.col("level") > 2, F.col("level")).alias("level"))
    bars = src.bars(spark, sf).select("entity", "date", F.col("adj_close").alias("price"))
    return rounded(bars.join(relational.calendar_side(market, "date"), "date").dropna(), 6, level=2)


@query(
    "anti_join",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)",
)
def anti_join(spark, sf):
    line = src.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    poor = src.table(spark, sf, "supplier").filter(F.col("s_acctbal") < 2000)
    return relational.without_keys(line, poor, ["s_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "semi_join",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def semi_join(spark, sf):
    big = src.table(spark, sf, "orders").filter(F.col("o_totalprice") > 400000).withColumnRenamed("o_custkey", "c_custkey")
    return relational.with_keys(src.table(spark, sf, "customer"), big, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    "lookup_with_default",
    "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey",
)
def lookup_with_default(spark, sf):
    counts = src.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return relational.lookup(src.table(spark, sf, "customer").select("c_custkey"), counts, ["c_custkey"], "n", 0)


@query(
    "validated_join",
    "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def validated_join(spark, sf):
    orders = src.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = src.table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nation = src.table(spark, sf, "nation").select("n_nationkey", "n_name")
    one = relational.join_checked(orders, customer, ["c_custkey"], "inner")
    return relational.join_checked(one, nation, ["n_nationkey"], "inner").select("o_orderkey", "c_name", "n_name")


# --- sets --------------------------------------------------------------------------------
@query(
    "union_by_name",
    "SELECT c_nationkey AS nation, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, s_name, NULL FROM supplier",
)
def union_by_name(spark, sf):
    customer = src.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    supplier = src.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return relational.union_all(customer, supplier)


@query(
    "union_universe",
    "SELECT l_suppkey AS entity FROM lineitem UNION SELECT s_suppkey FROM supplier UNION SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END FROM customer WHERE c_custkey % 2 = 0",
)
def union_universe(spark, sf):
    even = src.table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("k"))
    return relational.union_keys("entity", src.table(spark, sf, "lineitem").select("l_suppkey"), src.table(spark, sf, "supplier").select("s_suppkey"), even)


@query("distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_keys(spark, sf):
    return src.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P'")
def set_difference(spark, sf):
    seen = src.table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").withColumnRenamed("o_custkey", "c_custkey")
    return relational.missing_keys(src.table(spark, sf, "customer"), seen, ["c_custkey"])


@query(
    "set_equality",
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_left, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_right,
  (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) = 0 AND (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) = 0 AS equal""",
)
def set_equality(spark, sf):
    a = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = src.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return relational.same_keys(a, b, ["k"])


# --- sorts and limits -----------------------------------------------------------------------
@query(
    "top_k",
    "SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def top_k(spark, sf):
    orders = src.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25), 2)


@query(
    "sort_by_absolute_value",
    "SELECT c_custkey, round(c_acctbal, 2) + 0.0 AS c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_nationkey, c_custkey",
)
def sort_by_absolute_value(spark, sf):
    customer = src.table(spark, sf, "customer").orderBy(F.abs("c_acctbal").desc(), F.asc("c_nationkey"), F.asc("c_custkey"))
    return rounded(customer.select("c_custkey", "c_acctbal"), 2)


@query(
    "first_and_last",
    """SELECT (SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AS best, (SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1) AS worst""",
)
def first_and_last(spark, sf):
    by = F.struct("c_acctbal", "c_custkey")
    down = F.struct(F.col("c_acctbal"), -F.col("c_custkey"))
    return src.table(spark, sf, "customer").agg(F.max_by("c_name", down).alias("best"), F.min_by("c_name", by).alias("worst"))


@query(
    "month_list",
    """SELECT o_orderpriority, string_agg(m, ', ' ORDER BY m) AS months FROM (SELECT DISTINCT o_orderpriority, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS m FROM orders)
GROUP BY 1""",
)
def month_list(spark, sf):
    """Distinct months as text: the list is bounded by the calendar."""
    orders = src.table(spark, sf, "orders")
    months = orders.select("o_orderpriority", F.date_format(scalars.month_end("o_orderdate"), "yyyy-MM-dd").alias("m")).distinct()
    return months.groupBy("o_orderpriority").agg(F.array_join(F.sort_array(F.collect_list("m")), ", ").alias("months"))


@query(
    "global_counts",
    """SELECT count(*) AS rows, count(DISTINCT l_suppkey) AS entities, count(DISTINCT last_day(CAST(l_shipdate AS DATE))) AS months, min(last_day(CAST(l_shipdate AS DATE))) AS first_month,
  max(last_day(CAST(l_shipdate AS DATE))) AS last_month FROM lineitem""",
)
def global_counts(spark, sf):
    line = src.table(spark, sf, "lineitem").select("l_suppkey", scalars.month_end("l_shipdate").alias("month"))
    return line.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("l_suppkey").alias("entities"), F.countDistinct("month").alias("months"),
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
    )
