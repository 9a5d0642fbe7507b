import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelmill.operators import quality
from panelmill.session import cut_lineage, shared_folder
from panelmill.sources import readers, sinks


def test_entity_files(spark, tmp_path):
    (tmp_path / "aa.csv").write_text("Date,Adj Close\n2020-01-01,1.5\n2020-01-02,x\n")
    (tmp_path / "bb.csv").write_text("Date,Adj Close\n2020-02-01,2.5\n")
    df = readers.read_entity_files(spark, str(tmp_path))
    assert df.columns == ["date", "adj_close", "entity"]
    universe = spark.createDataFrame([("AA",), ("BB",), ("CC",)], "entity string")
    report = {r.entity: r for r in quality.load_report(df, universe, "entity", "date").collect()}
    assert (report["AA"].rows, report["AA"].status, report["CC"].reason) == (2, "downloaded", "no_data")


def test_csv_and_contract(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    sinks.write_report(spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double"), path)
    assert readers.read_csv(spark, path, "k string, v double", ["v"]).columns == ["v"]
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_csv(spark, path, None, ["nope"])
    names = [f"x{i}" for i in range(12)]
    sinks.write_contract(spark, names, str(tmp_path / "c"))
    assert readers.read_contract(spark, str(tmp_path / "c")) == names


def test_panel_sink_prunes_years(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(y, 1, 31), float(y)) for y in (2001, 2002)], "month date, v double")
    sinks.write_panel(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).filter("year = 2002")
    assert back.count() == 1
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()


def test_factor_text(spark, tmp_path):
    text = "header\n,Mkt-RF,SMB,HML,RF\n199001, 1, 2, 3, 0.57\n199002, 1, 2, 3, bad\n\n Annual\n1990, 1, 2, 3, 7.8\n"
    (tmp_path / "f.csv").write_text(text)
    out = readers.parse_factor_lines(spark.read.text(str(tmp_path / "f.csv"))).collect()
    assert [(r.month, round(r.rate, 6)) for r in out] == [(dt.date(1990, 1, 31), 0.0057)]


def test_manifest(spark):
    old = spark.createDataFrame([("b", "s", "2020-01-01", "1990", "1991", ""), ("c", "s", "2020-01-01", "1990", "1991", "")], ", ".join(f"{c} string" for c in sinks.MANIFEST_COLUMNS))
    data = spark.createDataFrame([(dt.date(2000, 1, 31),), (dt.date(2001, 1, 31),)], "month date")
    new = sinks.manifest_row(data, "b", "here", "month", "n")
    out = sinks.update_manifest(old, new).collect()
    assert [(r.file, r.coverage_end) for r in out] == [("b", "2001-01-31"), ("c", "1991")]


def test_guarded_load(spark):
    df = spark.createDataFrame([("m", 1), ("m", 1), ("x", 1)], "model string, k int")
    with pytest.raises(ValueError, match="no rows"):
        readers.load_checked(df, ["k"], model="model", expected=["m", "n"])
    with pytest.raises(ValueError, match="duplicate"):
        readers.load_checked(df, ["k"], ["model", "k"], "model", ["m"])


def test_cut_lineage_uses_the_shared_folder(spark):
    df = cut_lineage(spark.range(10).withColumn("v", F.col("id") * 2))
    assert df.count() == 10 and shared_folder(spark) in df.inputFiles()[0]


def test_load_report_gives_each_entity_its_reason(spark):
    loaded = spark.createDataFrame([("A", dt.date(2020, 1, 1)), ("B", dt.date(2020, 1, 2))], "entity string, date date")
    universe = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "entity string")
    missing = spark.createDataFrame([("B", "volume"), ("D", "open,close")], "entity string, missing_columns string")
    rows = {r.entity: (r.status, r.reason, r.rows) for r in quality.load_report(loaded, universe, "entity", "date", missing).collect()}
    assert rows == {"A": ("downloaded", "", 1), "B": ("failed", "missing_columns:volume", 1), "C": ("failed", "no_data", 0), "D": ("failed", "missing_columns:open,close", 0)}


def test_differing_files_are_written_in_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(40).selectExpr("cast(id % 4 AS int) AS kind", "id % 8 AS entity", "date_add(DATE '2020-01-01', cast(40 - id AS int)) AS date", "IF(id = 39, NULL, id / 2) AS close", "id AS volume")
    kinds = [["date", "close"], ["volume", "date"], ["close", "volume", "date"], ["date", "close", "volume"]]
    sinks.write_differing_csv(rows.mapInArrow(passed, rows.schema), str(tmp_path / "out"), "entity", "date", "kind", kinds)
    assert seen.value == 40
    files = {p.parent.name: p.read_text().splitlines() for p in (tmp_path / "out").glob("kind=*/entity=*/part-*")}
    assert len(files) == 8 and files["entity=1"] == ["volume,date", "33,2020-01-08", "25,2020-01-16", "17,2020-01-24", "9,2020-02-01", "1,2020-02-09"]
    assert [x.replace('""', "") for x in files["entity=7"][:3]] == ["date,close,volume", "2020-01-02,,39", "2020-01-10,15.5,31"]


def test_files_with_differing_columns(spark, tmp_path):
    (tmp_path / "aa.csv").write_text("Date,Adj Close,Volume\n2020-01-01,1.5,10\n2020-01-02,2.5,20\n")
    (tmp_path / "bb.csv").write_text('Volume,"Date",Adj Close,Note\n7,2020-02-01,3.5,"a, b"\n')
    (tmp_path / "cc.csv").write_text("Date,Volume\n2020-03-01,9\n")
    (tmp_path / "dd.csv").write_text("")
    (tmp_path / "ee.csv").write_text("Date,Adj Close,Volume\n")
    required = ["date", "adj_close", "volume"]
    rows, missing = readers.read_differing_files(spark, str(tmp_path), required)
    assert rows.columns == ["entity", *required, "note"]
    got = sorted(map(tuple, rows.collect()))
    assert got == [("AA", "2020-01-01", "1.5", "10", None), ("AA", "2020-01-02", "2.5", "20", None), ("BB", "2020-02-01", "3.5", "7", "a, b")]
    assert [tuple(r) for r in missing.collect()] == [("CC", "adj_close")]
    universe = spark.createDataFrame([(x,) for x in ("AA", "BB", "CC", "DD", "EE")], "entity string")
    report = {r.entity: (r.status, r.reason, r.rows) for r in quality.load_report(rows, universe, "entity", "date", missing).collect()}
    assert report == {"AA": ("downloaded", "", 2), "BB": ("downloaded", "", 1), "CC": ("failed", "missing_columns:adj_close", 0), "DD": ("failed", "no_data", 0), "EE": ("failed", "no_data", 0)}
    kept, _ = readers.read_differing_files(spark, str(tmp_path), required, keep_incomplete=True)
    assert ("CC", "2020-03-01", None, "9", None) in [tuple(r) for r in kept.collect()]
    with pytest.raises(ValueError, match="different headers"):
        readers.read_differing_files(spark, str(tmp_path), required, most_headers=2)


def test_versions_switch_by_pointer(spark, tmp_path):
    path = str(tmp_path / "m")
    assert readers.read_version(spark, path) is None
    first = sinks.write_version(spark.createDataFrame([("a", 1)], "k string, v int"), path)
    old = readers.read_version(spark, path)
    second = sinks.write_version(old.withColumn("v", F.col("v") + 1), path)
    assert (first[:7], second[:7]) == ("v000001", "v000002")
    assert [tuple(r) for r in readers.read_version(spark, path).collect()] == [("a", 2)] and [tuple(r) for r in old.collect()] == [("a", 1)]
    # A run that died before the switch leaves a complete table that nobody names.
    spark.createDataFrame([("x", 9)], "k string, v int").write.parquet(f"{path}/v000003-dead")
    assert [tuple(r) for r in readers.read_version(spark, path).collect()] == [("a", 2)]
    rows = spark.createDataFrame([("f", "s", "2020-01-01", "1990", "1991", "")], ", ".join(f"{c} string" for c in sinks.MANIFEST_COLUMNS))
    for _ in range(2):
        sinks.store_manifest(spark, str(tmp_path / "n"), rows)
    assert readers.read_version(spark, str(tmp_path / "n")).count() == 1
