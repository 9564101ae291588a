"""Sources and sinks: pushed filters, counts beside a scan, kept results, the one-file report, workbooks, saved documents, refreshed metrics."""

from __future__ import annotations

import datetime as dt
import json
import os
import zipfile

import pyarrow.dataset
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import clamp
from barloom.operators import backtest
from barloom.sources import landed, report, results, uploads, workbook
from barloom.streaming import refresh

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def bars(spark, symbols, n, first=0):
    return spark.createDataFrame([(s, day(k), 1.0, 2.0, 0.5, float(k), 1.0) for s in symbols for k in range(first, first + n)], landed.SCHEMA)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# landed bars


def test_filters_go_down_to_landed_files(spark, tmp_path):
    landed.land(bars(spark, "ABC", 30), str(tmp_path), "max")
    df = landed.landed(spark, str(tmp_path), "ABC", "symbol string, ts date, close double").filter(F.col("ts").between(day(5), day(7)) & (F.col("symbol") != "C") & (F.col("close") > 5))
    plan = plan_of(df)
    assert "ts" in plan.split("Filter")[0] or "ts" not in plan.split("Filter", 1)[1].split("\n")[0]  # Spark's own filter doesn't look at days again
    assert sorted((r["symbol"], r["close"]) for r in df.collect()) == [(s, c) for s in "AB" for c in (6.0, 7.0)]


def test_pushed_limits(spark):
    reader = landed.LandedReader({"path": "x", "symbols": "A,B,C", "start": "2020-01-03"}, spark.createDataFrame([], landed.SCHEMA).schema)
    left = list(reader.pushFilters([landed.GreaterThan(("ts",), day(4)), landed.LessThanOrEqual(("ts",), day(9)), landed.LessThan(("ts",), day(9)), landed.In(("symbol",), ("C", "A", "Z")), landed.EqualTo(("close",), 1.0)]))
    assert left == [landed.EqualTo(("close",), 1.0)]
    assert [(p.symbol, p.start, p.end) for p in reader.partitions()] == [("A", day(5), day(8)), ("C", day(5), day(8))]


def test_a_read_that_fails_twice(spark, tmp_path, monkeypatch):
    landed.land(bars(spark, "A", 3), str(tmp_path), "10y")
    real, calls = pyarrow.dataset.dataset, []

    def failing(*args, **kwargs):
        calls.append(args)
        if len(calls) % 3:
            raise OSError("not now")
        return real(*args, **kwargs)

    monkeypatch.setattr(pyarrow.dataset, "dataset", failing)
    monkeypatch.setattr(landed, "WAIT", 0.001)
    reader = landed.LandedReader({"path": f"{tmp_path}/{{period}}/{{kind}}/symbol={{symbol}}", "symbols": "A", "periods": "10y"}, spark.createDataFrame([], landed.SCHEMA).schema)
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 3 and len(calls) == 3
    calls.clear()
    real = lambda *args, **kwargs: failing(*args)
    with pytest.raises(OSError, match="not now"):
        list(reader.read(part))


def test_periods_kinds_and_missing_columns(spark, tmp_path):
    landed.land(bars(spark, "A", 2), str(tmp_path), "10y")
    landed.land(bars(spark, "AB", 5).drop("volume"), str(tmp_path), "max")
    landed.land(bars(spark, "A", 1).withColumn("close", F.lit(9.0)), str(tmp_path), "max", adjusted=False)
    count = lambda **o: {r["symbol"]: r["count"] for r in landed.landed(spark, str(tmp_path), ["A", "B", "NONE"], **o).groupBy("symbol").count().collect()}
    assert count() == {"A": 2, "B": 5} and count(periods=["max"]) == {"A": 5, "B": 5} and count(adjusted=False) == {"A": 1}
    assert landed.landed(spark, str(tmp_path), ["B"]).first()["volume"] is None


# uploads


def upload(tmp_path, text):
    path = tmp_path / "own.csv"
    path.write_text(text)
    return str(path)


def test_counts_come_from_one_scan(spark, tmp_path):
    path = upload(tmp_path, 'day,px,key\n2020-01-02,"1,200",1\n2020-01-02,abc,2\n2020-01-03,null,3\n2020-01-04,5%,4\nbroken,1,2,3\n2020-01-05,7\n')
    df, read = uploads.read_upload(spark, path)
    series, counts = uploads.numeric_series(df, "day", "key", ["px"])
    assert plan_of(series).count("Scan csv") == 1
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "one pass")
    assert sorted(str(r["date"])[:10] for r in series.collect()) == ["2020-01-02", "2020-01-03", "2020-01-04"]
    jobs = len(tracker.getJobIdsForGroup("counted"))
    assert read.get["lines"] == 6 and read.get["left_out"] == 2 and counts.lost() == {"px": 1} and counts.repeated() == 1
    assert len(tracker.getJobIdsForGroup("counted")) == jobs  # counts cost no job
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(ValueError, match="not a numeric column: px"):
        counts.check()
    assert not series.is_cached and not df.is_cached


def test_an_upload_without_rows(spark, tmp_path):
    df, read = uploads.read_upload(spark, upload(tmp_path, "day,px,key\n"))
    series, counts = uploads.numeric_series(df, "day", "key", ["px"])
    assert series.collect() == [] and read.get["lines"] == 0 and counts.repeated() == 0
    with pytest.raises(ValueError):
        counts.check()


def test_saved_documents(spark, tmp_path):
    docs = {"full": {"full_input_table": {"data": [{"a": 1, "b": "x"}, {"c": None, "a": 2.5}]}, "underlying_inputs": {"data": [{"z": 1}]}}, "under": {"full_input_table": {"data": []}, "underlying_inputs": {"data": [{"z": True}]}}, "none": {}}
    rows = spark.createDataFrame([(n, json.dumps(d)) for n, d in docs.items()] + [("broken", "{"), ("null", None)], "name string, document string")
    got = sorted((r["name"], r["row"], sorted(r["values"].items(), key=str)) for r in uploads.saved_tables(rows).collect())
    assert got == [("full", 0, [("a", "1"), ("b", "x")]), ("full", 1, [("a", "2.5"), ("c", None)]), ("under", 0, [("z", "true")])]
    path = tmp_path / "store.json"
    path.write_text(json.dumps(docs))
    read = lambda *names: [r["row"] for r in uploads.saved_rows(spark, str(path), *names).collect()]
    assert read("gone", "under", "full") == [{"z": "true"}] and len(read(None, "(None)", "full")) == 2
    for names in (("gone",), ("none",), ()):
        with pytest.raises(Exception, match="saved strategy"):
            read(*names)


# kept results


def test_kept_results_cost_no_job(spark, tmp_path):
    clock, made = [1000.0], []

    def make(n, **_):
        made.append(n)
        return spark.range(n).withColumn("x", F.lit(n).cast("string"))

    def jobs(f):
        name = f"g{len(made)}-{clock[0]}-{os.urandom(4).hex()}"
        spark.sparkContext.setJobGroup(name, name)
        f()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    kept = results.Results(spark, 600, str(tmp_path / "kept"), lambda: clock[0])
    assert jobs(lambda: kept.get("q", make, n=3)) > 0 and made == [3]
    clock[0] += 599
    assert jobs(lambda: kept.get("q", make, n=3)) == 0 and made == [3]  # a hit
    assert sorted(map(tuple, kept.get("q", make, n=3).collect())) == [(0, "3"), (1, "3"), (2, "3")]
    kept.get("q", make, n=4)  # other arguments
    assert made == [3, 4]
    clock[0] += 2
    assert jobs(lambda: kept.get("q", make, n=3)) > 0 and made == [3, 4, 3]  # too old
    assert len(os.listdir(tmp_path / "kept" / "q")) == 2 and all(len(os.listdir(tmp_path / "kept" / "q" / d)) == 1 for d in os.listdir(tmp_path / "kept" / "q"))
    other = results.Results(spark, 600, str(tmp_path / "kept"), lambda: clock[0])
    other.get("q", make, n=3)
    assert made == [3, 4, 3]  # another driver finds it
    kept.clear("q")
    kept.get("q", make, n=3)
    assert made == [3, 4, 3, 3]
    kept.clear()
    assert not (tmp_path / "kept").exists()


# report


def tables(spark):
    headline = spark.createDataFrame([("Strategy", 1.005, None), ('a "b", c', 2.675, -3.0)], "Series string, cagr double, dd double")
    yearly = spark.createDataFrame([("Strategy", 2021, 2.0), ("Strategy", 2020, -1.5)], "series string, year int, performance double")
    trades = spark.createDataFrame([(day(3), "Sell", 4.0), (day(1), "Buy", 3.14159)], "date date, action string, price double")
    return headline, yearly, trades


REPORT = '''Series,cagr,dd
Strategy,1.00,
"a ""b"", c",2.68,-3.00

Yearly Results (Strategy)
series,year,performance
Strategy,2020,-1.50
Strategy,2021,2.00
'''
TRADES = '''
Executed Transactions
date,action,price
2020-01-02,Buy,3.14
2020-01-04,Sell,4.00
'''


def test_report_is_one_file(spark, tmp_path):
    headline, yearly, trades = tables(spark)
    path = tmp_path / "out" / "report.csv"
    path.parent.mkdir()
    report.write_report(headline, yearly, trades, str(path))
    assert path.read_text() == REPORT + TRADES and os.listdir(path.parent) == ["report.csv"]
    report.write_report(headline, yearly, trades.limit(0), str(path))  # in place of the other
    assert path.read_text() == REPORT


def test_a_failing_task_leaves_no_report(spark, tmp_path):
    headline, yearly, trades = tables(spark)
    bad = trades.withColumn("price", F.when(F.col("price") < 4, F.col("price")).otherwise(F.raise_error(F.lit("no such price")).cast("double")))
    with pytest.raises(Exception, match="no such price"):
        report.write_report(headline, yearly, bad, str(tmp_path / "report.csv"))
    assert os.listdir(tmp_path) == []


# workbooks

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def made_workbook(path, rows=0):
    cells = [
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>note</t></is></c></row>',
        '<row r="2"><c r="A2" s="1"><v>43831</v></c><c r="B2"><v>1.5</v></c><c r="D2" t="s"><v>2</v></c></row>',
        '<row r="3"><c r="A3" s="2"><v>43832.5</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="str"><f>1+1</f><v>two</v></c></row>',
        '<row r="5"><c r="B5" t="e"><v>#N/A</v></c><c r="D5" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>',
        *(f'<row r="{k}"><c r="B{k}"><v>{k}</v></c></row>' for k in range(6, 6 + rows)),
    ]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>day</t></si><si><t>px</t></si><si><r><t>rich</t></r><r><t> text</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="165" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="166" formatCode="&quot;d&quot;0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><cols/><sheetData>{"".join(cells)}</sheetData></worksheet>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c t="inlineStr"><is><t>x</t></is></c><c t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c s="3"><v>7</v></c><c><v>8</v></c></row></sheetData></worksheet>')
    return str(path)


def test_workbook(spark, tmp_path):
    path = made_workbook(tmp_path / "own.xlsx")
    df, counts = uploads.read_upload(spark, path)
    assert df.columns == ["day", "px", "column_3", "note"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("2020-01-01", "1.5", None, "rich text"), ("2020-01-02 12:00:00", None, "TRUE", "two"), (None, None, None, "ab")], key=str)
    assert counts.get["lines"] == 3
    other = workbook.read_workbook(spark, path, "Two")
    assert other.columns == ["x", "column_2"] and [tuple(r) for r in other.collect()] == [("7", "8")]
    with pytest.raises(Exception, match="no such sheet"):
        workbook.read_workbook(spark, path, "Three")


def test_workbook_in_ranges_of_rows(spark, tmp_path):
    path = made_workbook(tmp_path / "long.xlsx", 5000)
    df = workbook.read_workbook(spark, path, rows=700)
    assert df.rdd.getNumPartitions() == 8
    assert sorted(int(r["px"]) for r in df.select("px").filter("px RLIKE '^[0-9]+$'").collect()) == list(range(6, 5006))


# refresh


def test_refresh_leaves_other_symbols_alone(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("bars", "history", "metrics", "stream")]
    bars(spark, "AB", 90).write.parquet(paths[0])
    refresh.refreshed(spark, *paths)
    files = lambda s: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "metrics" / f"of={s}").glob("part-*")}
    a, b = files("A"), files("B")
    assert a and b
    bars(spark, "B", 5, 90).write.mode("append").parquet(paths[0])
    refresh.refreshed(spark, *paths)
    assert files("A") == a and files("B") != b
    from barloom.plans.metrics import symbol_metrics

    whole = symbol_metrics(bars(spark, "A", 90).unionByName(bars(spark, "B", 95)))
    key = lambda df: sorted((tuple(r[c] for c in whole.columns) for r in df.collect()), key=str)
    assert key(refresh.read(spark, paths[2])) == key(whole)
    before = key(refresh.read(spark, paths[2]))
    refresh.take(bars(spark, "B", 5, 90), 1, paths[1], paths[2])  # the same batch again
    assert key(refresh.read(spark, paths[2])) == before


def test_an_empty_panel_is_an_error(spark):
    panel = spark.createDataFrame([], "strategy_id string, date date, close double")
    with pytest.raises(ValueError, match="no rows"):
        backtest.checked(panel)
    assert backtest.checked(panel.unionByName(spark.createDataFrame([("s", DAY, 1.0)], panel.schema))).count() == 1


def test_clamp(spark):
    assert [r[0] for r in spark.createDataFrame([(-5.0,), (0.5,), (9.0,)], "x double").select(clamp(F.col("x"), 0, 1)).collect()] == [0.0, 0.5, 1.0]


def test_rules_of_a_run_are_checked():
    from barloom.operators.rules import Condition
    from barloom.plans import tester

    good = Condition(1, "ROC", ">", 1.0)
    tester.checked_rules(backtest.Strategy("a", "a", [good], [Condition(2, "RSI", "bear divergence")]))
    for enter, leave in (([], [good]), ([good], []), ([Condition(1, "ROC", ">", 1.0, "2020-02-01", "2020-01-01")], [good]), ([good], [Condition(1, "Traded_Close", "bull divergence")])):
        with pytest.raises(ValueError):
            tester.checked_rules(backtest.Strategy("a", "a", enter, leave))


def test_a_start_that_moves_is_told(spark):
    from barloom.operators.rules import Condition
    from barloom.plans import tester

    data = spark.createDataFrame([(day(k), None if k < 3 else 1.0, 1.0) for k in range(6)], "date date, ROC double, close double")
    told = lambda variable, start=None: tester.moved_start(data, backtest.Strategy("close", "close", [Condition(1, variable, ">", 1.0)], [Condition(1, "close", ">", 1.0)]), start).first()[0]
    assert told("ROC") == "The run starts on 2020-01-04, when its indicators have values."
    assert told("close") is None and told("ROC", "2020-01-05") is None and "2020-01-04" in told("ROC", "2020-01-02")


def test_a_live_dataset_scans_bars_once(spark):
    from barloom.plans import tester

    rows = spark.createDataFrame([(s, day(k), 1.0, 1.0, 1.0, float(k % 7 + 1), 1.0) for s in "UTB" for k in range(210)], landed.SCHEMA)
    pair = tester.side_by_side(rows, "U", "T", ["B"])
    assert plan_of(pair).count("Scan ") == 1
    dataset, _ = tester.live_dataset(rows, "U", "T", ["B"])
    assert "ExistingRDD" not in plan_of(dataset) and plan_of(dataset).count("Scan parquet") == 1
    same, _ = tester.live_dataset(rows, "U", "U")
    assert same.filter("Underlying_Close <> Traded_Close").count() == 0 and same.count() == 210


def test_chart_numbers(spark):
    from barloom.operators import screen

    rows = spark.createDataFrame([("L", "A", "g", "s", "1.5", 1), ("L", "B", "g", "s", "n/a", 2), ("L", "C", "g", "s", "inf", 3), ("M", "D", "g", "s", None, 4)], "List string, Ticker string, Group string, Subgroup string, m string, ord int")
    frame = screen.chart_frame(rows, numeric=["m", "gone"])
    assert sorted((r["Ticker"], r["Order"], r["m"]) for r in frame.collect()) == [("A", 0, 1.5), ("B", 1, None), ("C", 2, None), ("D", 0, None)]
    assert [(r["TickerAxis"], r["m"]) for r in screen.chart_bars(frame, "m").collect()] == [("A (s)", 1.5)]


def test_a_saved_universe_is_read_back(spark, tmp_path):
    from barloom.operators import universe

    lists = {"Liste": {"Ä": {"one": ["AAA", "BBB"], "two": ["CCC"]}}, "other": {"g": {"s": []}}}
    path = tmp_path / "lists.json"
    universe.save(lists, str(path))
    assert json.loads(path.read_text(encoding="utf-8")) == lists
    got = universe.flattened(universe.from_mapping(spark, json.loads(path.read_text(encoding="utf-8")))).collect()
    assert sorted((r["list"], r["group"], r["subgroup"], r["ticker"]) for r in got) == [("Liste", "Ä", "one", "AAA"), ("Liste", "Ä", "one", "BBB"), ("Liste", "Ä", "two", "CCC")]


def test_parted_changes(spark):
    from barloom.operators import pivots

    rows = [(-2.0, 3.0, "bull"), (2.0, -3.0, "bear"), (2.0, 3.0, "nothing"), (-2.0, 0.5, "nothing"), (-1.0, 3.0, "nothing"), (0.0, 0.0, "nothing"), (None, 1.0, None), (1.0, None, None)]
    got = spark.createDataFrame(rows, "p double, i double, want string").withColumn("got", pivots.parted("p", "i", 1.0))
    assert got.filter("NOT got <=> want").count() == 0
