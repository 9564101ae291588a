"""Every query against its SQL, and the cases that the tables don't hold."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, horizons, performance, pivots, recursive, resample, rolling, rules
from barloom.plans import candles, oracle, queries, tester
from barloom.plans import metrics as tables
from barloom.sources import bars as sources
from barloom.sources import landed, sinks, store, uploads
from barloom.streaming.weekly import weekly_stream

SF = "/root/testdata/sf0.001"


#: Tables with enough days for averages over 200.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    """A connection for each folder."""
    found = {}
    for sf in (SF, LARGER):
        con = found[sf] = duckdb.connect()
        for f in os.listdir(sf):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return found


def comparable(df: pd.DataFrame) -> list[str]:
    def one(v):
        if pd.isna(v):
            return None
        return str(v)[:10] if hasattr(v, "year") else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr([one(v) for v in row]) for row in df[sorted(df.columns)].astype(object).values.tolist())


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == oracle.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    sf = LARGER if name.startswith("live_r") else SF
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck[sf].execute(oracle.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def day(k: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def bars_of(spark, closes, symbol="S"):
    return spark.createDataFrame([(symbol, day(k), c, c, c, c, 1.0) for k, c in enumerate(closes)], "symbol string, ts date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize(("n", "rows"), [(59, 0), (60, 1)])
def test_metrics_need_sixty_bars(spark, n, rows):
    assert tables.symbol_metrics(bars_of(spark, [float(k + 1) for k in range(n)])).count() == rows


def test_constant_close(spark):
    got = recursive.with_recursive(bars_of(spark, [5.0] * 70)).orderBy(F.desc("ts")).first()
    assert got["rsi_screen"] == 100.0 and got["rsi_tester"] is None
    flat = rolling.band_position(bars_of(spark, [5.0] * 60)).first()
    assert flat["BB_Position"] == 0 and flat["BB_Upper"] is None
    curve = spark.createDataFrame([("s", day(k), 1.0) for k in range(5)], "series string, date date, equity double")
    assert performance.headline(curve).first()["sharpe"] is None


def test_plateaus_are_plain_but_not_unique_pivots(spark):
    b = bars_of(spark, [9.0, 8.0, 7.0, 3.0, 3.0, 7.0, 8.0, 9.0, 9.0])
    rows = b.select("ts", pivots.pivot("close", 3, True).alias("plain"), pivots.unique_pivot("close", 3, True).alias("unique")).orderBy("ts").collect()
    assert [r["plain"] for r in rows][3:5] == [True, True] and not any(r["unique"] for r in rows)


def test_weeks_take_weekends_forward_and_drop_an_open_last_week(spark):
    b = bars_of(spark, [float(k) for k in range(14)])  # 2020-01-01 is a Wednesday, 2020-01-14 a Tuesday
    assert [str(r["ts"]) for r in resample.weekly(b).orderBy("ts").collect()] == ["2020-01-03", "2020-01-10"]
    assert resample.weekly(b, resample.PARTIAL).count() == 3
    with pytest.raises(ValueError):
        resample.weekly(b, "other")


def test_missing_high_leaves_wilder_missing_from_there(spark):
    b = bars_of(spark, [float(k % 7 + 1) for k in range(60)]).withColumn("high", F.when(F.col("ts") != F.lit(day(3)), F.col("high")))
    assert not b.select(pivots.pivot("high", 3, False).alias("p")).limit(7).filter("p").count()
    assert horizons.performance(b.withColumn("close", F.when(F.col("ts") == F.lit(day(59 - 7)), 0.0).otherwise(F.col("close")))).first()["Perf_1W_%"] is None


def panel(spark, closes):
    return bars_of(spark, closes).select(F.col("symbol").alias("strategy_id"), F.col("ts").alias("date"), "close", F.col("close").alias("x"), F.lit(7.0).alias("other"))


def rule(test, value):
    return rules.Condition(1, "x", test, value)


def test_backtest_acts_on_the_next_bar(spark):
    run = backtest.simulate(panel(spark, [1.0, 2.0, 4.0, 8.0, 3.0]), backtest.Strategy("close", "close", [rule("<", 1.5)], [rule(">", 7.0)]), backtest.Costs(100.0, 1.0, 0.0))
    done = [(str(r["date"]), r["action"], r["price"]) for r in backtest.trades(run).orderBy("date").collect()]
    assert done == [("2020-01-02", "Buy", 2.0), ("2020-01-05", "Sell", 3.0)]
    shares = 100 / 1.01 / 2
    assert [round(r["equity"], 9) for r in backtest.equity(run).orderBy("date").collect()] == [round(x, 9) for x in (100, shares * 2, shares * 4, shares * 8, shares * 3 * 0.99)]


def test_backtest_invalid_prices_and_other_exit(spark):
    s = backtest.Strategy("close", "close", [rule("=", 1.0)], [rule(">", 7.0)])
    skipped = backtest.simulate(panel(spark, [1.0, -1.0, 2.0]), s)
    assert backtest.trades(skipped).count() == 0 and backtest.warnings(skipped).count() == 1
    carried = backtest.simulate(panel(spark, [1.0, 2.0, 0.0, 4.0]), s, backtest.Costs(10.0))
    assert [r["equity"] for r in backtest.equity(carried).orderBy("date").collect()] == [10.0, 10.0, 10.0, 20.0]
    never = backtest.simulate(panel(spark, [1.0, 2.0, 9.0, 9.0]), backtest.Strategy("close", "other", [rule("=", 1.0)], [rule(">", 7.0)]))
    assert [r["action"] for r in backtest.trades(never).collect()] == ["Buy"]
    idle = backtest.simulate(panel(spark, [1.0, 2.0]), backtest.Strategy("close", "close", [], []))
    assert backtest.trades(idle).count() == 0 and "gross_value" in backtest.trades(idle).columns


def test_backtest_checks_its_input(spark):
    for bad in ({"deposit": 0.0}, {"commission_pct": -1.0}):
        with pytest.raises(ValueError):
            backtest.Costs(**bad)
    with pytest.raises(ValueError):
        backtest.simulate(panel(spark, [1.0]), backtest.Strategy("close", "missing", [], []))
    with pytest.raises(ValueError):
        rules.Condition(1, "x", "!=", 1.0)


def test_benchmark_without_a_first_price(spark):
    prices = spark.createDataFrame([("b", day(0), None), ("b", day(1), 2.0)], "series string, date date, price double")
    with pytest.raises(Exception, match="no valid first price"):
        backtest.benchmark_curve(prices, 10.0).collect()


def test_uploads(spark, tmp_path):
    path = tmp_path / "own.csv"
    path.write_text("day;px;note\n2020-01-02; 1,200 ;a\n03/02/2020;5%;b\n2020-01-02;null;c\nbroken;1;2;3\n")
    df, counts = uploads.read_upload(spark, str(path))
    assert df.columns == ["day", "px", "note"] and df.count() == 3
    assert counts.get["left_out"] == 1 and counts.get["lines"] == 4
    df, _ = uploads.read_upload(spark, str(path))
    shares = {r["column"]: r for r in uploads.profile(df).collect()}
    assert shares["day"]["date_share"] == 1.0 and shares["note"]["number_share"] == 0.0
    assert sorted((r["px"] for r in uploads.numeric(df, ["px"])[0].collect()), key=str) == [1200.0, 5.0, None]
    series = uploads.time_series(df.withColumn("n", F.monotonically_increasing_id()), "day", "n")
    assert sorted(str(r["date"])[:10] for r in series.collect()) == ["2020-01-02", "2020-02-03"]
    for bad in ("", "own.txt"):
        with pytest.raises(ValueError):
            uploads.read_upload(spark, bad)


def test_saved_strategy_rows(spark, tmp_path):
    path = tmp_path / "saved.json"
    path.write_text('{"mine": {"full_input_table": {"columns": ["a"], "data": []}, "underlying_inputs": {"columns": ["a"], "data": [{"a": "1"}, {"a": "2"}]}}}')
    assert sorted(r["row"]["a"] for r in uploads.saved_rows(spark, str(path), None, "(None)", "gone", "mine").collect()) == ["1", "2"]


def test_normalised_bars(spark):
    raw = spark.createDataFrame([(" abc ", dt.date(2020, 1, 1), 1.0, float("nan")), ("abc", dt.date(2020, 1, 2), None, 2.0)], "Symbol string, TS date, Close double, High double")
    row = sources.normalised(raw).collect()
    assert len(row) == 1 and row[0]["symbol"] == "ABC" and row[0]["high"] is None and row[0]["volume"] is None


def test_charts_need_twenty_candles(spark):
    assert candles.candles(bars_of(spark, [1.0] * 19)).count() == 0
    assert candles.candles(bars_of(spark, [1.0] * 200)).count() == 150
    assert candles.candles(bars_of(spark, [1.0] * 200), visible=0).count() == 200


def test_weekly_stream(spark, tmp_path):
    rows = [("S", dt.datetime(2020, 1, d, 12), float(d), 1.0) for d in range(1, 12)]
    path = str(tmp_path / "prices")
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double").write.parquet(path)
    stream = weekly_stream(spark.readStream.schema("symbol string, ts timestamp, price double, volume double").parquet(path))
    query = stream.writeStream.format("memory").queryName("weeks").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {str(r["label"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.table("weeks").collect()}
    assert got == {"2020-01-03": (1.0, 3.0, 1.0, 3.0, 3.0), "2020-01-10": (4.0, 10.0, 4.0, 10.0, 7.0), "2020-01-17": (11.0, 11.0, 11.0, 11.0, 1.0)}


def test_filters_reach_the_scan_and_windows_do_not_leave_the_jvm(spark):
    plan = queries.QUERIES["rolling_values"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan


def test_whole_backtests_and_benchmarks_leave_no_bars_out(spark):
    bars = sources.bars_orders(spark, SF)
    assert queries.QUERIES["backtest_equity_whole"](spark, SF).count() == queries.base(spark, SF).count()
    low = {r["ts"] for r in bars.filter("symbol = '5-LOW'").collect()}
    assert all((r["BMK_LOW_Close"] is not None) == (r["date"] in low) for r in queries.QUERIES["joined_dataset_whole"](spark, SF).collect())


def test_joined_keeps_days_that_a_benchmark_lacks(spark):
    own = lambda days: bars_of(spark, [1.0] * 4).filter(F.col("ts").isin([day(k) for k in days])).select(F.col("ts").alias("date"), "open", "high", "low", "close")
    got = {r["date"]: r["BMK_B_Close"] for r in uploads.joined(own([0, 1, 2]), own([1, 2, 3]), {"B": own([2, 3])}).collect()}
    assert got == {day(1): None, day(2): 1.0}


def test_metrics_are_one_grouped_pass_and_three_exchanges(spark):
    df = queries.QUERIES["metrics_table"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    assert final.count("FlatMapGroupsInPandas") == 1
    # bars by symbol and day, by symbol, and by symbol after the grouped pass
    assert final.count("Exchange hashpartitioning(symbol") <= 3 and final.count("orders.parquet") <= 1


def test_live_dataset_errors_and_skips(spark):
    own = bars_of(spark, [float(k % 9 + 1) for k in range(230)], "U").unionByName(bars_of(spark, [2.0] * 230, "T")).unionByName(bars_of(spark, [2.0], "B"))
    df, warned = tester.live_dataset(own, "U", "T", ["B", "NONE"])
    assert warned == ["Benchmark without data left out: NONE"] and "BMK_B_Close" in df.columns and df.count() == 230
    assert tester.ready_part(df).count() == 31
    with pytest.raises(ValueError):
        tester.live_dataset(own, "U", "NONE")
    with pytest.raises(ValueError):
        tester.live_dataset(own, "U", "T", timeframe="hourly")
    with pytest.raises(Exception, match="too little history"):
        tester.ready_part(df.filter("date < '2020-03-01'")).collect()
    assert str(tester.auto_start(own, "U", "T", "2020-02-01").first()["start"]) == "2015-02-01"
    assert str(tester.auto_start(own, "U", "T", "2020-12-31").first()["start"]) == str(day(199))


def test_a_window_needs_rows(spark):
    with pytest.raises(ValueError):
        sources.between(bars_of(spark, [1.0, 2.0]), "2020-01-02", least=2)
    assert sources.between(bars_of(spark, [1.0, 2.0]), "2020-01-01", least=2).count() == 2


def test_strategy_store(tmp_path):
    path = str(tmp_path / "store.json")
    assert store.load(path) == {} and not store.delete(path, "a")
    store.put(path, " a ", {"configuration": {"enter_ticker": "X", "benchmarks": ["Y", "gone", "X", "Y", "X"], "enter_rows": [{"variable": "gone", "condition": "?", "input_value": None, "use": False}], "settings": {"risk_free": "1.5"}}})
    store.put(path, "b", {})
    form = store.form(store.load(path)["a"], ["Y", "X"])
    assert (form["enter_ticker"], form["exit_ticker"], form["benchmarks"]) == ("X", "X", ["Y", "X", "Y"])
    assert form["enter_rows"][0] == {"use": False, "row_id": 1, "variable": "Y", "ticker_source": "Underlying", "condition": "=", "input_value": 0.0, "start_date": None, "end_date": None}
    assert [r["use"] for r in form["exit_rows"]] == [True] + [False] * 4 and form["settings"]["risk_free"] == 1.5
    assert store.delete(path, "a") and list(store.load(path)) == ["b"]
    (tmp_path / "store.json").write_text("no json")
    assert store.load(path) == {}
    with pytest.raises(ValueError):
        store.put(path, " ", {})


def test_exports(spark, tmp_path):
    curves = spark.createDataFrame([("A", day(0), 1.005), ("B", day(0), 2.675), ("A", day(1), None)], "series string, date date, equity double")
    with sinks.kept(curves) as held:
        sinks.write_equity(held, ["A", "B"], str(tmp_path / "equity"))
    assert not curves.is_cached
    text = "".join(p.read_text() for p in sorted((tmp_path / "equity").glob("part-*")))
    assert text.splitlines()[:2] == ["date,A,B", "2020-01-01,1.0,2.68"]
    assert [r["equity"] for r in sinks.display_text(curves).collect()] == ["1.00", "2.68", ""]


def test_landed_bars(spark, tmp_path):
    for symbol in ("A", "B"):
        bars_of(spark, [1.0, 2.0, 3.0], symbol).drop("volume").toPandas().to_parquet(tmp_path / f"{symbol}.parquet")
    spark.dataSource.register(landed.LandedBars)
    df = spark.read.format("landed_bars").options(path=f"{tmp_path}/{{symbol}}.parquet", symbols="A, B, NONE", start="2020-01-02").load()
    assert sorted((r["symbol"], r["close"], r["volume"]) for r in df.collect()) == [("A", 2.0, None), ("A", 3.0, None), ("B", 2.0, None), ("B", 3.0, None)]


def test_variables_resolve_to_columns():
    assert rules.resolved("RSI", "Traded") == "RSI" and rules.resolved("Close", "Traded") == "Traded_Close"
    with pytest.raises(ValueError):
        rules.resolved("Close", "Other")
