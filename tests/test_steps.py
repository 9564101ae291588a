"""Recursions in pieces: as state of a stream, by chunks of a symbol, and all strategies in one run."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, recursive, rules, stepwise, strategies
from barloom.sources import store
from barloom.streaming import recursive as stream

DAY = dt.date(2020, 1, 1)


def pieces(rng, x):
    return np.split(x, sorted(rng.integers(0, len(x) + 1, int(rng.integers(0, 5)))))


def series(rng, gaps=0.0):
    x = rng.normal(100, 10, int(rng.integers(1, 120)))
    x[rng.random(len(x)) < gaps] = np.nan
    return x


@pytest.mark.parametrize("gaps", [0.0, 0.2, 0.7, 1.0])
@pytest.mark.parametrize("name", ["ewm", "warm", "wilder"])
def test_steps_in_pieces_and_past_chunks(name, gaps):
    rng = np.random.default_rng(5)
    make, want = {
        "ewm": (lambda: stepwise.Ewm(1 / 14), lambda x: pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean()),
        "warm": (lambda: stepwise.Ewm(2 / 13, 5), lambda x: pd.Series(x).ewm(span=12, adjust=False, min_periods=5).mean()),
        "wilder": (lambda: stepwise.Wilder(14), lambda x: recursive.wilder(x, 14)),
    }[name]
    for _ in range(80):
        x = series(rng, gaps)
        taken, passed, apart = make(), make(), []
        some = pieces(rng, x)
        got = np.concatenate([taken.take(p) for p in some])
        for p in some:
            alone = make()
            alone.held = list(passed.held)
            apart.append(alone.take(p))
            passed.skip(np.asarray(passed.chunk(p), float))
        assert np.allclose(got, want(x), equal_nan=True, rtol=1e-12)
        assert np.allclose(np.concatenate(apart), want(x), equal_nan=True, rtol=1e-9)


def test_indicators_in_pieces():
    rng = np.random.default_rng(6)
    for t in range(40):
        n = int(rng.integers(1, 150))
        close = pd.Series(100 + np.cumsum(rng.normal(size=n)))
        high, low = close + rng.random(n), close - rng.random(n)
        if t % 4 == 0:
            close[:] = high[:] = low[:] = 5.0
        if t % 3 == 0 and n > 20:
            close[int(rng.integers(n))] = np.nan
        own, out = stepwise.Indicators(), []
        cuts = sorted({0, n, *rng.integers(1, n + 1, 3).tolist()})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            restored = stepwise.Indicators()
            restored.restore(own.held())
            out.append(restored.take(*(x[a:b].to_numpy() for x in (high, low, close))))
            own = restored
        adx, plus, minus = recursive.directional(high.to_numpy(), low.to_numpy(), close.to_numpy())
        want = {
            "ewm12": close.ewm(span=12, adjust=False).mean(), "wilder14": recursive.wilder(close.to_numpy(), 14), "rsi_screen": recursive.rsi_screen(close), "rsi_tester": recursive.rsi_tester(close),
            "macd_screen": recursive.macd_histogram(close), "macd_tester": recursive.macd_histogram(close, warm=False), "adx": adx, "di_plus": plus, "di_minus": minus,
        }
        for name, values in want.items():
            assert np.allclose(np.concatenate([o[name] for o in out]), np.asarray(values, float), equal_nan=True, rtol=1e-9, atol=1e-9), name


def test_chunks_of_one_hot_symbol(spark):
    """A symbol's chunks are tasks of their own; gaps, empty chunks and a symbol shorter than the seed."""
    rng = np.random.default_rng(7)
    rows = [("HOT", dt.datetime(2020, 1, 1) + dt.timedelta(hours=int(h)), None if rng.random() < 0.3 else float(rng.normal(50, 5))) for h in range(900) if not 200 < h < 400]
    rows += [("SHORT", dt.datetime(2020, 1, 1), 1.0), ("NONE", dt.datetime(2020, 1, 2), None)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, v double").repartition(5)
    got = stepwise.by_chunks(bars, F.to_date("ts"), {"e": ("v", lambda: stepwise.Ewm(2 / 13, 3)), "w": ("v", lambda: stepwise.Wilder(14))})
    assert got.columns == ["symbol", "ts", "v", "e", "w"]
    frame = got.toPandas().sort_values(["symbol", "ts"])
    assert len(frame) == len(rows)
    for _, own in frame.groupby("symbol"):
        v = own["v"].astype(float)
        assert np.allclose(own["e"].astype(float), v.ewm(span=12, adjust=False, min_periods=3).mean(), equal_nan=True)
        assert np.allclose(own["w"].astype(float), recursive.wilder(v.to_numpy(), 14), equal_nan=True)
    assert stepwise.by_chunks(bars.limit(0), F.to_date("ts"), {"e": ("v", lambda: stepwise.Ewm(0.5))}).collect() == []


def daily(spark, rows):
    return spark.createDataFrame(rows, stream.BARS)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Three calls are three streams over one checkpoint; late and repeated bars are left out; only new files are read."""
    rng = np.random.default_rng(8)
    price = np.cumsum(rng.normal(size=90)) + 100
    bar = lambda s, i: (s, DAY + dt.timedelta(days=i), float(price[i]), float(price[i] + 1), float(price[i] - 1), float(price[i]), 1.0)
    folders = [str(tmp_path / n) for n in ("bars", "out", "checkpoint")]
    for some in ([bar(s, i) for s in "AB" for i in range(40)], [bar("A", i) for i in range(35, 70)], [bar("A", 70), bar("B", 40), bar("B", 40), bar("C", 0), (None, DAY, 1.0, 1.0, 1.0, 1.0, 1.0)]):
        daily(spark, some).repartition(3).write.mode("append").parquet(folders[0])
        stream.refreshed(spark, *folders)
    got = spark.read.parquet(folders[1])
    whole = daily(spark, [bar("A", i) for i in range(71)] + [bar("B", i) for i in range(41)] + [bar("C", 0)])
    want = recursive.with_recursive(whole).select("symbol", "ts", *recursive.COLUMNS)
    key = lambda df: {(r["symbol"], r["ts"]): [None if x is None else round(x, 9) for x in r[2:]] for r in df.collect()}
    assert got.count() == 71 + 41 + 1 and key(got.select(want.columns)) == key(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stream.STORE


def documents(spark, **named):
    return spark.createDataFrame([(n, json.dumps(d) if isinstance(d, dict) else d) for n, d in named.items()], "strategy_id string, strategy string")


def strategy(enter, leave, **more):
    return {"configuration": {"live_traded": "A", "enter_rows": enter, "exit_rows": leave, **more}}


def configured(docs):
    low, high = (F.lit(x).cast("date") for x in ("2020-01-01", "2021-12-31"))
    return store.configured(docs, low, high, ["close", "x"]).withColumnRenamed("live_traded", "instrument")


def test_rules_as_data(spark):
    many = [{"use": True, "variable": "x", "condition": "<=", "input_value": "3"}] * 7
    docs = documents(spark, a=strategy([{"variable": "gone", "condition": "?", "input_value": None, "start_date": "soon", "end_date": "2035-01-01"}, {"variable": "x"}], many), b="no json", c={}, d=None)
    got = {r["strategy_id"]: r for r in configured(docs).collect()}
    assert [r.asDict() for r in got["a"]["enter"]] == [{"use": True, "row_id": 1, "variable": "close", "condition": "=", "value": 0.0, "start": DAY, "end": dt.date(2021, 12, 31)}]
    assert [(r["row_id"], r["value"]) for r in got["a"]["exit"]] == [(k, 3.0) for k in range(1, 6)]
    for name in "bcd":
        assert got[name]["enter"] == got[name]["exit"] == [] and got[name]["initial_deposit"] == 10_000.0
    assert got["b"]["start"] == DAY


def test_problems_are_told(spark):
    rule, bull = {"variable": "x", "condition": ">"}, {"variable": "close", "condition": "bull divergence"}
    docs = documents(
        spark, sound=strategy([rule], [rule]), no_enter=strategy([], [rule]), no_exit=strategy([rule], [rule | {"use": False}]), dates=strategy([rule | {"start_date": "2021-02-01", "end_date": "2021-01-01"}], [rule]),
        diverging=strategy([bull], [rule]), late=strategy([rule], [rule], global_start_date="2021-02-01", global_end_date="2021-01-01"), poor=strategy([rule], [rule], settings={"initial_deposit": 0}),
        dear=strategy([rule], [rule], settings={"commission_pct": -1}), other=strategy([rule], [rule | {"condition": "bull divergence"}], settings={"divergence_lookback": 7}), gone=strategy([rule], [rule]) | {"x": 1},
    )
    moved = configured(docs).withColumn("instrument", F.when(F.col("strategy_id") == "gone", "Z").otherwise(F.col("instrument")))
    bars = spark.createDataFrame([("A", DAY, 1.0, 1.0)], "symbol string, date date, close double, x double")
    got = {r["strategy_id"]: r["problem"] for r in strategies.problems(moved, ["x"], bars).collect()}
    assert got == dict(zip(("sound", "no_enter", "no_exit", "dates", "diverging", "late", "poor", "dear", "other", "gone"), (None, *strategies.PROBLEMS), strict=True))


def test_all_strategies_equal_one_by_one(spark):
    """Every strategy of a table as ``simulate`` runs it alone, divergences included."""
    rng = np.random.default_rng(9)
    rows = []
    for s in "AB":
        close = 100 + np.cumsum(rng.normal(size=300))
        close[50] = np.nan
        rows += [(s, DAY + dt.timedelta(days=i), None if np.isnan(c) else float(c), float(x)) for i, (c, x) in enumerate(zip(close, rng.normal(size=300), strict=True))]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double, x double")
    rule = lambda condition, value=0.0, **more: {"variable": "x", "condition": condition, "input_value": value, **more}
    own = {
        "plain": (rule(">", 0.5), rule("<", -0.5), "A", None, None, {}),
        "diverging": (rule("bull divergence"), rule("bear divergence"), "B", None, None, {"initial_deposit": 500}),
        "narrow": (rule("bull divergence"), rule("bear divergence"), "B", None, None, {"divergence_pivot_window": 2, "divergence_lookback": 20}),
        "cut": (rule("bull divergence"), rule("<=", -1.0), "A", "2020-02-10", "2020-08-01", {"commission_pct": 1.0, "slippage_pct": 0.5}),
        "gated": (rule(">=", 0.0, start_date="2020-03-01", end_date="2020-03-05"), rule("<", 0.0), "A", None, None, {}),
    }
    docs = documents(spark, **{n: strategy([e], [x], live_traded=i, global_start_date=a, global_end_date=b, settings=s) for n, (e, x, i, a, b, s) in own.items()})
    got = strategies.run_all(configured(docs), bars, ["close", "x"], indicators=["x"], windows=[(3, 60), (2, 20)])
    found = {}
    for r in got.collect():
        found.setdefault(r["strategy_id"], []).append(tuple(r)[1:])
    assert found.keys() == own.keys()
    for name, (e, x, instrument, a, b, s) in own.items():
        condition = lambda r: rules.Condition(1, r["variable"], r["condition"], None if "divergence" in r["condition"] else r["input_value"], r.get("start_date"), r.get("end_date"))
        panel = bars.filter(F.col("symbol") == instrument).withColumn("strategy_id", F.lit(name))
        costs = backtest.Costs(s.get("initial_deposit", 10_000.0), s.get("commission_pct", 0.0), s.get("slippage_pct", 0.0))
        alone = backtest.simulate(panel, backtest.Strategy("close", "close", [condition(e)], [condition(x)]), costs, a, b, side=s.get("divergence_pivot_window", 3), lookback=s.get("divergence_lookback", 60))
        assert sorted(found[name], key=str) == sorted((tuple(r)[1:] for r in alone.collect()), key=str), name
    assert any(r[2] for r in found["diverging"]) and any(r[2] for r in found["narrow"]) and any(r[-1] for r in found["plain"])


def test_no_strategies_or_bars(spark):
    bars = spark.createDataFrame([], "symbol string, date date, close double, x double")
    docs = documents(spark, a=strategy([{"variable": "x"}], [{"variable": "x"}]))
    assert strategies.run_all(configured(docs), bars, ["x"]).collect() == []
    assert strategies.run_all(configured(docs.limit(0)), bars, ["x"]).collect() == []


def test_saved_document(spark, tmp_path):
    """A run saved as a strategy is read back by the form, with dates within the data's."""
    first, last = dt.date(2020, 1, 1), dt.date(2020, 6, 30)
    form = store.form({"configuration": {"enter_rows": [{"variable": "x", "start_date": "2019-01-01", "end_date": "x"}]}}, ["close", "x"], first, last)
    assert (form["enter_rows"][0]["start_date"], form["enter_rows"][0]["end_date"]) == (first, last)
    table = spark.createDataFrame([(first, 1.005), (last, None)], "date date, close double")
    made = store.document("mine", form, table, {"yearly": table}, {"timeframe": "daily"}, "2020-01-01 00:00:00 UTC")
    path = str(tmp_path / "store.json")
    store.put(path, "mine", made)
    saved = store.load(path)["mine"]
    assert saved["configuration"]["enter_rows"][0]["start_date"] == "2020-01-01" and saved["configuration"]["timeframe"] == "daily"
    assert saved["full_input_table"] == {"columns": ["date", "close"], "data": [{"date": "2020-01-01", "close": 1.0}, {"date": "2020-06-30", "close": None}]}
    assert store.form(saved, ["close", "x"], first, last) == form
