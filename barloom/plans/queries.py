"""Every operator as a query over the driver's tables. Doubles come with four places, as sums run in another order elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import number_of_text
from barloom.operators import backtest, horizons, performance, pivots, recursive, resample, rolling, rules, screen, stepwise, strategies, universe
from barloom.plans import candles as charts
from barloom.plans import metrics as tables
from barloom.plans import tester
from barloom.sources import bars as sources
from barloom.sources import folders, landed, sinks, store, uploads
from barloom.streaming import recursive as recursive_stream
from barloom.streaming import refresh

#: What the universe of the queries holds; the last one has no bars.
TICKERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "NO DATA")
PLACES = 4
KEPT = ("Group", "Subgroup", "Ticker")
STRATEGY = backtest.Strategy("close", "close", [rules.Condition(1, "roc12", ">", 20.0, end="1996-02-15")], [rules.Condition(1, "roc12", "<", -20.0)])
#: The same without a last day of entry, for whole tables.
OPEN_STRATEGY = backtest.Strategy("close", "close", [rules.Condition(1, "roc12", ">", 20.0)], [rules.Condition(1, "roc12", "<", -20.0)])
COSTS = backtest.Costs(10_000.0, 0.1, 0.05)


def places(c):
    return F.coalesce(F.round(c.try_cast(f"decimal(30,{PLACES + 2})"), PLACES).cast("double"), c)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles with PLACES places, halves away from zero. By way of decimals with two more: sums run in another order elsewhere, and a mean of prices that lies on a half must lie there for both."""
    return df.selectExpr(*(f"coalesce(CAST(round(try_cast(`{n}` AS decimal(30,{PLACES + 2})), {PLACES}) AS double), `{n}`) AS `{n}`" if t == "double" else f"`{n}`" for n, t in df.dtypes))


def significant(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """Doubles with six digits: over all bars money multiplies to sums whose places after the point mean nothing. Those in ``but`` stay as they are."""
    return df.select(*(F.format_string("%.5e", F.col(f"`{n}`")).cast("double").alias(n) if t == "double" and n not in but else F.col(f"`{n}`") for n, t in df.dtypes))


def base(spark, sf_dir) -> DataFrame:
    return tables.clean(sources.bars_orders(spark, sf_dir))


def indicators(spark, sf_dir) -> DataFrame:
    return recursive.with_recursive(base(spark, sf_dir)).withColumn("roc12", rolling.roc("close"))


def entries(spark, sf_dir) -> DataFrame:
    """Universe rows: a group for each region, a subgroup for each nation, with a ticker each."""
    nation, region = (sources.read_table(spark, sf_dir, n) for n in ("nation", "region"))
    ticker = F.element_at(F.array(*map(F.lit, TICKERS)), (F.col("n_nationkey") % len(TICKERS) + 1).cast("int"))
    named = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations in 5 regions at any scale
    return named.select(F.lit("World").alias("list"), F.col("r_name").alias("group"), F.col("n_name").alias("subgroup"), ticker.alias("ticker"), F.col("n_nationkey").cast("long").alias("ord"))


def curves(spark, sf_dir) -> DataFrame:
    """An equity curve for each symbol that is held from its first bar."""
    return backtest.benchmark_curve(sources.bars_orders(spark, sf_dir).select(F.col("symbol").alias("series"), F.col("ts").alias("date"), F.col("close").alias("price")), 10_000.0)


def universe_rows(spark, sf_dir):
    nested = universe.nested(entries(spark, sf_dir))
    as_json = nested.select(F.to_json(F.map_from_arrays(F.array("list"), F.array("groups"))).alias("universe"))
    return universe.flattened(as_json).drop("ord")


def universe_overlay(spark, sf_dir):
    rows = entries(spark, sf_dir)
    saved = rows.filter("group = 'ASIA'").withColumn("list", F.lit("Saved"))
    return universe.overlaid(rows.unionByName(rows.withColumn("list", F.lit("Saved"))), saved)


def universe_edited(spark, sf_dir):
    """Editor rows with marked, blank, incomplete and repeated ones."""
    rows = entries(spark, sf_dir)
    typed = rows.select(F.concat(F.lit(" "), "group").alias("group"), F.when(F.col("ord") % 7 != 0, F.col("subgroup")).alias("subgroup"), F.lower("ticker").alias("ticker"), (F.col("ord") % 5 == 0).alias("X"), F.col("ord").alias("row"))
    good, errors = universe.edited(typed.unionByName(typed))
    return good.select("group", "subgroup", "ticker", F.col("ord").alias("row"), F.lit(None).cast("string").alias("error")).unionByName(errors.distinct().select(*(F.lit(None).cast("string").alias(c) for c in ("group", "subgroup", "ticker")), "row", "error"))


def metrics(spark, sf_dir):
    return tables.metrics_table(entries(spark, sf_dir), sources.bars_orders(spark, sf_dir))


def top_performers(spark, sf_dir):
    """The flagship: as-of performance over all horizons of each universe entry, and the five best of a year."""
    rows = entries(spark, sf_dir).join(horizons.performance(base(spark, sf_dir)), F.col("ticker") == F.col("symbol"), "left").drop("symbol")
    return screen.top(rows, "Perf_12M_%")


def screen_counts(spark, sf_dir):
    """How many rows meet each filter of the screener, in one pass."""
    known = [(f, c, x) for f, some in screen.conditions().items() for c, x in some.items()]
    found = metrics(spark, sf_dir).agg(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(c).alias("choice"), F.count(F.when(x, 1)).alias("n")) for f, c, x in known)).alias("a"))
    return found.select(F.inline("a"))


def screened(spark, sf_dir):
    rows = screen.screened(metrics(spark, sf_dir), group="ASIA", trend="either")
    return screen.top(rows, "Perf_1M_%", need=True).select(*KEPT, "`Perf_1M_%`", "SMA_Trend")


def pivot_flags(spark, sf_dir):
    b = base(spark, sf_dir)
    return b.select("symbol", "ts", *(kind(c, 3, c == "low").alias(f"{name}_{c}") for c in ("low", "high") for kind, name in ((pivots.pivot, "plain"), (pivots.unique_pivot, "unique"))))


def crossovers(spark, sf_dir):
    raw = sources.bars_orders(spark, sf_dir)
    found = [rolling.recent_crossover(b, least).withColumn("frame", F.lit(name)) for b, least, name in ((base(spark, sf_dir), tables.DAILY_BARS, "day"), (resample.weekly(raw), tables.WEEKLY_BARS, "week"))]
    return found[0].unionByName(found[1])


def divergence_signals(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("roc12", rolling.roc("close"))
    for name, bull in (("bull", True), ("bear", False)):
        rows = pivots.with_boolean_divergence(rows, "close", "roc12", bull, name)
    late = pivots.with_boolean_divergence(rows, "close", "roc12", True, "bull_known", causal=True)
    return late.select("symbol", "ts", "bull", "bear", "bull_known").filter("bull OR bear OR bull_known")


def scored(ind: str, name: str):
    return lambda spark, sf_dir: pivots.scored_divergence(indicators(spark, sf_dir), ind, name)


def run_of(spark, sf_dir, strategy=STRATEGY, start: str | None = "1996-01-01", end: str | None = "2000-12-31") -> DataFrame:
    panel = base(spark, sf_dir).withColumn("roc12", rolling.roc("close")).select(F.col("symbol").alias("strategy_id"), F.col("ts").alias("date"), "close", "roc12")
    return backtest.simulate(panel, strategy, COSTS, start, end)


def whole_run(spark, sf_dir) -> DataFrame:
    """All bars of the table."""
    return run_of(spark, sf_dir, OPEN_STRATEGY, None, None)


def rule_signals(spark, sf_dir):
    """Rule rows with comparisons and date gates as one column."""
    rows = base(spark, sf_dir).withColumn("roc12", rolling.roc("close"))
    both = [rules.Condition(1, "roc12", ">=", 5.0, start="1997-01-01"), rules.Condition(2, "close", "<", 250_000.0, end="1999-12-31")]
    return rows.select("symbol", "ts", rules.signal(both, "close").alias("hit"), rules.signal([], "close").alias("never"))


def joined(spark, sf_dir, benchmark_days: str = "true"):
    own = lambda s: sources.bars_orders(spark, sf_dir).filter(F.col("symbol") == s).select(F.col("ts").alias("date"), "open", "high", "low", "close")
    return uploads.joined(own(TICKERS[0]), own(TICKERS[1]), {"LOW": own(TICKERS[4]).filter(benchmark_days)})


def warm_starts(spark, sf_dir):
    return uploads.warm_start(base(spark, sf_dir).withColumns({"sma200": rolling.rolling_mean("close", 200), "roc12": rolling.roc("close")}), ["sma200", "roc12"])


def text_orders(spark, sf_dir) -> DataFrame:
    """Orders as an upload would bring them: all text, numbers with separators, dates day first."""
    o = sources.read_table(spark, sf_dir, "orders")
    shown = F.when(F.col("o_orderkey") % 9 == 0, "n/a").when(F.col("o_orderkey") % 7 == 0, "null").otherwise(F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit("%")))
    return o.select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), shown.alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"))


def numbers_of_text(spark, sf_dir):
    return text_orders(spark, sf_dir).select("key", number_of_text(F.col("price")).alias("price"))


def series_of_upload(spark, sf_dir):
    first = uploads.time_series(text_orders(spark, sf_dir), "day", "key")
    return first.select(F.to_date("date").alias("date"), "key")


def candle_rows(frame: str):
    def query(spark, sf_dir):
        return charts.candles(sources.bars_orders(spark, sf_dir), frame).select("symbol", "ts", "open", "high", "low", "close", "sma50", "sma200", "bb_mid", "bb_upper", "bb_lower", "up", "roc12")

    return query


def rolling_values(spark, sf_dir):
    up, down = rolling.directional_moves()
    rows = rolling.bollinger(base(spark, sf_dir)).withColumns({"sma200": rolling.rolling_mean("close", 200), "std20": rolling.rolling_std("close", 20, 5), "roc12": rolling.roc("close"), "true_range": rolling.true_range(), "dm_plus": up, "dm_minus": down, "up": rolling.candle_up()})
    return rows.drop("open", "high", "low", "volume")


def color_places(spark, sf_dir):
    rows = entries(spark, sf_dir).join(horizons.performance(base(spark, sf_dir)), F.col("ticker") == F.col("symbol"), "left").withColumnRenamed("ticker", "Ticker")
    return charts.color_scale(rows, "Perf_1M_%", TICKERS[4]).select("subgroup", "Ticker", "place")


def records(spark, sf_dir):
    return uploads.as_records(resample.monthly(sources.bars_orders(spark, sf_dir)).select("symbol", "ts", F.lit(None).cast("string").alias("note")))


def weekly_equity(spark, sf_dir):
    """Of weekly curves: equity, drawdown and the chart's frame without missing values."""
    weeks = resample.last_per_week(curves(spark, sf_dir))
    return weeks.withColumn("drawdown", rolling.running_drawdown("equity", Window.partitionBy("series").orderBy("week")))


def live(spark, sf_dir, timeframe: str = "daily") -> DataFrame:
    return tester.live_dataset(sources.bars_orders(spark, sf_dir), TICKERS[0], TICKERS[1], [TICKERS[4], TICKERS[5]], timeframe)[0]


def live_run(spark, sf_dir) -> tester.Run:
    """A whole run: ready part, warm-up, simulation, benchmark on the same days."""
    strategy = backtest.Strategy("Traded_Close", "Traded_Close", [rules.Condition(1, "ROC", ">", 20.0)], [rules.Condition(1, "ROC", "<", -20.0)])
    return tester.backtest_run(tester.ready_part(live(spark, sf_dir)), strategy, COSTS, [f"BMK_{TICKERS[4]}_Close"], risk_free_pct=2.0)


def divergence_run(spark, sf_dir) -> DataFrame:
    """Bought on bullish divergences of ROC, sold on bearish ones."""
    strategy = backtest.Strategy("close", "close", [rules.Condition(1, "roc12", "bull divergence")], [rules.Condition(1, "roc12", "bear divergence")])
    return run_of(spark, sf_dir, strategy, None, None)


def kept_order(spark, sf_dir):
    """Entries in an order that the user has chosen for some of them."""
    rows = entries(spark, sf_dir)
    chosen = rows.filter("group = 'ASIA'").select("subgroup", (-F.col("ord")).alias("position"))
    return screen.in_order(rows.select("subgroup", "ticker"), chosen, "subgroup")


def saved_dates(spark, sf_dir):
    """Saved dates, some of which can't be read, within limits."""
    o = sources.read_table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    day = lambda x: F.lit(x).cast("date")
    return o.select(F.col("o_orderkey").alias("key"), store.saved_date(text, day("1996-01-01"), day("1995-06-01"), day("2000-06-30")).alias("date"))


def strategy_settings(spark, sf_dir):
    """Settings of saved strategies, one for each nation, most of which say only some."""
    n = sources.read_table(spark, sf_dir, "nation")
    own = F.when(F.col("n_nationkey") % 2 == 0, F.struct((F.col("n_nationkey") * 100).alias("initial_deposit"), F.lit(0.1).alias("commission_pct")))
    return store.settings(n.select(F.col("n_name").alias("name"), F.to_json(F.struct(F.struct(own.alias("settings")).alias("configuration"))).alias("strategy")))


def hourly_recursions(spark, sf_dir):
    """EWM with gaps and Wilder's level of hourly bars, of each event type and of all events as one symbol, a task for each week of a symbol."""
    events = sources.read_table(spark, sf_dir, "events")
    every = events.withColumn("event_type", F.lit("ALL"))
    bars = sources.hourly(events.unionByName(every))
    gaps = bars.select("symbol", "ts", "high", F.when(F.hour("ts") % 7 != 3, F.col("close")).alias("close"))
    steps = {"ewm12": ("close", lambda: stepwise.Ewm(2 / 13)), "ewm12_warm": ("close", lambda: stepwise.Ewm(2 / 13, 12)), "wilder14": ("high", lambda: stepwise.Wilder(14))}
    return stepwise.by_chunks(gaps, F.date_trunc("week", "ts"), steps).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def saved_strategies(spark, sf_dir) -> DataFrame:
    """A strategy document for each nation: rules, dates and costs differ, some say nothing of them, some can't run."""
    k = F.col("n_nationkey")
    rule = lambda **said: F.struct(*(v.alias(n) for n, v in said.items()))
    level = F.lit(10.0) + k % 4 * 5
    cheap = F.when(k % 3 == 0, rule(use=F.lit(True), variable=F.lit("close"), condition=F.lit("<"), input_value=F.lit(300_000.0), start_date=F.lit("1996-01-01"), end_date=F.lit("never")))
    first = F.when(k % 6 == 5, rule(variable=F.lit("roc12"), condition=F.lit("bull divergence"))).otherwise(rule(variable=F.lit("roc12"), condition=F.lit(">")))
    enter = F.array(F.struct(first["variable"].alias("variable"), first["condition"].alias("condition"), level.alias("input_value")))
    leave = F.array(rule(use=k % 7 != 6, variable=F.lit("roc12"), condition=F.lit("<"), input_value=-level))
    settings = F.struct((F.lit(1000.0) * (k + 1)).alias("initial_deposit"), F.when(k % 2 == 0, 0.1).alias("commission_pct"), F.when(k % 3 == 0, 0.05).alias("slippage_pct"))
    dates = [F.when(k % 5 == 0, x).alias(n) for n, x in (("global_start_date", "1996-01-01"), ("global_end_date", "2000-12-31"))]
    second = F.struct(cheap["use"].alias("use"), cheap["variable"].alias("variable"), cheap["condition"].alias("condition"), cheap["input_value"].alias("input_value"), cheap["start_date"].alias("start_date"), cheap["end_date"].alias("end_date"))
    wide = F.transform(enter, lambda r: F.struct(F.lit(None).cast("boolean").alias("use"), r["variable"].alias("variable"), r["condition"].alias("condition"), r["input_value"].alias("input_value"), F.lit(None).cast("string").alias("start_date"), F.lit(None).cast("string").alias("end_date")))
    rows = F.when(k % 3 == 0, F.concat(wide, F.array(second))).otherwise(wide)
    instrument = F.element_at(F.array(*map(F.lit, TICKERS)), (k % 5 + 1).cast("int"))
    document = F.to_json(F.struct(F.struct(instrument.alias("live_traded"), *dates, settings.alias("settings"), rows.alias("enter_rows"), leave.alias("exit_rows")).alias("configuration")))
    return sources.read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("strategy_id"), document.alias("strategy"))


def configured_strategies(spark, sf_dir) -> DataFrame:
    day = lambda x: F.lit(x).cast("date")
    return store.configured(saved_strategies(spark, sf_dir), day("1992-01-01"), day("2010-12-31"), ["close", "roc12"]).withColumnRenamed("live_traded", "instrument")


def strategy_bars(spark, sf_dir) -> DataFrame:
    return base(spark, sf_dir).withColumn("roc12", rolling.roc("close")).select("symbol", F.col("ts").alias("date"), "close", "roc12")


def all_strategies(spark, sf_dir) -> DataFrame:
    return strategies.run_all(configured_strategies(spark, sf_dir), strategy_bars(spark, sf_dir), ["close", "roc12"], indicators=["roc12"])


def landed_bars(spark, sf_dir):
    """Bars that were landed before: adjusted ones of two years, of ten years where these are there and else of all; and all unadjusted ones of two symbols."""
    root, bars = folders.fresh(spark, "landed"), sources.bars_orders(spark, sf_dir)
    landed.land(bars.filter(F.col("symbol").isin(*TICKERS[:3]) & (F.col("ts") >= "1998-01-01")), root, "10y")
    landed.land(bars, root, "max")
    landed.land(bars.withColumn("close", F.col("close") * 2), root, "max", adjusted=False)
    adjusted = landed.landed(spark, root, TICKERS, "symbol string, ts date, close double").filter("ts >= DATE '1997-01-01' AND ts < DATE '1999-01-01'")
    traded = landed.landed(spark, root, TICKERS[:2], "symbol string, ts date, close double", adjusted=False)
    return adjusted.withColumn("kind", F.lit("adjusted")).unionByName(traded.withColumn("kind", F.lit("unadjusted")))


def upload_counts(spark, sf_dir):
    """What is lost of an upload, some of whose lines have a field too many, counted by the one pass that makes a series of it."""
    path, names = folders.fresh(spark, "upload") + ".csv", ("day", "price", "status", "key")
    rows = text_orders(spark, sf_dir).withColumn("price", F.concat(F.lit('"'), "price", F.lit('"')))
    line = F.concat_ws(",", *names, F.when(F.col("key") % 13 == 0, "more"))
    rows.select(line.alias(",".join(names))).write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    upload, read = uploads.read_upload(spark, path)
    series, counts = uploads.numeric_series(upload, "day", "key", ["price"])
    series.write.format("noop").mode("overwrite").save()
    found = {"lines": read.get["lines"], "left_out": read.get["left_out"], "lost_prices": counts.lost()["price"], "repeated_days": counts.repeated()}
    return spark.createDataFrame(list(found.items()), "what string, n long")


def saved_values(spark, sf_dir):
    """Values saved with strategies, in documents whose rows have different columns: a document for every fifty customers of a nation."""
    c = sources.read_table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    row = F.struct(key.alias("key"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.when(nation % 3 == 1, F.col("c_acctbal")).alias("balance"))
    grouped = c.groupBy("c_nationkey", F.floor(key / 1250).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))  # at most 50 customers of one nation, if keys go round
    full, empty = F.struct(F.col("rows").alias("data")), F.struct(F.expr("array()::array<string>").alias("data"))
    document = F.when(nation == 5, "no document").when(nation % 3 == 0, F.to_json(F.struct(empty.alias("full_input_table"), full.alias("underlying_inputs")))).otherwise(F.to_json(F.struct(full.alias("full_input_table"))))
    saved = uploads.saved_tables(grouped.select(F.concat_ws("/", "c_nationkey", "block").alias("name"), document.alias("document")))
    each = saved.select("name", "row", F.explode("values").alias("column", "value"))
    text = F.col("column") == "segment"
    return each.select("name", "row", "column", F.when(text, F.col("value")).alias("text"), F.when(~text, F.col("value").cast("double")).alias("number"))


def metrics_refreshed(spark, sf_dir):
    """The metrics table after two batches of bars, the second of which has two symbols only."""
    paths = [folders.fresh(spark, n) for n in ("bars", "history", "metrics", "refresh")]
    bars, late = sources.bars_orders(spark, sf_dir), F.col("symbol").isin(*TICKERS[:2]) & (F.col("ts") >= "1999-01-01")
    for part in (bars.filter(~late), bars.filter(late)):
        part.write.mode("append").parquet(paths[0])
        refresh.refreshed(spark, *paths)
    return tables.listed(entries(spark, sf_dir), refresh.read(spark, paths[2])).drop("ord")


def flows(spark, sf_dir) -> DataFrame:
    """Flows of most tickers, made of account balances."""
    ticker = F.element_at(F.array(*map(F.lit, TICKERS)), (F.col("c_nationkey") % len(TICKERS) + 1).cast("int"))
    found = sources.read_table(spark, sf_dir, "customer").groupBy(ticker.alias("ticker")).agg(F.avg(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("FundFlows_3M_%"), F.min("c_acctbal").alias("FundFlows_1M_%"))
    return found.filter(F.col("ticker") != TICKERS[2])


def flow_rows(spark, sf_dir) -> DataFrame:
    named = entries(spark, sf_dir).withColumnsRenamed({"list": "List", "group": "Group", "subgroup": "Subgroup", "ticker": "Ticker"})
    return screen.with_flows(named, flows(spark, sf_dir))


def chart_bars(spark, sf_dir) -> DataFrame:
    """Bars of a metric that came as text, some of it no number."""
    rows = flow_rows(spark, sf_dir)
    shown = rows.withColumn("FundFlows_3M_%", F.when(F.col("ord") % 4 == 1, "n/a").otherwise(F.col("`FundFlows_3M_%`").cast("string")))
    return screen.chart_bars(screen.chart_frame(shown, numeric=["FundFlows_3M_%", "not there"]), "FundFlows_3M_%", "FundFlows_1M_%")


def parted_changes(spark, sf_dir) -> DataFrame:
    """Whether price and RSI went apart over 12 bars, by more than one percent and one point."""
    w = rolling.by_symbol()
    rows = recursive.with_recursive(base(spark, sf_dir), ["rsi_screen"]).withColumns({"roc12": rolling.roc("close"), "rsi_change": F.col("rsi_screen") - F.lag("rsi_screen", 12).over(w)})
    return rows.select("symbol", "ts", pivots.parted("roc12", "rsi_change", 1.0).alias("direction"))


PLAIN = {
    "parted_changes": parted_changes,
    "top_flows_known": lambda s, d: screen.top_by_flows(flow_rows(s, d))[0].select(*KEPT, "`FundFlows_3M_%`"),
    "top_flows_known_flag": lambda s, d: screen.top_by_flows(flow_rows(s, d))[1],
    "chart_bars": chart_bars,
    "landed_bars": landed_bars,
    "upload_counts": upload_counts,
    "saved_values": saved_values,
    "metrics_refreshed": metrics_refreshed,
    "recursive_indicators_stream": lambda s, d: recursive_stream.replayed(base(s, d), ["1996-03-01", "1999-01-01"]),
    "hourly_recursions": hourly_recursions,
    "strategies_trades": lambda s, d: significant(backtest.trades(all_strategies(s, d)).withColumn("price", places(F.col("price"))), ("price",)),
    "strategies_headline": lambda s, d: performance.headline(backtest.equity(all_strategies(s, d))),
    "strategies_problems": lambda s, d: strategies.problems(configured_strategies(s, d), ["roc12"], strategy_bars(s, d)).select("strategy_id", "problem"),
    "live_dataset": live,
    "live_dataset_weekly": lambda s, d: live(s, d, "weekly"),
    "live_ready_part": lambda s, d: tester.ready_part(live(s, d)).select("date", "Underlying_Close", "SMA200"),
    "auto_start": lambda s, d: tester.auto_start(sources.bars_orders(s, d), TICKERS[0], TICKERS[1], "2001-06-30"),
    "live_run_curves": lambda s, d: live_run(s, d).curves,
    "live_run_trades": lambda s, d: live_run(s, d).trades.drop("reason"),
    "live_run_headline": lambda s, d: live_run(s, d).headline,
    "live_run_yearly": lambda s, d: live_run(s, d).yearly,
    "equity_export": lambda s, d: sinks.wide_curves(curves(s, d), list(TICKERS[:2])),
    "display_text": lambda s, d: sinks.display_text(horizons.performance(base(s, d)).select("symbol", "`Perf_1M_%`", "`Perf_10Y_%`")),
    "backtest_divergence_trades": lambda s, d: backtest.trades(divergence_run(s, d)).drop("reason"),
    "candle_oscillators": lambda s, d: charts.oscillators(charts.candles(sources.bars_orders(s, d))),
    "top_flows": lambda s, d: screen.top_by_flows(metrics(s, d))[0].select(*KEPT, "`FundFlows_3M_%`"),
    "top_flows_flag": lambda s, d: screen.top_by_flows(metrics(s, d))[1],
    "chart_frame": lambda s, d: screen.chart_frame(entries(s, d).withColumnsRenamed({"list": "List", "subgroup": "Subgroup", "ticker": "Ticker"})).select("List", "TickerAxis", "Order"),
    "ticker_subgroups": lambda s, d: screen.subgroup_of_ticker(entries(s, d)),
    "kept_order": kept_order,
    "saved_dates": saved_dates,
    "strategy_settings": strategy_settings,
    "repeated_dates": lambda s, d: uploads.repeated_dates(text_orders(s, d), "day"),
    "source_bars_orders": sources.bars_orders,
    "source_bars_lineitem": sources.bars_lineitem,
    "source_bars_events": lambda s, d: sources.bars_events(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
    "source_bars_between": lambda s, d: sources.between(sources.bars_orders(s, d), "1996-01-01", "1996-12-31"),
    "universe_flattened": universe_rows,
    "universe_overlay": universe_overlay,
    "universe_edited": universe_edited,
    "performance_horizons": lambda s, d: horizons.performance(base(s, d)),
    "below_highs": lambda s, d: horizons.below_highs(base(s, d)),
    "top_performers": top_performers,
    "weekly_complete": lambda s, d: resample.weekly(sources.bars_orders(s, d)),
    "weekly_partial": lambda s, d: resample.weekly(sources.bars_orders(s, d), resample.PARTIAL),
    "weekly_strict": lambda s, d: resample.weekly(sources.bars_orders(s, d), resample.STRICT),
    "monthly": lambda s, d: resample.monthly(sources.bars_orders(s, d)),
    "rolling_values": rolling_values,
    "price_vs_averages": lambda s, d: rolling.price_vs_averages(base(s, d)).drop("open", "high", "low", "volume"),
    "spread_statistics": lambda s, d: rolling.spread_statistics(base(s, d)),
    "crossovers": crossovers,
    "band_position": lambda s, d: rolling.band_position(resample.weekly(sources.bars_orders(s, d))),
    "recursive_indicators": lambda s, d: recursive.with_recursive(base(s, d)).select("symbol", "ts", *recursive.COLUMNS),
    "pivot_flags": pivot_flags,
    "matched_pivots": lambda s, d: pivots.matched_pivots(indicators(s, d), "low", "roc12", True).select("symbol", F.col("i").cast("long").alias("i"), "p", "v", F.col("t_ind").cast("long").alias("t_ind")),
    "scored_divergence_rsi": scored("rsi_screen", "RSI"),
    "scored_divergence_macd": scored("macd_screen", "MACD_HIST"),
    "scored_divergence_roc": scored("roc12", "ROC"),
    "boolean_divergence": divergence_signals,
    "latest_indicators": lambda s, d: tables.latest_indicators(indicators(s, d)),
    "metrics_table": lambda s, d: metrics(s, d).drop("ord"),
    "screen_counts": screen_counts,
    "screened_top": screened,
    "screen_options": lambda s, d: screen.options(entries(s, d).withColumnsRenamed({"group": "Group", "subgroup": "Subgroup"}), "Subgroup", "EUROPE"),
    "rule_signals": rule_signals,
    "backtest_equity": lambda s, d: backtest.equity(run_of(s, d)),
    "backtest_trades": lambda s, d: backtest.trades(run_of(s, d)),
    "backtest_headline": lambda s, d: performance.headline(backtest.equity(run_of(s, d)), 2.0),
    "backtest_equity_whole": lambda s, d: significant(backtest.equity(whole_run(s, d))),
    "backtest_trades_whole": lambda s, d: significant(backtest.trades(whole_run(s, d))),
    "backtest_headline_whole": lambda s, d: performance.headline(backtest.equity(whole_run(s, d)), 2.0),
    "benchmark_curves": curves,
    "curve_drawdown": lambda s, d: performance.drawdown(curves(s, d)),
    "curve_headline": lambda s, d: performance.headline(curves(s, d), 2.0),
    "curve_yearly": lambda s, d: performance.yearly(curves(s, d)),
    "weekly_equity": weekly_equity,
    "joined_dataset": lambda s, d: joined(s, d, "day(date) > 3"),
    "joined_dataset_whole": joined,
    "warm_start": warm_starts,
    "upload_profile": lambda s, d: uploads.profile(text_orders(s, d), ["day", "price", "status"]),
    "upload_numbers": numbers_of_text,
    "upload_series": series_of_upload,
    "records": records,
    "candles_daily": candle_rows("daily"),
    "candles_weekly": candle_rows("weekly"),
    "candles_monthly": candle_rows("monthly"),
    "value_range": lambda s, d: charts.value_range(base(s, d), ["open", "high", "low", "close"]),
    "color_scale": color_places,
}
#: Queries that come with significant digits instead of places.
DIGITS = ("backtest_equity_whole", "backtest_trades_whole", "strategies_trades")
QUERIES = {name: (f if name in DIGITS else lambda spark, sf_dir, f=f: rounded(f(spark, sf_dir))) for name, f in PLAIN.items()}
#: Queries that look at a part of their tables only, named after it; those with the ending "_whole" beside them look at all.
WINDOWED = {f"backtest_{x}": f"backtest_{x}_1996_2000" for x in ("equity", "trades", "headline")} | {"joined_dataset": "joined_dataset_from_day_4"}
QUERIES = {WINDOWED.get(name, name): f for name, f in QUERIES.items()}
