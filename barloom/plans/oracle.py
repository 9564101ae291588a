"""The queries in SQL, written on their own: recursions as recursive tables, windows as window functions.

Each piece below is a named table; a query names the pieces it needs, in their order.
"""

from __future__ import annotations

BY = "PARTITION BY symbol ORDER BY ts"
HORIZONS = {"1D": 1, "1W": 7, "1M": 30, "3M": 90, "6M": 182, "12M": 365, "3Y": 1095, "5Y": 1825, "10Y": 3650}
TICKER = "CASE n_nationkey % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' ELSE 'NO DATA' END"


def change(now: str, then: str) -> str:
    return f"({now} / nullif({then}, 0) - 1) * 100"


def digits(c: str) -> str:
    return f"CAST(printf('%.5e', {c}) AS DOUBLE)"


def mean(c: str, n: int, by: str = BY) -> str:
    frame = f"OVER ({by} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {frame} >= {n} THEN avg({c}) {frame} END"


def deviation(c: str, n: int, least: int | None = None, by: str = BY) -> str:
    frame = f"OVER ({by} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {frame} >= {least or n} THEN stddev_samp({c}) {frame} END"


def bars(symbol: str, ts: str, price: str, order: str, volume: str, source: str) -> str:
    return f"SELECT {symbol} AS symbol, {ts} AS ts, arg_min({price}, {order}) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, {order}) AS close, CAST({volume} AS DOUBLE) AS volume FROM {source} GROUP BY 1, 2"


def as_of(v: str, days: int) -> str:
    return f"arg_max({v}, ts) FILTER ({v} IS NOT NULL AND ts <= today - {days})"


def grouped(label: str) -> str:
    return f"""SELECT symbol, {label} AS label, arg_min(open, ts) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
        arg_max(close, ts) FILTER (close IS NOT NULL) AS close, coalesce(sum(volume), 0.0) AS volume FROM bars GROUP BY 1, 2"""


def crossed(source: str, least: int) -> str:
    return f"""SELECT symbol, max(CASE WHEN nth <= 14 AND bars >= {least} AND above AND NOT was THEN 1 ELSE 0 END)::INTEGER AS golden,
          max(CASE WHEN nth <= 14 AND bars >= {least} AND NOT above AND was THEN 1 ELSE 0 END)::INTEGER AS death
        FROM (SELECT *, coalesce(lag(above) OVER (PARTITION BY symbol, ok ORDER BY ts), false) AS was FROM
          (SELECT *, f > s AS above, f IS NOT NULL AND s IS NOT NULL AS ok, CASE WHEN f IS NOT NULL AND s IS NOT NULL THEN row_number() OVER (PARTITION BY symbol, f IS NOT NULL AND s IS NOT NULL ORDER BY ts DESC) END AS nth FROM
            (SELECT symbol, ts, {mean("close", 50)} AS f, {mean("close", 200)} AS s, count(*) OVER (PARTITION BY symbol) AS bars FROM {source})))
        GROUP BY symbol"""


def candle(source: str, label: str) -> str:
    return f"""SELECT symbol, ts, open, high, low, close, sma50, sma200, bb_mid, bb_upper, bb_lower, up,
          CASE WHEN nth <= 138 OR n - nth >= 12 AND shown > 12 AND row_in > 12 THEN {change("close", "c12")} END AS roc12
        FROM (SELECT *, row_number() OVER ({BY}) AS row_in, count(*) OVER (PARTITION BY symbol) AS shown, lag(close, 12) OVER ({BY}) AS c12 FROM
          (SELECT *, bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower FROM
            (SELECT symbol, {label} AS ts, open, high, low, close, {mean("close", 50, f"PARTITION BY symbol ORDER BY {label}")} AS sma50, {mean("close", 200, f"PARTITION BY symbol ORDER BY {label}")} AS sma200,
              {mean("close", 50, f"PARTITION BY symbol ORDER BY {label}")} AS bb_mid, {deviation("close", 50, None, f"PARTITION BY symbol ORDER BY {label}")} AS sd,
              coalesce(close >= lag(close) OVER (PARTITION BY symbol ORDER BY {label}), true) AS up,
              row_number() OVER (PARTITION BY symbol ORDER BY {label} DESC) AS nth, count(*) OVER (PARTITION BY symbol) AS n FROM {source}))
          WHERE n >= 20 AND nth <= 150)"""


def matched(price: str, ind: str, side: str) -> str:
    """Price pivots with the nearest indicator pivot."""
    frame = f"OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    return f"""SELECT symbol, i, p, v, t_ind, std, n FROM
        (SELECT a.symbol, a.i, a.p, b.v, b.i AS t_ind, a.std, a.n, row_number() OVER (PARTITION BY a.symbol, a.i ORDER BY abs(b.i - a.i), b.i) AS near
         FROM (SELECT symbol, i, {price} AS p, {deviation(ind, 20, 5)} AS std, count(*) OVER (PARTITION BY symbol) AS n, count({price}) {frame} = 7 AND {price} = {side}({price}) {frame} AS pivot FROM ind) a
         JOIN (SELECT symbol, i, {ind} AS v, count({ind}) {frame} = 7 AND {ind} = {side}({ind}) {frame} AS pivot FROM ind) b
         ON a.symbol = b.symbol AND a.pivot AND b.pivot AND abs(b.i - a.i) <= 2) WHERE near = 1"""


def scored(ind: str, name: str) -> str:
    need = {"RSI": "4.0", "MACD_HIST": "0.5 * (std + 1e-9)", "ROC": "0.7 * (std + 1e-9)"}[name]
    zone = "(side = 0 AND least(v, v1) < 30 OR side = 1 AND greatest(v, v1) > 70)" if name == "RSI" else "(v * v1 < 0 OR sd > 0 AND greatest(abs(v), abs(v1)) >= 1.5 * sd)"
    own = lambda k, price, side: f"SELECT *, {k} AS side, lag(i) OVER w AS t1, lag(p) OVER w AS p1, lag(v) OVER w AS v1, coalesce(std, 0) AS sd FROM ({matched(price, ind, side)}) WINDOW w AS (PARTITION BY symbol ORDER BY i)"
    return f"""SELECT s.symbol, coalesce(direction, 'nothing') AS direction, score, coalesce(type, 'none') AS type FROM (SELECT DISTINCT symbol FROM base) s LEFT JOIN
        (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, side, i) AS best FROM
          (SELECT *, CASE side WHEN 0 THEN 'bull' ELSE 'bear' END AS direction,
             CASE WHEN side = 0 AND p < p1 AND v > v1 THEN 'regular_bull' WHEN side = 0 AND p > p1 AND v < v1 THEN 'hidden_bull'
                  WHEN side = 1 AND p > p1 AND v < v1 THEN 'regular_bear' WHEN side = 1 AND p < p1 AND v > v1 THEN 'hidden_bear' END AS type,
             100 * greatest(0, least(1, 0.35 * abs((p - p1) / p1) + 0.40 * abs(v - v1) / (sd + 1e-9) + 0.15 * least(1, (i - t1) / 40.0) + 0.10 * CASE WHEN {zone} THEN 1 ELSE 0 END)) AS score
           FROM ({own(0, "low", "min")} UNION ALL {own(1, "high", "max")})
           WHERE t1 IS NOT NULL AND p1 <> 0 AND i >= n - 60 AND i - t1 <= 40 AND abs((p - p1) / p1) >= 0.005 AND abs(v - v1) >= {need})
         WHERE type IS NOT NULL) c ON s.symbol = c.symbol AND best = 1"""


def unique_pivot(c: str, side: str) -> str:
    frame = f"OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    return f"coalesce(i >= 3 AND i < n - 3 AND {c} = {side}({c}) {frame} AND len(list_filter(list({c}) {frame}, lambda x: x = {c})) = 1, false)"


def apart(side: str, price: str, ind: str) -> str:
    before = f"OVER ({BY} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
    return f"""SELECT symbol, ts, pp AND coalesce(close {price} last_value(CASE WHEN pp THEN close END IGNORE NULLS) {before} AND roc12 {ind} last_value(CASE WHEN ip THEN roc12 END IGNORE NULLS) {before}, false) AS hit
        FROM (SELECT symbol, ts, close, roc12, {unique_pivot("close", side)} AS pp, {unique_pivot("roc12", side)} AS ip FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM ind))"""


PERFORMANCE = f"SELECT symbol, {', '.join(f'{change("now", f"h{d}")} AS "Perf_{h}_%"' for h, d in HORIZONS.items())} FROM (SELECT symbol, {as_of('close', 0)} AS now, {', '.join(f'{as_of("close", d)} AS h{d}' for d in HORIZONS.values())} FROM dated GROUP BY 1)"
HIGHS = f"""SELECT symbol, {change("now", "year")} AS "Price_vs_52W_High_%", {change("now", "ath")} AS "Price_vs_ATH_%"
        FROM (SELECT symbol, {as_of("close", 0)} AS now, max(close) FILTER (ts >= today - 401) AS year, max(high) AS ath FROM dated GROUP BY 1)"""
SPREADS = f"""SELECT symbol, now AS "SMA50w_vs_SMA200w_Spread_%", avg36 AS "SMA50w_vs_SMA200w_Spread_Avg_36M_%", {change("now", "ago")} AS "SMA_Spread_%_Change_6M_%",
          CASE WHEN now - ago > 0 THEN 'bull' WHEN now - ago <= 0 THEN 'bear' END AS "SMA_Trend"
        FROM (SELECT symbol, {as_of("spread", 0)} AS now, {as_of("spread", 182)} AS ago, avg(spread) FILTER (nth <= 756) AS avg36
          FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY spread IS NULL, ts DESC) AS nth FROM (SELECT *, {change("close", mean("close", 200))} AS spread FROM dated)) GROUP BY 1)"""
BANDS = f"""SELECT symbol, CAST(CASE WHEN sd <= 0 OR sd / 5 <= 1e-12 THEN 0 WHEN close >= m + 2 * sd THEN 10 WHEN close <= m - 2 * sd THEN -10
            WHEN close > m THEN greatest(1, least(9, ceil((close - m) / nullif(sd / 5, 0)))) WHEN close < m THEN -greatest(1, least(9, ceil((m - close) / nullif(sd / 5, 0)))) ELSE 0 END AS INTEGER) AS "BB_Position",
          m AS "BB_Mid", CASE WHEN sd > 0 THEN m + 2 * sd END AS "BB_Upper", CASE WHEN sd > 0 THEN m - 2 * sd END AS "BB_Lower", CASE WHEN sd > 0 THEN sd / 5 END AS "BB_StepUp", CASE WHEN sd > 0 THEN sd / 5 END AS "BB_StepDown", close AS "WeeklyClose_Last"
        FROM (SELECT symbol, ts, close, {mean("close", 50)} AS m, {deviation("close", 50)} AS sd, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM weeks) WHERE nth = 1 AND m IS NOT NULL AND sd IS NOT NULL"""
LATEST = """SELECT symbol, arg_max(rsi_screen, ts) FILTER (rsi_screen IS NOT NULL) AS "RSI_14", arg_max(adx, ts) FILTER (adx IS NOT NULL) AS "ADX_14",
          max(di_plus) FILTER (np = 1) AS "DI_Plus_14", max(di_minus) FILTER (nm = 1) AS "DI_Minus_14", max(di_plus) FILTER (np = 1) - max(di_plus) FILTER (np = 3) AS "DI_Plus_14_Delta2", max(di_minus) FILTER (nm = 1) - max(di_minus) FILTER (nm = 3) AS "DI_Minus_14_Delta2"
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY di_plus IS NULL, ts DESC) AS np, row_number() OVER (PARTITION BY symbol ORDER BY di_minus IS NULL, ts DESC) AS nm FROM ind) GROUP BY 1"""
DIVERGENCES = {"RSI": scored("rsi_screen", "RSI"), "MACD": scored("macd_screen", "MACD_HIST"), "ROC": scored("roc12", "ROC")}
FRIDAY = "CAST(ts + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS DATE)"

PIECES = {
    "bars": bars("o_orderpriority", "CAST(o_orderdate AS DATE)", "o_totalprice", "o_orderkey", "count(*)", "orders"),
    "base": "SELECT * EXCLUDE (n_) FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_ FROM bars WHERE close IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL) WHERE n_ >= 60",
    "dated": "SELECT *, max(ts) OVER (PARTITION BY symbol) AS today FROM base",
    "allweeks": grouped(FRIDAY),
    "weeks": "SELECT symbol, label AS ts, open, high, low, close, volume FROM allweeks JOIN (SELECT symbol, max(ts) AS e FROM bars GROUP BY 1) USING (symbol) WHERE label <= e AND close IS NOT NULL",
    "months": grouped("last_day(ts)"),
    "entries": f"SELECT 'World' AS list, r_name AS \"group\", n_name AS subgroup, {TICKER} AS ticker, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey",
    "num": f"SELECT symbol, ts, high, low, close, row_number() OVER ({BY}) - 1 AS i, lag(close) OVER ({BY}) AS pc, lag(high) OVER ({BY}) AS ph, lag(low) OVER ({BY}) AS pl FROM base",
    "moved": "SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS down FROM num",
    "seeds": "SELECT *, avg(close) OVER w AS s_close, avg(tr) OVER w AS s_tr, avg(up) OVER w AS s_up, avg(down) OVER w AS s_down FROM moved WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)",
    "rec": """SELECT symbol, i, close AS e12, close AS e26, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss, NULL::DOUBLE AS gain_t, NULL::DOUBLE AS loss_t, NULL::DOUBLE AS wil, NULL::DOUBLE AS a, NULL::DOUBLE AS u, NULL::DOUBLE AS d FROM seeds WHERE i = 0
        UNION ALL SELECT s.symbol, s.i, r.e12 * 11 / 13 + s.close * 2 / 13, r.e26 * 25 / 27 + s.close * 2 / 27,
          r.gain * 13 / 14 + greatest(s.close - s.pc, 0) / 14, r.loss * 13 / 14 + greatest(s.pc - s.close, 0) / 14,
          coalesce(r.gain_t * 13 / 14 + greatest(s.close - s.pc, 0) / 14, greatest(s.close - s.pc, 0)), coalesce(r.loss_t * 13 / 14 + greatest(s.pc - s.close, 0) / 14, greatest(s.pc - s.close, 0)),
          CASE WHEN s.i = 13 THEN s.s_close ELSE (r.wil * 13 + s.close) / 14 END, CASE WHEN s.i = 13 THEN s.s_tr ELSE (r.a * 13 + s.tr) / 14 END,
          CASE WHEN s.i = 13 THEN s.s_up ELSE (r.u * 13 + s.up) / 14 END, CASE WHEN s.i = 13 THEN s.s_down ELSE (r.d * 13 + s.down) / 14 END
        FROM rec r JOIN seeds s ON s.symbol = r.symbol AND s.i = r.i + 1""",
    "lines": """SELECT *, e12 - e26 AS line, 100 * u / nullif(a, 0) AS plus, 100 * d / nullif(a, 0) AS minus, 100 * abs(u - d) / nullif(u + d, 0) AS dx FROM rec""",
    "dxs": "SELECT *, CASE WHEN count(dx) OVER w = 14 THEN avg(dx) OVER w END AS s_dx FROM lines WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING)",
    "rec2": """SELECT symbol, i, line AS sig_t, NULL::DOUBLE AS sig, NULL::DOUBLE AS adx FROM dxs WHERE i = 0
        UNION ALL SELECT s.symbol, s.i, r.sig_t * 8 / 10 + s.line * 2 / 10, CASE WHEN s.i = 25 THEN s.line ELSE r.sig * 8 / 10 + s.line * 2 / 10 END, CASE WHEN s.i = 26 THEN s.s_dx ELSE (r.adx * 13 + s.dx) / 14 END
        FROM rec2 r JOIN dxs s ON s.symbol = r.symbol AND s.i = r.i + 1""",
    "ind": f"""SELECT n.symbol, n.ts, n.i, n.high, n.low, n.close, x.e12 AS ewm12, x.wil AS wilder14, CASE WHEN n.i >= 13 THEN CASE WHEN x.loss = 0 THEN 100 ELSE 100 - 100 / (1 + x.gain / x.loss) END END AS rsi_screen,
          100 - 100 / (1 + x.gain_t / nullif(x.loss_t, 0)) AS rsi_tester, CASE WHEN n.i >= 33 THEN x.line - y.sig END AS macd_screen, x.line - y.sig_t AS macd_tester, y.adx, x.plus AS di_plus, x.minus AS di_minus,
          {change("n.close", "lag(n.close, 12) OVER (PARTITION BY n.symbol ORDER BY n.ts)")} AS roc12
        FROM num n JOIN lines x ON n.symbol = x.symbol AND n.i = x.i JOIN rec2 y ON n.symbol = y.symbol AND n.i = y.i""",
    "perf": PERFORMANCE,
    "metrics": f"""SELECT e.list AS "List", e."group" AS "Group", e.subgroup AS "Subgroup", e.ticker AS "Ticker", perf.* EXCLUDE (symbol), h.* EXCLUDE (symbol), l.* EXCLUDE (symbol), s.* EXCLUDE (symbol), b.* EXCLUDE (symbol),
          CASE WHEN perf.symbol IS NOT NULL THEN coalesce(d.golden, 0) END AS "GoldenCross_D1", CASE WHEN perf.symbol IS NOT NULL THEN coalesce(d.death, 0) END AS "DeathCross_D1", CASE WHEN perf.symbol IS NOT NULL THEN coalesce(w.golden, 0) END AS "GoldenCross_W1", CASE WHEN perf.symbol IS NOT NULL THEN coalesce(w.death, 0) END AS "DeathCross_W1",
          v1.direction AS "Div_6M_vs_RSI", v2.direction AS "Div_6M_vs_MACD", v3.direction AS "Div_6M_vs_ROC", NULL::DOUBLE AS "FundFlows_1M_%", NULL::DOUBLE AS "FundFlows_3M_%",
          {" , ".join(f'(coalesce((v1.direction = {way!r})::INTEGER, 0) + coalesce((v2.direction = {way!r})::INTEGER, 0) + coalesce((v3.direction = {way!r})::INTEGER, 0))::INTEGER AS "Divergence_{way.title()}_Count"' for way in ("bull", "bear"))}, e.ord
        FROM entries e LEFT JOIN perf ON e.ticker = perf.symbol LEFT JOIN ({HIGHS}) h ON e.ticker = h.symbol LEFT JOIN ({LATEST}) l ON e.ticker = l.symbol LEFT JOIN ({SPREADS}) s ON e.ticker = s.symbol LEFT JOIN ({BANDS}) b ON e.ticker = b.symbol
          LEFT JOIN ({crossed("base", 250)}) d ON e.ticker = d.symbol LEFT JOIN ({crossed("weeks", 260)}) w ON e.ticker = w.symbol
          LEFT JOIN ({DIVERGENCES["RSI"]}) v1 ON e.ticker = v1.symbol LEFT JOIN ({DIVERGENCES["MACD"]}) v2 ON e.ticker = v2.symbol LEFT JOIN ({DIVERGENCES["ROC"]}) v3 ON e.ticker = v3.symbol""",
    "signals": f"""SELECT *, row_number() OVER ({BY}) - 1 AS k, lag(ts) OVER ({BY}) AS before, coalesce(roc12 > 20, false) AND ts <= DATE '1996-02-15' AS enters, coalesce(roc12 < -20, false) AS leaves
        FROM (SELECT symbol, ts, close, {change("close", f"lag(close, 12) OVER ({BY})")} AS roc12 FROM base) WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    "sim": """SELECT symbol, k, 10000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, 10000.0::DOUBLE AS equity, CASE WHEN enters THEN 'Buy' END AS ordered, NULL::VARCHAR AS done, NULL::DOUBLE AS traded, NULL::DOUBLE AS fee FROM signals WHERE k = 0
        UNION ALL SELECT symbol, k, cash, shares, cash + shares * close, CASE WHEN shares > 0 THEN CASE WHEN leaves THEN 'Sell' END WHEN enters THEN 'Buy' END, done, traded, fee FROM
          (SELECT s.symbol, s.k, s.close, s.enters, s.leaves, r.ordered AS done, CASE r.ordered WHEN 'Buy' THEN 0 WHEN 'Sell' THEN r.cash + r.shares * s.close * 0.9995 * 0.999 ELSE r.cash END AS cash,
             CASE r.ordered WHEN 'Buy' THEN r.cash / 1.001 / (s.close * 1.0005) WHEN 'Sell' THEN 0 ELSE r.shares END AS shares,
             CASE r.ordered WHEN 'Buy' THEN r.cash / 1.001 / (s.close * 1.0005) WHEN 'Sell' THEN r.shares END AS traded, CASE r.ordered WHEN 'Buy' THEN r.cash / 1.001 * 0.001 WHEN 'Sell' THEN r.shares * s.close * 0.9995 * 0.001 END AS fee
           FROM sim r JOIN signals s ON s.symbol = r.symbol AND s.k = r.k + 1)""",
    "run": "SELECT symbol AS series, ts AS date, equity FROM sim JOIN signals USING (symbol, k)",
    "curves": f"SELECT symbol AS series, ts AS date, 10000 * last_value(close IGNORE NULLS) OVER ({BY}) / first_value(close) OVER ({BY}) AS equity FROM bars",
    "texts": "SELECT o_orderdate, o_orderkey AS key, o_orderstatus, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE CAST(round(CAST(o_totalprice AS DECIMAL(18, 6)), 2) AS DOUBLE) END AS price FROM orders",
}


def headline(source: str) -> str:
    return f"""SELECT series, CASE WHEN days > 0 THEN ((last / first) ** (365.25 / days) - 1) * 100 END AS cagr_pct, worst * 100 AS max_drawdown_pct, mean * 100 AS avg_drawdown_pct, CASE WHEN n >= 3 AND sd > 0 THEN sqrt(252) * r / sd END AS sharpe
        FROM (SELECT series, arg_min(equity, date) AS first, arg_max(equity, date) AS last, max(date) - min(date) AS days, min(dd) AS worst, avg(dd) AS mean, avg(r) AS r, stddev_pop(r) AS sd, count(*) AS n
          FROM (SELECT *, equity / max(equity) OVER w - 1 AS dd, equity / lag(equity) OVER w - 1 - (1.02 ** (1 / 252.0) - 1) AS r FROM {source} WINDOW w AS (PARTITION BY series ORDER BY date)) GROUP BY 1)"""


DAY, WEEK, DIV = ("bars", "base"), ("bars", "allweeks", "weeks"), ("bars", "base", "num", "moved", "seeds", "rec", "lines", "dxs", "rec2", "ind")
ALL = ("bars", "base", "dated", "allweeks", "weeks", "entries", *DIV[2:], "perf", "metrics")
SIM, CURVES = (*DAY, "signals", "sim"), ("bars", "curves")
SCREENS = {
    ("rsi", "oversold"): '"RSI_14" < 30', ("rsi", "overbought"): '"RSI_14" > 70', ("rsi", "either"): '"RSI_14" < 30 OR "RSI_14" > 70',
    ("trend", "bull"): "\"SMA_Trend\" = 'bull'", ("trend", "bear"): "\"SMA_Trend\" = 'bear'", ("trend", "either"): '"SMA_Trend" IS NOT NULL',
    ("divergence", "bull2"): '"Divergence_Bull_Count" >= 2', ("divergence", "bull3"): '"Divergence_Bull_Count" = 3', ("divergence", "bear2"): '"Divergence_Bear_Count" >= 2', ("divergence", "bear3"): '"Divergence_Bear_Count" = 3',
    ("adx", "bull"): '"ADX_14" > 25 AND "DI_Plus_14" > "DI_Minus_14"', ("adx", "bear"): '"ADX_14" > 25 AND "DI_Plus_14" < "DI_Minus_14"',
    ("cross", "golden_d1"): '"GoldenCross_D1" = 1', ("cross", "death_d1"): '"DeathCross_D1" = 1', ("cross", "golden_w1"): '"GoldenCross_W1" = 1', ("cross", "death_w1"): '"DeathCross_W1" = 1',
    ("bands", "high"): '"BB_Position" >= 5', ("bands", "low"): '"BB_Position" <= -5',
}
FRAME7 = f"OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
#: Query to its pieces and its last SELECT.
BODIES = {
    "source_bars_orders": (("bars",), "SELECT * FROM bars"),
    "source_bars_lineitem": ((), bars("l_returnflag || '-' || l_linestatus", "CAST(l_shipdate AS DATE)", "l_extendedprice", "row(l_orderkey, l_linenumber, l_extendedprice)", "sum(l_quantity)", "lineitem")),
    "source_bars_events": ((), bars("event_type", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')", "value", "event_id", "count(*)", "events")),
    "source_bars_between": (("bars",), "SELECT * FROM bars WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    "universe_flattened": (("entries",), "SELECT * EXCLUDE (ord) FROM entries"),
    "universe_overlay": (("entries",), "SELECT list, \"group\", subgroup, ticker, ord FROM entries UNION ALL SELECT 'Saved', \"group\", subgroup, ticker, ord FROM entries WHERE \"group\" = 'ASIA'"),
    "universe_edited": (("entries",), """SELECT CASE WHEN ord % 7 <> 0 THEN "group" END AS "group", CASE WHEN ord % 7 <> 0 THEN subgroup END AS subgroup, CASE WHEN ord % 7 <> 0 THEN ticker END AS ticker, ord::BIGINT AS row,
        CASE WHEN ord % 7 = 0 THEN 'Row ' || ord || ': group, subgroup and ticker are needed.' END AS error FROM entries WHERE ord % 5 <> 0"""),
    "performance_horizons": ((*DAY, "dated"), PERFORMANCE),
    "below_highs": ((*DAY, "dated"), HIGHS),
    "top_performers": ((*DAY, "dated", "entries", "perf"), "SELECT list, \"group\", subgroup, ticker, ord::BIGINT AS ord, perf.* EXCLUDE (symbol) FROM entries LEFT JOIN perf ON ticker = symbol ORDER BY \"Perf_12M_%\" DESC NULLS LAST, ord LIMIT 5"),
    "weekly_complete": (WEEK, "SELECT * FROM weeks"),
    "weekly_partial": (WEEK[:2], "SELECT symbol, label AS ts, open, high, low, close, volume FROM allweeks WHERE close IS NOT NULL"),
    "weekly_strict": (WEEK[:2], "SELECT symbol, label AS ts, open, high, low, close FROM allweeks"),
    "monthly": (("bars", "months"), "SELECT symbol, label AS ts, open, high, low, close, volume FROM months"),
    "rolling_values": ((*DAY, "num", "moved"), f"""SELECT symbol, ts, close, m AS bb_mid, m + 2 * sd AS bb_upper, m - 2 * sd AS bb_lower, sma200, std20, roc12, true_range, dm_plus, dm_minus, up FROM
        (SELECT symbol, ts, close, {mean("close", 50)} AS m, {deviation("close", 50)} AS sd, {mean("close", 200)} AS sma200, {deviation("close", 20, 5)} AS std20, {change("close", f"lag(close, 12) OVER ({BY})")} AS roc12, tr AS true_range, up::DOUBLE AS dm_plus, down::DOUBLE AS dm_minus, pc IS NULL OR close >= pc AS up FROM moved)"""),
    "price_vs_averages": (DAY, f"SELECT symbol, ts, close, sma50, sma200, {', '.join(f'{change(p, f"sma{n}")} AS {p}_vs_ma{n}' for p in ('high', 'low') for n in (50, 200))}, {change('close', 'sma200')} AS close_vs_ma200 FROM (SELECT *, {mean('close', 50)} AS sma50, {mean('close', 200)} AS sma200 FROM base)"),
    "spread_statistics": ((*DAY, "dated"), SPREADS),
    "crossovers": (("bars", "base", *WEEK[1:]), f"SELECT *, 'day' AS frame FROM ({crossed('base', 250)}) UNION ALL SELECT *, 'week' FROM ({crossed('weeks', 260)})"),
    "band_position": (WEEK, BANDS),
    "recursive_indicators": (DIV, "SELECT symbol, ts, ewm12, wilder14, rsi_screen, rsi_tester, macd_screen, macd_tester, adx, di_plus, di_minus FROM ind"),
    "pivot_flags": (DAY, f"SELECT symbol, ts, {', '.join(f'count({c}) {FRAME7} = 7 AND {c} = {s}({c}) {FRAME7} AS plain_{c}, {unique_pivot(c, s)} AS unique_{c}' for c, s in (('low', 'min'), ('high', 'max')))} FROM (SELECT *, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM base)"),
    "matched_pivots": (DIV, f"SELECT symbol, i, p, v, t_ind FROM ({matched('low', 'roc12', 'min')})"),
    "scored_divergence_rsi": (DIV, DIVERGENCES["RSI"]),
    "scored_divergence_macd": (DIV, DIVERGENCES["MACD"]),
    "scored_divergence_roc": (DIV, DIVERGENCES["ROC"]),
    "boolean_divergence": (DIV, f"SELECT symbol, ts, a.hit AS bull, b.hit AS bear, a.known AS bull_known FROM (SELECT *, coalesce(lag(hit, 3) OVER ({BY}), false) AS known FROM ({apart('min', '<', '>')})) a JOIN ({apart('max', '>', '<')}) b USING (symbol, ts) WHERE a.hit OR b.hit OR a.known"),
    "latest_indicators": (DIV, LATEST),
    "metrics_table": (ALL, "SELECT * EXCLUDE (ord) FROM metrics"),
    "screen_counts": (ALL, " UNION ALL ".join(f"SELECT '{f}' AS filter, '{c}' AS choice, count(*) FILTER ({x}) AS n FROM metrics" for (f, c), x in SCREENS.items())),
    "screened_top": (ALL, 'SELECT "Group", "Subgroup", "Ticker", "Perf_1M_%", "SMA_Trend" FROM metrics WHERE "Group" = \'ASIA\' AND "SMA_Trend" IS NOT NULL AND "Perf_1M_%" IS NOT NULL ORDER BY "Perf_1M_%" DESC, ord LIMIT 5'),
    "screen_options": (("entries",), "SELECT DISTINCT subgroup AS \"Subgroup\" FROM entries WHERE \"group\" = 'EUROPE'"),
    "rule_signals": (DAY, f"SELECT symbol, ts, coalesce(roc12 >= 5 AND ts >= DATE '1997-01-01' AND close < 250000 AND ts <= DATE '1999-12-31', false) AS hit, false AS never FROM (SELECT *, {change('close', f'lag(close, 12) OVER ({BY})')} AS roc12 FROM base)"),
    "backtest_equity": ((*SIM, "run"), "SELECT * FROM run"),
    "backtest_trades": (SIM, """SELECT symbol AS strategy_id, ts AS date, before AS signal_date, done AS action, 'close' AS ticker, price, traded AS shares, fee AS commission,
        CASE done WHEN 'Buy' THEN 'Enter signal: all active enter conditions matched (r1: roc12 > 20.00)' ELSE 'Exit signal: all active exit conditions matched (r1: roc12 < -20.00)' END AS reason, price * traded AS gross_value
        FROM (SELECT *, close * CASE done WHEN 'Buy' THEN 1.0005 ELSE 0.9995 END AS price FROM sim JOIN signals USING (symbol, k) WHERE done IS NOT NULL)"""),
    "backtest_headline": ((*SIM, "run"), headline("run")),
    "benchmark_curves": (CURVES, "SELECT * FROM curves"),
    "curve_drawdown": (CURVES, "SELECT *, equity / max(equity) OVER (PARTITION BY series ORDER BY date) - 1 AS drawdown FROM curves"),
    "curve_headline": (CURVES, headline("curves")),
    "curve_yearly": (CURVES, """SELECT series, y::INTEGER AS year, (last / first - 1) * 100 AS performance_pct, worst * 100 AS max_drawdown_pct, CASE WHEN e > s THEN ((last / b) ** (365.25 / (e - s)) - 1) * 100 END AS cumulative_cagr_pct
        FROM (SELECT series, y, arg_min(equity, date) AS first, arg_max(equity, date) AS last, min(dd) AS worst, max(date) AS e, any_value(s) AS s, any_value(b) AS b FROM
          (SELECT *, year(date) AS y, equity / max(equity) OVER (PARTITION BY series, year(date) ORDER BY date) - 1 AS dd, min(date) OVER (PARTITION BY series) AS s, first_value(equity) OVER (PARTITION BY series ORDER BY date) AS b FROM curves) GROUP BY 1, 2)"""),
    "weekly_equity": (CURVES, f"SELECT *, equity / max(equity) OVER (PARTITION BY series ORDER BY week) - 1 AS drawdown FROM (SELECT series, {FRIDAY.replace('ts', 'date')} AS week, arg_max(equity, date) AS equity FROM curves GROUP BY 1, 2)"),
    "joined_dataset": (("bars",), f"""SELECT u.ts AS date, {', '.join(f'{a}.{c} AS "{p}_{c.title()}"' for a, p in (('u', 'Underlying'), ('t', 'Traded')) for c in ('open', 'high', 'low', 'close'))}, b.close AS "BMK_LOW_Close"
        FROM bars u JOIN bars t ON u.ts = t.ts AND u.symbol = '1-URGENT' AND t.symbol = '2-HIGH' LEFT JOIN bars b ON b.ts = u.ts AND b.symbol = '5-LOW' AND day(b.ts) > 3"""),
    "warm_start": (DAY, f"SELECT symbol, min(ts) FILTER (i >= 199) AS start FROM (SELECT *, row_number() OVER ({BY}) - 1 AS i FROM base) GROUP BY 1"),
    "upload_profile": (("texts",), """SELECT 'day' AS "column", avg((o_orderdate IS NOT NULL)::INTEGER) AS date_share, 0.0::DOUBLE AS number_share FROM texts UNION ALL SELECT 'price', 0.0, avg((price IS NOT NULL)::INTEGER) FROM texts UNION ALL SELECT 'status', 0.0, 0.0"""),
    "upload_numbers": (("texts",), "SELECT key, price FROM texts"),
    "upload_series": (("texts",), "SELECT CAST(o_orderdate AS DATE) AS date, min(key) AS key FROM texts GROUP BY 1"),
    "records": (("bars", "months"), """SELECT '{"symbol":"' || symbol || '","ts":"' || label || '","note":null}' AS record FROM months"""),
    "candles_daily": (("bars",), candle("bars", "ts")),
    "candles_weekly": (WEEK[:2], candle("allweeks", "label")),
    "candles_monthly": (("bars", "months"), candle("months", "label")),
    "value_range": (DAY, "SELECT symbol, a - 0.05 * (b - a) AS low, b + 0.05 * (b - a) AS high FROM (SELECT symbol, min(least(open, high, low, close)) AS a, max(greatest(open, high, low, close)) AS b FROM base GROUP BY 1)"),
    "color_scale": ((*DAY, "dated", "entries", "perf"), """SELECT subgroup, ticker AS "Ticker", (v - min(CASE WHEN ticker <> '5-LOW' THEN v END) OVER ()) / nullif(max(CASE WHEN ticker <> '5-LOW' THEN v END) OVER () - min(CASE WHEN ticker <> '5-LOW' THEN v END) OVER (), 0) AS place FROM (SELECT *, "Perf_1M_%" AS v FROM entries LEFT JOIN perf ON ticker = symbol)"""),
}


#: Queries over whole tables: the windowed ones' SQL without its limits.
PIECES["signals_whole"] = PIECES["signals"].replace(" AND ts <= DATE '1996-02-15'", "").replace(" WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'", "")
PIECES |= {f"{p}_whole": PIECES[p].replace("signals", "signals_whole").replace("FROM sim", "FROM sim_whole") for p in ("sim", "run")}
WHOLE = (*DAY, "signals_whole", "sim_whole")
BODIES |= {
    "backtest_equity_whole": ((*WHOLE, "run_whole"), f"SELECT series, date, {digits('equity')} AS equity FROM run_whole"),
    "backtest_trades_whole": (WHOLE, f"SELECT * REPLACE ({', '.join(f'{digits(c)} AS {c}' for c in ('price', 'shares', 'commission', 'gross_value'))}) FROM ({BODIES['backtest_trades'][1].replace('FROM sim JOIN signals', 'FROM sim_whole JOIN signals_whole')})"),
    "backtest_headline_whole": ((*WHOLE, "run_whole"), headline("run_whole")),
    "joined_dataset_whole": (("bars",), BODIES["joined_dataset"][1].replace(" AND day(b.ts) > 3", "")),
}


def recursions(name: str, source: str) -> dict[str, str]:
    """Pieces that end in ``<name>_ind``: RSI and MACD of both conventions and ROC of a source ``symbol, ts, close``."""
    return {
        f"{name}_num": f"SELECT *, row_number() OVER ({BY}) - 1 AS i, lag(close) OVER ({BY}) AS pc, lag(close, 12) OVER ({BY}) AS c12 FROM {source}",
        f"{name}_rec": f"""SELECT symbol, i, close AS e12, close AS e26, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss, NULL::DOUBLE AS gain_t, NULL::DOUBLE AS loss_t FROM {name}_num WHERE i = 0
        UNION ALL SELECT s.symbol, s.i, r.e12 * 11 / 13 + s.close * 2 / 13, r.e26 * 25 / 27 + s.close * 2 / 27,
          r.gain * 13 / 14 + greatest(s.close - s.pc, 0) / 14, r.loss * 13 / 14 + greatest(s.pc - s.close, 0) / 14,
          coalesce(r.gain_t * 13 / 14 + greatest(s.close - s.pc, 0) / 14, greatest(s.close - s.pc, 0)), coalesce(r.loss_t * 13 / 14 + greatest(s.pc - s.close, 0) / 14, greatest(s.pc - s.close, 0))
        FROM {name}_rec r JOIN {name}_num s ON s.symbol = r.symbol AND s.i = r.i + 1""",
        f"{name}_rec2": f"""SELECT symbol, i, e12 - e26 AS sig_t, NULL::DOUBLE AS sig FROM {name}_rec WHERE i = 0
        UNION ALL SELECT s.symbol, s.i, r.sig_t * 8 / 10 + (s.e12 - s.e26) * 2 / 10, CASE WHEN s.i = 25 THEN s.e12 - s.e26 ELSE r.sig * 8 / 10 + (s.e12 - s.e26) * 2 / 10 END
        FROM {name}_rec2 r JOIN {name}_rec s ON s.symbol = r.symbol AND s.i = r.i + 1""",
        f"{name}_ind": f"""SELECT n.* EXCLUDE (pc, c12), CASE WHEN n.i >= 13 THEN CASE WHEN x.loss = 0 THEN 100 ELSE 100 - 100 / (1 + x.gain / x.loss) END END AS rsi_screen, 100 - 100 / (1 + x.gain_t / nullif(x.loss_t, 0)) AS rsi_tester,
          CASE WHEN n.i >= 33 THEN x.e12 - x.e26 - y.sig END AS macd_screen, x.e12 - x.e26 - y.sig_t AS macd_tester, {change("n.close", "n.c12")} AS roc12
        FROM {name}_num n JOIN {name}_rec x ON n.symbol = x.symbol AND n.i = x.i JOIN {name}_rec2 y ON n.symbol = y.symbol AND n.i = y.i""",
    }


def live(source: str, label: str) -> str:
    """Both instruments of the live dataset, on days that both have."""
    prices = ", ".join(f'{a}.{c} AS "{p}_{c.title()}"' for a, p in (("u", "Underlying"), ("t", "Traded")) for c in ("open", "high", "low", "close"))
    whole = " AND ".join(f"{a}.{c} IS NOT NULL" for a in "ut" for c in ("open", "high", "low", "close"))
    return f"""SELECT 'pair' AS symbol, u.{label} AS ts, u.close AS close, {prices}, b.close AS "BMK_5-LOW_Close" FROM {source} u JOIN {source} t ON u.{label} = t.{label} AND u.symbol = '1-URGENT' AND t.symbol = '2-HIGH' AND {whole}
        LEFT JOIN {source} b ON b.{label} = u.{label} AND b.symbol = '5-LOW'"""


def live_body(name: str) -> str:
    averages = ", ".join(f'{change(f"""\"Underlying_{c}\"""", f"""\"SMA{n}\"""")} AS "{c} vs MA{n}"' for c in ("High", "Low") for n in (50, 200))
    return f"""SELECT * EXCLUDE (symbol, ts, close, i, rsi_screen, macd_screen, rsi_tester, macd_tester, roc12), ts AS date, {averages}, rsi_tester AS "RSI", macd_tester AS "MACD", roc12 AS "ROC"
        FROM (SELECT *, {mean("close", 50)} AS "SMA50", {mean("close", 200)} AS "SMA200" FROM {name}_ind)"""


def simulated(name: str, source: str) -> dict[str, str]:
    """Pieces ``<name>_sim`` and ``<name>_signals`` of a source ``symbol, ts, close, enters, leaves``."""
    return {
        f"{name}_signals": f"SELECT *, row_number() OVER ({BY}) - 1 AS k, lag(ts) OVER ({BY}) AS before FROM ({source})",
        f"{name}_sim": PIECES["sim"].replace("FROM sim", f"FROM {name}_sim").replace("signals", f"{name}_signals"),
        f"{name}_run": f"SELECT symbol AS series, ts AS date, equity FROM {name}_sim JOIN {name}_signals USING (symbol, k)",
    }


def traded(name: str, ticker: str) -> str:
    return f"""SELECT symbol AS strategy_id, ts AS date, before AS signal_date, done AS action, '{ticker}' AS ticker, price, traded AS shares, fee AS commission, price * traded AS gross_value
        FROM (SELECT *, close * CASE done WHEN 'Buy' THEN 1.0005 ELSE 0.9995 END AS price FROM {name}_sim JOIN {name}_signals USING (symbol, k) WHERE done IS NOT NULL)"""


PIECES |= {"pair": live("bars", "ts"), "wpair": live("allweeks", "label")} | recursions("pair", "pair") | recursions("wpair", "wpair")
PIECES["ready"] = f'SELECT * FROM (SELECT *, min(CASE WHEN i >= 199 AND "Traded_Close" IS NOT NULL THEN ts END) OVER () AS first FROM pair_ind) WHERE ts >= first'
PIECES |= simulated("live", """SELECT 'Strategy' AS symbol, ts, "Traded_Close" AS close, coalesce(roc12 > 20, false) AS enters, coalesce(roc12 < -20, false) AS leaves FROM ready""")
PIECES["live_curves"] = f"""SELECT * FROM live_run UNION ALL SELECT 'BMK_5-LOW_Close', ts, 10000 * last_value("BMK_5-LOW_Close" IGNORE NULLS) OVER (ORDER BY ts) / first_value("BMK_5-LOW_Close") OVER (ORDER BY ts) FROM ready"""
PIECES |= simulated("div", f"SELECT symbol, ts, close, a.hit AS enters, b.hit AS leaves FROM base JOIN ({apart('min', '<', '>')}) a USING (symbol, ts) JOIN ({apart('max', '>', '<')}) b USING (symbol, ts)")
PIECES["visible"] = f"SELECT symbol, ts, close, sma200 FROM (SELECT symbol, ts, close, {mean('close', 200)} AS sma200, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE n >= 20 AND nth <= 150"
PIECES |= recursions("visible", "visible")
own = lambda name: tuple(recursions(name, name))
PAIR = ("bars", "pair", *own("pair"))
LIVE = (*PAIR, "ready", "live_signals", "live_sim", "live_run", "live_curves")
BODIES |= {
    "live_dataset": (PAIR, live_body("pair")),
    "live_dataset_weekly": (("bars", "allweeks", "wpair", *own("wpair")), live_body("wpair")),
    "live_ready_part": ((*PAIR, "ready"), f'SELECT ts AS date, "Underlying_Close", "SMA200" FROM (SELECT *, {mean("close", 200)} AS "SMA200" FROM pair_ind) WHERE ts >= (SELECT min(first) FROM ready)'),
    "auto_start": (("bars", "pair"), "SELECT coalesce((SELECT ts FROM pair WHERE ts BETWEEN DATE '1986-06-30' AND DATE '2001-06-30' ORDER BY ts LIMIT 1 OFFSET 199), DATE '1996-06-30') AS start"),
    "live_run_curves": (LIVE, "SELECT * FROM live_curves"),
    "live_run_trades": (LIVE, traded("live", "Traded_Close")),
    "live_run_headline": (LIVE, headline("live_curves")),
    "live_run_yearly": (LIVE, BODIES["curve_yearly"][1].replace("FROM curves", "FROM live_run")),
    "equity_export": (CURVES, "SELECT date, round_even(max(equity) FILTER (series = '1-URGENT'), 2) AS \"1-URGENT\", round_even(max(equity) FILTER (series = '2-HIGH'), 2) AS \"2-HIGH\" FROM curves GROUP BY 1"),
    "display_text": ((*DAY, "dated", "perf"), 'SELECT symbol, coalesce(printf(\'%.2f\', round_even("Perf_1M_%", 2)), \'\') AS "Perf_1M_%", coalesce(printf(\'%.2f\', round_even("Perf_10Y_%", 2)), \'\') AS "Perf_10Y_%" FROM perf'),
    "backtest_divergence_trades": ((*DIV, "div_signals", "div_sim"), traded("div", "close")),
    "candle_oscillators": (("bars", "visible", *own("visible")), f"SELECT symbol, ts, rsi_screen AS rsi, macd_screen AS macd_hist, roc12, CASE WHEN sma200 > 0 THEN {change('close', 'sma200')} END AS ppo200, CASE WHEN macd_screen >= 0 THEN 'pos' ELSE 'neg' END AS macd_sign FROM visible_ind"),
    "top_flows": (("entries",), 'SELECT "group" AS "Group", subgroup AS "Subgroup", ticker AS "Ticker", NULL::DOUBLE AS "FundFlows_3M_%" FROM entries WHERE false'),
    "top_flows_flag": ((), "SELECT true AS flow_unavailable"),
    "chart_frame": (("entries",), "SELECT list AS \"List\", ticker || ' (' || subgroup || ')' AS \"TickerAxis\", CAST(row_number() OVER (PARTITION BY list ORDER BY ord) - 1 AS INTEGER) AS \"Order\" FROM entries"),
    "ticker_subgroups": (("entries",), "SELECT ticker, arg_min(subgroup, ord) AS subgroup FROM entries GROUP BY 1"),
    "kept_order": (("entries",), "SELECT subgroup, ticker, CASE WHEN \"group\" = 'ASIA' THEN -ord::BIGINT END AS position FROM entries"),
    "saved_dates": ((), "SELECT o_orderkey AS key, greatest(DATE '1995-06-01', least(DATE '2000-06-30', CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '1996-01-01' END)) AS date FROM orders"),
    "strategy_settings": ((), "SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 100.0 ELSE 10000.0 END AS initial_deposit, 0.0 AS risk_free, CASE WHEN n_nationkey % 2 = 0 THEN 0.1 ELSE 0.0 END AS commission_pct, 0.0 AS slippage_pct, 3 AS divergence_pivot_window, 60 AS divergence_lookback FROM nation"),
    "repeated_dates": ((), "SELECT count(*) - count(DISTINCT CAST(o_orderdate AS DATE)) AS repeated FROM orders"),
}

#: Hourly bars of each event type and of all events; a level with gaps as pandas has it: what is missing lowers the weight of what was.
PIECES["hours"] = " UNION ALL ".join(bars(symbol, "date_trunc('hour', ts)", "value", "event_id", "count(*)", "events") for symbol in ("event_type", "'ALL'"))
PIECES["gaps"] = f"SELECT *, avg(high) OVER ({BY} ROWS 13 PRECEDING) AS seed, row_number() OVER ({BY}) - 1 AS i, count(there) OVER ({BY}) AS seen FROM (SELECT *, CASE WHEN hour(ts) % 7 <> 3 THEN close END AS there FROM hours)"
PIECES["hourly"] = """SELECT symbol, i, there AS level, 1.0::DOUBLE AS weight, NULL::DOUBLE AS wil FROM gaps WHERE i = 0
        UNION ALL SELECT s.symbol, s.i, CASE WHEN s.there IS NULL THEN r.level WHEN r.level IS NULL THEN s.there ELSE (r.weight * 11 / 13 * r.level + s.there * 2 / 13) / (r.weight * 11 / 13 + 2.0 / 13) END,
          CASE WHEN s.there IS NOT NULL OR r.level IS NULL THEN 1 ELSE r.weight * 11 / 13 END, CASE WHEN s.i = 13 THEN s.seed ELSE r.wil + (s.high - r.wil) / 14 END
        FROM hourly r JOIN gaps s ON s.symbol = r.symbol AND s.i = r.i + 1"""
BODIES["recursive_indicators_stream"] = BODIES["recursive_indicators"]
BODIES["hourly_recursions"] = (("hours", "gaps", "hourly"), "SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, high, there AS close, level AS ewm12, CASE WHEN seen >= 12 THEN level END AS ewm12_warm, wil AS wilder14 FROM gaps JOIN hourly USING (symbol, i)")
#: A strategy for each nation, its rules written out.
PIECES["plans"] = """SELECT n_name AS strategy_id, n_nationkey AS k, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + n_nationkey % 5] AS instrument, 10.0 + n_nationkey % 4 * 5 AS level,
        1000.0::DOUBLE * (n_nationkey + 1) AS deposit, CASE WHEN n_nationkey % 2 = 0 THEN 0.001 ELSE 0 END::DOUBLE AS cost, CASE WHEN n_nationkey % 3 = 0 THEN 0.0005 ELSE 0 END::DOUBLE AS slip,
        CASE WHEN n_nationkey % 5 = 0 THEN DATE '1996-01-01' ELSE DATE '1992-01-01' END AS start, CASE WHEN n_nationkey % 5 = 0 THEN DATE '2000-12-31' ELSE DATE '2010-12-31' END AS finish FROM nation"""
PIECES["planned"] = f"""SELECT *, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM
        (SELECT strategy_id AS symbol, ts, close, roc12, k, level, deposit, cost, slip FROM plans JOIN (SELECT symbol, ts, close, {change("close", f"lag(close, 12) OVER ({BY})")} AS roc12 FROM base) b ON b.symbol = instrument AND ts BETWEEN start AND finish WHERE k % 7 <> 6)"""
PIECES["planned_bulls"] = apart("min", "<", ">").replace("(SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM ind)", "planned")
_every = simulated("every", """SELECT symbol, ts, close, deposit, cost, slip, coalesce(CASE WHEN k % 6 = 5 THEN hit ELSE roc12 > level END, false) AND (k % 3 <> 0 OR close < 300000 AND ts >= DATE '1996-01-01') AS enters, coalesce(roc12 < -level, false) AS leaves FROM planned JOIN planned_bulls USING (symbol, ts)""")
for _plain, _own in (("10000.0::DOUBLE", "deposit"), ("0.9995 * 0.999 ", "(1 - slip) * (1 - cost) "), ("* 0.9995 * 0.001", "* (1 - slip) * cost"), ("/ 1.001 * 0.001", "/ (1 + cost) * cost"), ("1.001", "(1 + cost)"), ("1.0005", "(1 + slip)"), ("s.enters, s.leaves,", "s.enters, s.leaves, s.cost, s.slip,")):
    _every["every_sim"] = _every["every_sim"].replace(_plain, _own)
PIECES |= _every
EVERY = (*DAY, "plans", "planned", "planned_bulls", "every_signals", "every_sim")
_TOLD = "CASE done WHEN 'Buy' THEN 'Enter signal: all active enter conditions matched (r1: roc12 ' || CASE WHEN k_ % 6 = 5 THEN 'bull divergence' ELSE printf('> %.2f', level) END || CASE WHEN k_ % 3 = 0 THEN '; r2: close < 300000.00' ELSE '' END || ')' ELSE printf('Exit signal: all active exit conditions matched (r1: roc12 < %.2f)', -level) END"
BODIES |= {
    "strategies_trades": (EVERY, f"""SELECT symbol AS strategy_id, ts AS date, before AS signal_date, done AS action, 'close' AS ticker, CAST(round(CAST(price AS DECIMAL(30, 6)), 4) AS DOUBLE) AS price, {digits('traded')} AS shares, {digits('fee')} AS commission, {_TOLD} AS reason, {digits('price * traded')} AS gross_value
        FROM (SELECT e.*, done, traded, fee, p.level, p.k AS k_, close * CASE done WHEN 'Buy' THEN 1 + e.slip ELSE 1 - e.slip END AS price FROM every_sim s JOIN every_signals e ON s.symbol = e.symbol AND s.k = e.k JOIN plans p ON p.strategy_id = e.symbol WHERE done IS NOT NULL)"""),
    "strategies_headline": ((*EVERY, "every_run"), headline("every_run").replace(" - (1.02 ** (1 / 252.0) - 1)", "")),
    "strategies_problems": ((), "SELECT n_name AS strategy_id, CASE WHEN n_nationkey % 7 = 6 THEN 'no active exit rule' END AS problem FROM nation"),
}
BODIES |= {
    "metrics_refreshed": BODIES["metrics_table"],
    "landed_bars": (("bars",), """SELECT symbol, ts, close, 'adjusted' AS kind FROM bars WHERE ts BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND (symbol NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR ts >= DATE '1998-01-01')
        UNION ALL SELECT symbol, ts, close * 2, 'unadjusted' FROM bars WHERE symbol IN ('1-URGENT', '2-HIGH')"""),
    "upload_counts": ((), """WITH whole AS (SELECT * FROM orders WHERE o_orderkey % 13 <> 0) SELECT 'lines' AS what, count(*) AS n FROM orders UNION ALL SELECT 'left_out', count(*) FROM orders WHERE o_orderkey % 13 = 0
        UNION ALL SELECT 'lost_prices', count(*) FROM whole WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'repeated_days', count(*) - count(DISTINCT CAST(o_orderdate AS DATE)) FROM whole"""),
    "saved_values": ((), """WITH placed AS (SELECT *, c_nationkey || '/' || (c_custkey // 1250) AS name, CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1250 ORDER BY c_custkey) - 1 AS INTEGER) AS row FROM customer WHERE c_nationkey <> 5)
        SELECT name, row, 'key' AS column, NULL AS text, c_custkey::DOUBLE AS number FROM placed UNION ALL SELECT name, row, 'segment', c_mktsegment, NULL FROM placed WHERE c_custkey % 2 = 0 UNION ALL SELECT name, row, 'balance', NULL, c_acctbal FROM placed WHERE c_nationkey % 3 = 1"""),
}
PIECES["flows"] = f"SELECT {TICKER.replace('n_nationkey', 'c_nationkey')} AS ticker, avg(CAST(c_acctbal AS DECIMAL(18, 2))) AS flow3, min(c_acctbal) AS flow1 FROM customer GROUP BY 1 HAVING ticker <> '3-MEDIUM'"
BODIES |= {
    "top_flows_known": (("entries", "flows"), 'SELECT "group" AS "Group", subgroup AS "Subgroup", ticker AS "Ticker", flow3 AS "FundFlows_3M_%" FROM entries JOIN flows USING (ticker) ORDER BY flow3 DESC, ord LIMIT 5'),
    "top_flows_known_flag": ((), "SELECT false AS flow_unavailable"),
    "chart_bars": (("entries", "flows"), """SELECT CAST(ord_ AS INTEGER) AS "Order", ticker || ' (' || subgroup || ')' AS "TickerAxis", ticker AS "Ticker", "group" AS "Group", subgroup AS "Subgroup", flow3 AS "FundFlows_3M_%", flow1 AS "FundFlows_1M_%"
        FROM (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS ord_ FROM entries) JOIN flows USING (ticker) WHERE ord % 4 <> 1"""),
}
BODIES["parted_changes"] = (DIV, f"""SELECT symbol, ts, CASE WHEN roc12 < -1 AND d > 1 THEN 'bull' WHEN roc12 > 1 AND d < -1 THEN 'bear' WHEN roc12 IS NOT NULL AND d IS NOT NULL THEN 'nothing' END AS direction
        FROM (SELECT symbol, ts, roc12, rsi_screen - lag(rsi_screen, 12) OVER ({BY}) AS d FROM ind)""")

#: Columns that aren't doubles, and queries that have no others.
KEYS = (
    "symbol", "ts", "kind", "row", "text", "Order", "TickerAxis", "label", "list", "group", "subgroup", "ticker", "ord", "List", "Group", "Subgroup", "Ticker", "SMA_Trend", "BB_Position", "GoldenCross_D1", "DeathCross_D1", "GoldenCross_W1", "DeathCross_W1",
    "Div_6M_vs_RSI", "Div_6M_vs_MACD", "Div_6M_vs_ROC", "Divergence_Bull_Count", "Divergence_Bear_Count", "up", "i", "t_ind", "direction", "type", "series", "date", "week", "year", "strategy_id", "signal_date", "action", "reason", "column", "key", "start", "macd_sign", "name", "divergence_pivot_window", "divergence_lookback",
)
WITHOUT_DOUBLES = ("parted_changes", "top_flows_known_flag", "upload_counts", "strategies_problems", "strategies_trades", "universe_flattened", "universe_overlay", "universe_edited", "crossovers", "pivot_flags", "boolean_divergence", "screen_counts", "screen_options", "rule_signals", "warm_start", "upload_series", "records", "auto_start", "display_text", "top_flows", "top_flows_flag", "chart_frame", "ticker_subgroups", "kept_order", "saved_dates", "repeated_dates")


def _whole(name: str) -> str:
    pieces, body = BODIES[name]
    whole = f"WITH RECURSIVE {', '.join(f'{p} AS ({PIECES[p]})' for p in pieces)} {body}" if pieces else body
    if name in (*WITHOUT_DOUBLES, "backtest_equity_whole", "backtest_trades_whole"):
        return whole
    keys = ", ".join(f"'{k}'" for k in KEYS)
    return f"SELECT COLUMNS(lambda c: c IN ({keys})), CAST(round(CAST(COLUMNS(lambda c: c NOT IN ({keys})) AS DECIMAL(30, 6)), 4) AS DOUBLE) FROM ({whole}) AS result"


#: As in ``queries.WINDOWED``.
WINDOWED = {f"backtest_{x}": f"backtest_{x}_1996_2000" for x in ("equity", "trades", "headline")} | {"joined_dataset": "joined_dataset_from_day_4"}
ORACLE_SQL = {WINDOWED.get(name, name): _whole(name) for name in BODIES}
