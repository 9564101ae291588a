"""Saved strategies: one JSON document with a strategy for each name, and the settings that a strategy stands for.

A store is configuration, of some kilobytes, and read and written by the driver; what it holds can
be looked at as a table too (``settings``).
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from datetime import UTC, date, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.rules import COMPARISONS, DIVERGENCES, INDICATORS
from barloom.sources.sinks import two_places
from barloom.sources.uploads import as_records

#: What a setting is where a strategy doesn't say, and how many rules and benchmarks a strategy has.
DEFAULTS = {"initial_deposit": 10000.0, "risk_free": 0.0, "commission_pct": 0.0, "slippage_pct": 0.0, "divergence_pivot_window": 3, "divergence_lookback": 60}
RULES, BENCHMARKS = 5, 3


def load(path: str) -> dict[str, dict]:
    """The store's strategies by name; none where there is no file yet, or one that holds something else."""
    try:
        text = Path(path).read_text(encoding="utf-8")
        store = json.loads(text)
    except (FileNotFoundError, ValueError):
        store = None
    return store if type(store) is dict else {}


def save(store: Mapping[str, Mapping], path: str) -> None:
    """Whole or not at all: the file is replaced once it's complete."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(store, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.new", path)


def put(path: str, name: str, strategy: Mapping) -> None:
    """Adds a strategy or replaces the one of this name."""
    if not name.strip():
        raise ValueError("a strategy needs a name")
    save(load(path) | {name.strip(): dict(strategy)}, path)


def delete(path: str, name: str) -> bool:
    """Whether there was such a strategy."""
    store = load(path)
    found = store.pop(name, None) is not None
    if found:
        save(store, path)
    return found


def saved_date(text: Column, fallback: Column, low: Column, high: Column) -> Column:
    """A saved ISO date, or ``fallback`` if it can't be read, within [low, high]."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))
    return F.greatest(low, F.least(high, F.coalesce(day, fallback)))


def settings(strategies: DataFrame, column: str = "strategy") -> DataFrame:
    """``strategies`` with the settings of each JSON text as columns, defaults where they aren't given."""
    value = lambda name: F.get_json_object(column, f"$.configuration.settings.{name}")
    return strategies.select(*(c for c in strategies.columns if c != column), *(F.coalesce(value(n).try_cast("double").cast(kind), F.lit(d)).alias(n) for n, d in DEFAULTS.items() for kind in ("int" if isinstance(d, int) else "double",)))


#: What a rule's field is where it is missing, or (for the first two) where it holds something that isn't offered. ``use`` depends on the rule's number.
RULE_DEFAULTS = {"condition": "=", "variable": None, "ticker_source": "Underlying", "input_value": 0.0, "start_date": None, "end_date": None}
SIDES = ("enter", "exit")
RULE = "struct<use: boolean, variable: string, ticker_source: string, condition: string, input_value: string, start_date: string, end_date: string>"
CONFIGURATION = f"struct<enter_ticker: string, exit_ticker: string, global_start_date: string, global_end_date: string, live_underlying: string, live_traded: string, enter_rows: array<{RULE}>, exit_rows: array<{RULE}>>"


def configured(strategies: DataFrame, low: Column, high: Column, variables: Sequence[str] = INDICATORS, column: str = "strategy") -> DataFrame:
    """``strategies`` with their settings, tickers, ``start`` and ``end``, and the rules in use of each side as arrays of structs, in place of the JSON text.

    A rule that doesn't say whether it is in use is so if it is its side's first; unknown conditions are "=", unknown
    variables the first of ``variables``, values that are no numbers 0. Dates that can't be read are ``low`` or ``high``; all lie within these. Rules beyond RULES don't count.
    Text that isn't such a document has no rules.
    """
    said = settings(strategies.withColumn("_said", F.from_json(F.get_json_object(column, "$.configuration"), CONFIGURATION)), column)
    offered = [*COMPARISONS, *DIVERGENCES]

    def rules(side: str) -> Column:
        def clean(rule: Column, place: Column) -> Column:
            known = lambda field, some, other: F.when(rule[field].isin(list(some)), rule[field]).otherwise(F.lit(other))
            return F.struct(
                F.coalesce(rule["use"], place == 0).alias("use"), (place + 1).alias("row_id"), known("variable", variables, variables[0]).alias("variable"), known("condition", offered, RULE_DEFAULTS["condition"]).alias("condition"),
                F.coalesce(rule["input_value"].try_cast("double"), F.lit(RULE_DEFAULTS["input_value"])).alias("value"),
                saved_date(rule["start_date"], low, low, high).alias("start"), saved_date(rule["end_date"], high, low, high).alias("end"),
            )

        rows = F.slice(F.coalesce(F.col(f"_said.{side}_rows"), F.expr(f"array()::array<{RULE}>")), 1, RULES)
        return F.filter(F.transform(rows, clean), lambda r: r["use"])

    dates = {"start": saved_date(F.col("_said.global_start_date"), low, low, high), "end": saved_date(F.col("_said.global_end_date"), high, low, high)}
    names = [f"_said.{c}" for c in ("enter_ticker", "exit_ticker", "live_underlying", "live_traded")]
    return said.select(*(c for c in said.columns if c != "_said"), *names, *(v.alias(n) for n, v in dates.items()), *(rules(side).alias(side) for side in SIDES))


def rule_row(row: Mapping, number: int, columns: Sequence[str], first: date | None = None, last: date | None = None) -> dict:
    """A saved rule as a form shows it: each field that is missing or isn't offered gets its default, dates that can't be read the first or last day, and all dates lie within these (without limits they stay as they are)."""
    offered = {"variable": columns, "condition": (*COMPARISONS, *DIVERGENCES)}
    shown = {"use": bool(row.get("use", number == 1)), "row_id": number}
    for field, default in (RULE_DEFAULTS | {"variable": columns[0]}).items():
        value = row.get(field)
        shown[field] = default if value is None or value not in offered.get(field, (value,)) else value
    shown["input_value"] = float(shown["input_value"] or 0)
    for field, other in (("start_date", first), ("end_date", last)):
        if other:
            shown[field] = min(max(_day(shown[field], other), first), last)
    return shown


def _day(text: str | None, other: date) -> date:
    try:
        return date.fromisoformat(str(text)[:10])
    except ValueError:
        return other


def form(strategy: Mapping, columns: Sequence[str], first: date | None = None, last: date | None = None) -> dict:
    """What a form shows for a saved strategy: tickers that exist, RULES rules a side, BENCHMARKS benchmarks at most, dates within the data's, and the settings."""
    said = strategy.get("configuration", {})
    shown = {"benchmarks": [b for b in said.get("benchmarks", []) if b in columns][:BENCHMARKS]}
    other = columns[0]
    for side in SIDES:
        other = shown[f"{side}_ticker"] = said.get(f"{side}_ticker") if said.get(f"{side}_ticker") in columns else other
        rows = said.get(f"{side}_rows", [])[:RULES]
        shown[f"{side}_rows"] = [rule_row(rows[k] if k < len(rows) else {}, k + 1, columns, first, last) for k in range(RULES)]
    given = said.get("settings", {})
    return shown | {"settings": {n: type(d)(given.get(n, d)) for n, d in DEFAULTS.items()}}


def document(name: str, form: Mapping, input_table: DataFrame, tables: Mapping[str, DataFrame], about: Mapping | None = None, saved_at: str | None = None) -> dict:
    """A run as a strategy document that ``put`` saves: the form's choices, the results' tables (headline, yearly, trades, equity curves, as records with two places) and the bars they were made of. A run's tables are some thousand rows."""
    records = lambda df: [json.loads(r["record"]) for r in as_records(two_places(df)).collect()]
    dated = lambda x: x.isoformat() if isinstance(x, date) else x
    rows = {f"{side}_rows": [{k: dated(v) for k, v in rule.items()} for rule in form[f"{side}_rows"]] for side in SIDES}
    inputs = {"columns": input_table.columns, "data": records(input_table)}
    return {
        "name": name, "saved_at": saved_at or f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S} UTC", "configuration": {**(about or {}), **form, **rows},
        "results": {part: records(df) for part, df in tables.items()}, "underlying_inputs": inputs, "full_input_table": inputs,
    }
