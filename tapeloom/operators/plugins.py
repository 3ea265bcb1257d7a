"""Strategies of the caller's own, next to the built-in rules.

A strategy declares the columns it reads and gives entry and exit flags of every bar. A planned one does so with column
expressions and becomes part of the query plan. A coded one is a function of one series as a pandas frame, ordered by date; it runs
once per (ticker, split) in a task that holds that series, which is as long as the calendar. Both end in the same signal rows, so
positions, trades and statistics are those of the built-in rules.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.strategies import crossings, split_summary, split_windows, statistics

SIGNAL = "ticker string, split int, date date, close double, entry boolean, exit boolean, strategy string"


@dataclass(frozen=True)
class PlannedStrategy:
    """`flags(rows)` appends boolean columns entry and exit; its windows go by ticker and split, ordered by date."""
    name: str
    columns: tuple[str, ...]
    flags: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CodedStrategy:
    """`flags(series)` returns entry and exit, two boolean sequences as long as the series; null counts as false."""
    name: str
    columns: tuple[str, ...]
    flags: Callable[[pd.DataFrame], tuple]


def _declared(rows: DataFrame, strategy: PlannedStrategy | CodedStrategy) -> DataFrame:
    missing = sorted(set(strategy.columns) - set(rows.columns))
    if missing:
        raise ValueError(f"strategy {strategy.name} reads unknown columns: {', '.join(missing)}")
    return rows.select("ticker", "split", "date", "close", *[c for c in strategy.columns if c not in ("ticker", "split", "date", "close")])


def _truth(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def signals(rows: DataFrame, strategy: PlannedStrategy | CodedStrategy) -> DataFrame:
    """Entry and exit of every row (ticker, split, date, close, declared columns); a strategy sees its declared columns only."""
    declared = _declared(rows, strategy)
    if isinstance(strategy, PlannedStrategy):
        made = strategy.flags(declared).withColumn("strategy", F.lit(strategy.name))
        return made.select("ticker", "split", "date", F.col("close").cast("double").alias("close"), _truth(F.col("entry")).alias("entry"), _truth(F.col("exit")).alias("exit"), "strategy")
    name, flags = strategy.name, strategy.flags

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("date").reset_index(drop=True)
        decided = [pd.Series(part).reset_index(drop=True) for part in flags(series.copy())]
        if len(decided) != 2 or any(len(part) != len(series) for part in decided):
            raise ValueError(f"strategy {name} must return an entry and an exit for each of {len(series)} bars")
        out = series[["ticker", "split", "date", "close"]].copy()
        for column, part in zip(("entry", "exit"), decided, strict=True):
            out[column] = part.astype("boolean").fillna(False).astype(bool)
        return out.assign(strategy=name)
    return declared.groupBy("ticker", "split").applyInPandas(run, SIGNAL)


def walk_forward(bars: DataFrame, strategies: list[PlannedStrategy | CodedStrategy], n_splits: int = 5, train: float = 0.8, least: int = 2) -> DataFrame:
    """Statistics of every strategy on the test part of each split; parts of fewer than `least` bars are left out.

    `bars`: ticker, date, close and what the strategies declare.
    """
    parts = split_windows(bars, n_splits, train)
    made = [signals(parts, strategy) for strategy in strategies]
    together = made[0]
    for more in made[1:]:
        together = together.unionByName(more)
    return statistics(together, "split", least=least).filter(F.col("n_bars") >= least)


def walk_forward_summary(stats: DataFrame) -> DataFrame:
    """Mean, median and spread over the splits, by ticker and strategy."""
    return split_summary(stats)


def planned_crossing(name: str, fast: Callable[[], Column], slow: Callable[[], Column], columns: tuple[str, ...] = ("close",)) -> PlannedStrategy:
    """Entry where one line crosses above the other, exit where it crosses below."""
    return PlannedStrategy(name, columns, lambda rows: crossings(rows, fast(), slow(), "split"))
