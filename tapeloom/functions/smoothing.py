"""Exponential smoothing without a sequential scan.

The recursion y[t] = y[t-1] + a*(x[t]-y[t-1]) is linear, so y[t] is a weighted
sum of all earlier values. The series is cut into blocks of B rows with
(1-a)^B <= 1e-16. Inside a block the weighted sum is an ordinary running SUM;
what an earlier block adds is its last value times (1-a)^(j+1), and anything
older than the previous block is below double precision. Each row costs O(1)
and stays in built-in window aggregates, where folding a collected array would
cost O(B).
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.exprs import upto


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def ewm_many(df: DataFrame, wanted: list[tuple[str, str, float]], *extra: str) -> DataFrame:
    """Add several smoothed columns [(value, out, alpha)] over shared blocks.

    Each series starts at its first non-NULL value. One block length that is
    long enough for the slowest alpha serves all of them, so the whole list
    costs one running-sum window and one carry window.
    """
    block = max(2, *[math.ceil(math.log(1e-16) / math.log(1.0 - alpha)) for _, _, alpha in wanted])
    row = F.row_number().over(Window.partitionBy("ticker", *extra).orderBy("date")) - 1
    starts = [(F.count(value).over(upto(*extra)) == 1).alias(f"_first{k}") for k, (value, _, _) in enumerate(wanted)]
    staged = df.select("*", row.alias("_i"), *starts)
    staged = staged.select("*", F.floor(F.col("_i") / block).alias("_b"), (F.col("_i") % block).cast("double").alias("_j"))
    inside = (Window.partitionBy("ticker", *extra, "_b").orderBy("date")
              .rowsBetween(Window.unboundedPreceding, 0))
    local = []
    for k, (value, _, alpha) in enumerate(wanted):
        keep = F.lit(1.0 - alpha)
        weight = F.when(F.col(f"_first{k}") & F.col(value).isNotNull(), 1.0).otherwise(alpha)
        grown = F.sum(weight * F.col(value) * F.pow(keep, -F.col("_j"))).over(inside)
        local.append((grown * F.pow(keep, F.col("_j"))).alias(f"_local{k}"))
    staged = staged.select("*", *local)
    before = (Window.partitionBy("ticker", *extra).orderBy("date")
              .rowsBetween(Window.unboundedPreceding, -1))
    smoothed = []
    for k, (value, out, alpha) in enumerate(wanted):
        ends = F.when(F.col("_j") == block - 1, F.col(f"_local{k}"))
        carried = F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit(0.0))
        y = F.col(f"_local{k}") + F.pow(F.lit(1.0 - alpha), F.col("_j") + 1) * carried
        smoothed.append(F.when(F.col(value).isNotNull(), y).alias(out))
    return staged.select(*df.columns, *smoothed)


def ewm(df: DataFrame, value: str, out: str, alpha: float, *extra: str) -> DataFrame:
    """Add `out`, the smoothed `value`."""
    return ewm_many(df, [(value, out, alpha)], *extra)


def ewm_span(df: DataFrame, value: str, out: str, span: float, *extra: str) -> DataFrame:
    return ewm(df, value, out, span_alpha(span), *extra)
