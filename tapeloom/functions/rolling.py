"""Rolling sums and extremes in three window passes of any width.

A sliding frame re-aggregates all n rows of the frame for every bar. Here the
frame is put together from shifted partial frames instead: five rows, then up
to twenty, then multiples of twenty, each one lag() away. A 252-bar maximum
costs about twenty lags per bar, a 20-bar sum seven, and many series share the
same three passes over one (ticker, date) sort.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.exprs import by_ticker

SMALL, LARGE = 5, 20


@dataclass(frozen=True)
class Roll:
    """A rolling `kind` (sum, max, min) of `value` over n rows, named out."""
    kind: str
    value: Column
    widths: dict[int, str]


def _joined(kind: str, parts: list[Column]) -> Column:
    if len(parts) == 1:
        return parts[0]
    if kind == "sum":
        return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.greatest(*parts) if kind == "max" else F.least(*parts)


def rolled(df: DataFrame, wanted: list[Roll], *extra: str) -> DataFrame:
    """Add every requested rolling column; frames may still be partial."""
    w = by_ticker(*extra)

    def back(name: str, k: int) -> Column:
        return F.lag(name, k).over(w) if k else F.col(name)
    middle = [sorted({n if n <= LARGE else LARGE for n in r.widths} | {n % LARGE for n in r.widths if n > LARGE} - {0}) for r in wanted]
    first = [sorted({SMALL for m in ms if m >= SMALL} | {m % SMALL for m in ms} - {0}) for ms in middle]
    staged = df.select("*", *[r.value.cast("double").alias(f"_x{i}") for i, r in enumerate(wanted)])
    staged = staged.select("*", *[_joined(r.kind, [back(f"_x{i}", k) for k in range(b)]).alias(f"_s{i}_{b}")
                                  for i, r in enumerate(wanted) for b in first[i]])
    parts = []
    for i, r in enumerate(wanted):
        for m in middle[i]:
            blocks = [back(f"_s{i}_{SMALL}", SMALL * a) for a in range(m // SMALL)]
            rest = [back(f"_s{i}_{m % SMALL}", m - m % SMALL)] if m % SMALL else []
            parts.append(_joined(r.kind, blocks + rest).alias(f"_m{i}_{m}"))
    staged = staged.select("*", *parts)
    final = []
    for i, r in enumerate(wanted):
        for n, out in r.widths.items():
            if n <= LARGE:
                final.append(F.col(f"_m{i}_{n}").alias(out))
                continue
            blocks = [back(f"_m{i}_{LARGE}", LARGE * a) for a in range(n // LARGE)]
            rest = [back(f"_m{i}_{n % LARGE}", n - n % LARGE)] if n % LARGE else []
            final.append(_joined(r.kind, blocks + rest).alias(out))
    return staged.select(*df.columns, *final)
