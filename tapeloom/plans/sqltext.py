"""Fragments for the oracle texts (DuckDB dialect)."""
from __future__ import annotations


def W(n: int | None = None, keys: str = "ticker") -> str:
    """Window over a ticker's bars; n rows ending here, or no frame."""
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"(PARTITION BY {keys} ORDER BY date{frame})"


def roll(agg: str, x: str, n: int, keys: str = "ticker") -> str:
    call = agg.format(x=x) if "{x}" in agg else f"{agg}({x})"
    return f"(CASE WHEN count({x}) OVER {W(n, keys)} >= {n} THEN {call} OVER {W(n, keys)} END)"


def lag(x: str, n: int, keys: str = "ticker") -> str:
    return f"lag({x}, {n}) OVER {W(keys=keys)}"


def chg(x: str, n: int, keys: str = "ticker") -> str:
    return f"({x} / nullif({lag(x, n, keys)}, 0) - 1)"


def ewm(x: str, alpha: float, rows: int, keys: str = "ticker") -> str:
    """Step-by-step fold over the frame, the definition itself."""
    return (f"(CASE WHEN {x} IS NOT NULL THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {W(rows, keys)}, "
            f"lambda a, b: a + {alpha!r} * (b - a)) END)")


def last(relation: str, keys: str = "ticker") -> str:
    return f"(SELECT * FROM {relation} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY date DESC) = 1)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
