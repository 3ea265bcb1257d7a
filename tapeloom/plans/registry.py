"""Query registry: each name pairs a Spark plan with its SQL oracle."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.session import utc
from tapeloom.sources.market import BARS_ORACLE, VIEW_SQL, Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

# Named sub-queries an oracle may use; plan modules add their own.
ORACLE_VIEWS: dict[str, str] = {"v_bars": BARS_ORACLE, **VIEW_SQL}


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Split the call arguments that start just after an opening bracket."""
    depth, quoted, parts, begin, i = 1, False, [], start, start
    while depth:
        ch = text[i]
        if ch == "'":
            quoted = not quoted
        elif not quoted:
            if ch == "(" or ch == "[":
                depth += 1
            elif ch == ")" or ch == "]":
                depth -= 1
            if depth == 0 or (ch == "," and depth == 1):
                parts.append(text[begin:i].strip())
                begin = i + 1
        i += 1
    return parts, i


def expand(sql: str) -> str:
    """Spell out the shorthands clip(x,a,b) and rN(x) of the oracle texts."""
    pattern = re.compile(r"\b(clip|r\d)\(")
    match = pattern.search(sql)
    while match:
        parts, end = _arguments(sql, match.end())
        if match.group(1) == "clip":
            x, low, high = parts
            text = f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END)"
        else:
            text = f"(CASE WHEN round({parts[0]}, {match.group(1)[1]}) = 0 THEN 0.0::DOUBLE ELSE round({parts[0]}, {match.group(1)[1]}) END)"
        sql = sql[:match.start()] + text + sql[end:]
        match = pattern.search(sql)
    return sql


def _dependencies(sql: str, seen: list[str]) -> None:
    for name in re.findall(r"\bv_[a-z0-9_]+\b", sql):
        if name in ORACLE_VIEWS and name not in seen:
            _dependencies(ORACLE_VIEWS[name], seen)
            if name not in seen:
                seen.append(name)


def assemble(sql: str) -> str:
    """Prefix a body with the sub-queries it names, in dependency order."""
    names: list[str] = []
    _dependencies(sql, names)
    body = sql.strip()
    ctes = [f"{name} AS ({ORACLE_VIEWS[name].strip()})" for name in names]
    if body[:5].upper() == "WITH ":
        ctes.append("")
        return expand("WITH " + ",\n".join(ctes) + body[5:]) if names else expand(body)
    return expand(("WITH " + ",\n".join(ctes) + "\n" if names else "") + body)


def query(name: str, covers: str, oracle: str | None = None):
    """Register fn(market) -> DataFrame; `covers` lists inventory rows."""
    def wrap(fn: Callable[[Market], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Market(utc(spark), sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        COVERS[name] = covers
        if oracle:
            ORACLES[name] = oracle
        return fn
    return wrap
