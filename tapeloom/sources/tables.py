"""Parquet tables, and DataFrames over SQL text without registering views."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names_in(sql: str, known) -> list[str]:
    """Known relation names that stand after FROM, JOIN or a comma."""
    found = re.findall(r"\b(?:from|join|,)\s+([a-z_][a-z0-9_]*)\b", sql, flags=re.IGNORECASE)
    return [name for name in dict.fromkeys(found) if name in known]


def run_sql(spark: SparkSession, sql: str, resolve: Callable[[str], DataFrame], known) -> DataFrame:
    """spark.sql with the named relations bound to DataFrames."""
    names = names_in(sql, known)
    for name in names:
        sql = re.sub(rf"(?i)(\b(?:from|join|,)\s+){name}\b", rf"\1{{{name}}}", sql)
    return spark.sql(sql, **{name: resolve(name) for name in names})
