"""Column helpers: NULL-safe clipping, guarded rolling frames, last rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("ticker", "date")


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL although least/greatest skip NULLs."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def by_ticker(*extra: str) -> WindowSpec:
    """The one series window, so that neighbouring frames share a sort."""
    return Window.partitionBy("ticker", *extra).orderBy("date")


def latest_first(*extra: str) -> WindowSpec:
    return Window.partitionBy("ticker", *extra).orderBy(F.col("date").desc())


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def spread(df: DataFrame) -> DataFrame:
    """Hash-partition on ticker into the session's shuffle partitions.

    The windows that follow reuse this partitioning. The number is explicit
    because they are heavy on CPU and light on bytes: coalescing by size would
    leave them to a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker")


def frame(n: int, *extra: str) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return by_ticker(*extra).rowsBetween(-(n - 1), 0)


def upto(*extra: str) -> WindowSpec:
    return by_ticker(*extra).rowsBetween(Window.unboundedPreceding, 0)


def full(aggregate: Column, counted: Column, n: int, *extra: str) -> Column:
    """A rolling aggregate that is NULL until n non-NULL values are in the frame."""
    return F.when(F.count(counted).over(frame(n, *extra)) >= n, aggregate)


def rolling(fn, value: Column, n: int, *extra: str) -> Column:
    return full(fn(value).over(frame(n, *extra)), value, n, *extra)


def lagged(value: Column | str, n: int, *extra: str) -> Column:
    return F.lag(value, n).over(by_ticker(*extra))


def change(value: Column | str, n: int, *extra: str) -> Column:
    """Relative change against the value n rows back."""
    value = F.col(value) if isinstance(value, str) else value
    prior = lagged(value, n, *extra)
    return F.when(prior != 0, value / prior - 1)


def last_rows(df: DataFrame, n: int = 1, keys=("ticker",)) -> DataFrame:
    """The n newest rows per key.

    The row_number filter becomes a limit per key below the shuffle, so a key
    with very many rows sends at most n of them from each task.
    """
    window = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def newest(df: DataFrame, *columns: str, keys=("ticker",)) -> DataFrame:
    """The newest row per key as a partial aggregate, with no sort."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct("date", *columns), "date").alias("_r"))
    return picked.select(*keys, "_r.*")


def first(df: DataFrame, place: str, most: int | None) -> DataFrame:
    """Rows up to a place, or all; the planner keeps that many per group in every task before the shuffle."""
    return df if most is None else df.filter(F.col(place) <= most)


def leading(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def cut(text: Column, width: int | None) -> Column:
    return text if width is None else F.substring(text, 1, width)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def mean_of(*values: Column) -> Column:
    """Mean of the non-NULL values, NULL when there is none."""
    summed = total([F.coalesce(v, F.lit(0.0)) for v in values])
    seen = total([v.isNotNull().cast("double") for v in values])
    return F.when(seen > 0, summed / seen)


def signal(label: str, status: Column, text: Column) -> list[Column]:
    return [F.lit(label).alias("label"), status.alias("status"), text.alias("text")]


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every DOUBLE column for presentation."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "double":
            column = F.round(column, special.get(field.name, digits)).alias(field.name)
        columns.append(column)
    return df.select(*columns)
