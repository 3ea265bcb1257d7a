"""Small DataFrame helpers that the operators of this folder share."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tapeloom.session import scratch_folder

# What one Arrow batch between the JVM and Python holds at most, unless a single row is larger.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "20000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that tasks exchange with Python."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    return spark


def staged(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, lost executors don't matter."""
    path = f"{scratch_folder(df.sparkSession)}/stage"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names) -> DataFrame:
    """Drop columns whose names an operator is about to add (its own columns win)."""
    known = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in known])


def add_columns(df: DataFrame, fields: list[tuple[str, T.DataType]], compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Append columns that a vectorised function computes from each Arrow batch; existing columns of these names go."""
    small_batches(df.sparkSession)
    base = without(df, [name for name, _ in fields])
    names, kinds = [name for name, _ in fields], [to_arrow_type(kind) for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [pa.array(values, type=kind) for values, kind in zip(compute(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    schema = T.StructType([*base.schema.fields, *[T.StructField(name, kind) for name, kind in fields]])
    return base.mapInArrow(run, schema)


def row_totals(counts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of a 0/1 frame over each row's range."""
    total = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=total[1:])
    return total[ends] - total[starts]


def set_aside(df: DataFrame, used) -> tuple[DataFrame, list]:
    """The frame with all columns but the used ones under reserved names, and the expressions that select the old frame again.

    An operator then adds columns of any name without meeting one of the input's.
    """
    kept = {name.lower() for name in used}
    names = [c if c.lower() in kept else f"__in_{i}" for i, c in enumerate(df.columns)]
    aside = df.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(df.columns, names, strict=True)])
    return aside, [F.col(f"`{name}`").alias(c) for c, name in zip(df.columns, names, strict=True)]
