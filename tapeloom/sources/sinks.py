"""Result sinks; the folder is the caller's."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_live_features(rows: DataFrame, path: str) -> None:
    """Feature snapshot, one folder per date."""
    rows.repartition("date").write.mode("overwrite").partitionBy("date").parquet(path)


def write_table_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def publish_json(rows: DataFrame, path: str, digits: int = 4) -> None:
    """One JSON object per row, doubles rounded."""
    columns = [F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in rows.schema.fields]
    rows.select(*columns).write.mode("overwrite").json(path)
