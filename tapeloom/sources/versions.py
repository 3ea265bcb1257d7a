"""Versioned table of predictions: data files by commit, and a manifest that says which of them a version holds.

A commit writes its rows to a folder of its own and then its manifest, the only file whose presence makes a version. A commit that
dies before that leaves nothing that is ever read. Parts are keyed by (run, fold): appending a part that is there already changes
nothing, so a job may be started again; replacing puts another folder in a part's place. Old versions stay readable. One writer at
a time; readers need no care.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PART = "run string, fold int, commit string, n long"
KEYS = ("run", "fold")


class PredictionTable:
    """Rows with a column `fold`, under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        """`schema` is that of the rows; it has the column `fold int`."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> DataFrame:
        """version, run, fold, commit, n: the parts of every version (a row per part; an empty table has none)."""
        try:
            return self.spark.read.schema(f"{PART}, version int").json(f"{self.path}/manifests")
        except AnalysisException:       # no version yet
            return self.spark.createDataFrame([], f"{PART}, version int")

    def newest(self) -> int:
        """Number of the newest version, 0 before the first."""
        return self.versions().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def parts(self, version: int | None = None) -> DataFrame:
        version = self.newest() if version is None else version
        return self.versions().filter(F.col("version") == version).select(*KEYS, "commit", "n")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the newest by default), with their run."""
        commits = sorted({r.commit for r in self.parts(version).select("commit").distinct().collect()})     # one per commit
        shape = self.spark.createDataFrame([], f"run string, {self.schema}")
        if not commits:
            return shape
        rows = self.spark.read.schema(f"run string, {self.schema}, commit string").parquet(*[f"{self.path}/data/{c}" for c in commits])
        listed = self.parts(version).select(*KEYS, "commit")
        return rows.join(F.broadcast(listed), [*KEYS, "commit"], "left_semi").select(*shape.columns)        # one row per part

    def append(self, rows: DataFrame, run: str) -> int:
        """Add the folds of a run that the table lacks; folds it has are left as they are. Returns the newest version."""
        return self._commit(rows, run, keep=True)

    def replace(self, rows: DataFrame, run: str) -> int:
        """Put these folds of a run in the place of those the table has. Returns the new version."""
        return self._commit(rows, run, keep=False)

    def _commit(self, rows: DataFrame, run: str, keep: bool) -> int:
        before = self.newest()
        old = self.parts(before)
        if keep:
            held = old.filter(F.col("run") == run).select("fold")
            rows = rows.join(F.broadcast(held), "fold", "left_anti")        # one row per fold
        commit = uuid.uuid4().hex
        columns = self.spark.createDataFrame([], self.schema).columns
        where = f"{self.path}/data/{commit}"
        rows.select(F.lit(run).alias("run"), *columns, F.lit(commit).alias("commit")).write.parquet(where)
        written = self.spark.read.schema(f"run string, {self.schema}, commit string").parquet(where)
        new = written.groupBy("run", "fold").agg(F.first("commit").alias("commit"), F.count(F.lit(1)).alias("n"))
        if new.isEmpty():
            return before
        parts = old.join(F.broadcast(new.select(*KEYS)), [*KEYS], "left_anti").unionByName(new)
        # One file per version, in a folder that must not exist: a second writer of the same version fails.
        manifest = parts.withColumn("version", F.lit(before + 1)).coalesce(1)
        manifest.write.mode("error").json(f"{self.path}/manifests/at={before + 1}")
        return before + 1
