"""Session defaults and the checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int = 8, memory: str = "12g", name: str = "tapeloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(cores)))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Long projections above the JIT's method size limit run interpreted when they
# are fused into one method; below this limit Spark splits them instead.
JIT_METHOD_LIMIT = "8000"


def utc(spark: SparkSession) -> SparkSession:
    """Pin the time zone the date arithmetic relies on, and the method limit."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_METHOD_LIMIT)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local master, whose executors are this machine, may leave it unset.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tapeloom-")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/tapeloom-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a frame as columns to the shared folder and read it back: computed once, lost executors don't matter."""
    path = f"{scratch_folder(df.sparkSession)}/staged"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MOST_SENT_ROWS = 200_000    # of a lookup table with a few columns


def lookup(df: DataFrame) -> DataFrame:
    """A staged small side of a join, sent to all tasks if it has few enough rows to be counted as small."""
    kept = staged(df)
    return F.broadcast(kept) if kept.count() <= MOST_SENT_ROWS else kept


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
