"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from veinwork.ship import ship

LOCAL_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, one of our own in local mode (tests), since there all is on one machine; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_DIR


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    The result has no lineage before the written files, so a lost executor costs only the reading of its
    part again, and a plan that uses the table twice computes it once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veinwork/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more; other tables are left alone."""
    for df in staged:
        if at := getattr(df, "_staged_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of one Arrow batch between Spark and Python: texts are long, and a batch lies in memory on both sides.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, in batches of bounded size.

    Spark reads the bounds when the query runs, so they stay in the session; a session that asks for smaller batches keeps its own."""
    spark = df.sparkSession
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        own = spark.conf.get(key).rstrip("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(key, most)
    return df.mapInArrow(run, schema)
