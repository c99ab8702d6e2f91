"""Written tables that cut lineage and are shared by queries of one session."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. In local mode one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "file:///tmp/checkpoints"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/veinwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Writes ``df`` as a table in ``buckets`` buckets by ``key``, sorted by it: joins on the key need no shuffle of the table."""
    spark, unique = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/veinwork/{unique}").saveAsTable(unique)
    return spark.table(unique)
