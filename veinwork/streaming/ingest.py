"""Streams: chunks of files as they arrive, and sessions of users by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veinwork.functions.meta import path_id, region
from veinwork.operators.chunk import chunk_documents
from veinwork.domain import REGULATIONS, Profile


def chunk_stream(spark: SparkSession, folder: str, profile: Profile = REGULATIONS) -> DataFrame:
    """A stream of chunks out of the text files that arrive in a folder."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).withColumn("source_path", F.col("_metadata.file_path"))
    docs = files.select(path_id(F.col("source_path")).alias("id"), F.regexp_extract("source_path", r"([^/]*?)(\.[^.]*)?$", 1).alias("title"), region(F.col("source_path"), profile).alias("region_level"), "source_path", F.col("value").alias("text"))
    return chunk_documents(docs, profile)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) of a batch or a stream: accesses with less than the gap between them are one session."""
    got = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def write_chunks(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream of chunks to a Parquet table, once each."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
