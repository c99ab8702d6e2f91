"""Stores: chunk tables, evaluation sets, results, key-value documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from veinwork.domain import REGULATIONS, Profile
from veinwork.operators.chunk import chunk_documents
from veinwork.sources.json_array import read_objects

CHUNK = "chunkId string, documentId string, title string, regionLevel string, sourcePath string, content string, lawTitle string, articleNo string, docCategory string"


def read_chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of a JSON array, with ``ord`` by place. The array is read by as many tasks as it has ranges."""
    return read_objects(spark, path).select("ord", F.from_json("value", CHUNK).alias("c")).select("ord", "c.*")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the store."""
    chunks.write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, path: str, schema) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def usable(spark: SparkSession, path: str) -> bool:
    """Whether a store is there and has rows: ingestion at start-up can be left out."""
    try:
        return bool(spark.read.parquet(path).take(1))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def read_eval_set(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """The items of a ``{"data": [...]}`` file, in order, or the first ``limit``."""
    schema = "id string, question string, source_group string, category string, anchor string, expected_answer string, source_file string, source_line int"
    rows = read_objects(spark, path, level=2).select(F.col("ord").alias("pos"), F.from_json("value", schema).alias("i")).select("pos", "i.*")
    return rows.where(F.col("pos") < limit) if limit else rows


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def write_report(rows: DataFrame, folder: str) -> None:
    """Result rows as JSON lines and as CSV."""
    rows.write.mode("overwrite").json(f"{folder}/rows.jsonl")
    flat = [c if not t.startswith(("array", "struct", "map")) else F.to_json(c).alias(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/rows.csv")


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """(line): a table in markdown. Meant for summaries, which have few rows."""
    head = rows.sparkSession.createDataFrame([(0, 0, "| " + " | ".join(rows.columns) + " |"), (1, 0, "|" + "---|" * len(rows.columns))], "part int, n int, line string")
    body = rows.withColumn("n", F.row_number().over(Window.orderBy(*order))).select(F.lit(2).alias("part"), "n", F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |")).alias("line"))
    return head.union(body).orderBy("part", "n").select("line")


def merge_document(store: DataFrame, changes: DataFrame) -> DataFrame:
    """A key-value store (id, payload) with the last change (id, payload, at) of each id in place."""
    last = changes.groupBy("id").agg(F.max_by("payload", "at").alias("payload"))
    return store.join(last.select("id"), "id", "left_anti").unionByName(last)


def ingest(docs: DataFrame, path: str, profile: Profile = REGULATIONS) -> dict[str, int]:
    """Cuts documents (id, title, region_level, source_path, text) into chunks and writes them. The numbers of documents, of chunks written and of chunks left out are taken on the way, in the same pass."""
    seen = (Observation(), Observation())
    chunk_documents(docs, profile, seen).write.mode("overwrite").parquet(path)
    return {**seen[0].get, **seen[1].get}
