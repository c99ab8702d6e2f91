"""An inverted index kept up to date by changes of documents.

A change is a document's new version, or its deletion. Each batch of changes writes four small tables of its own (folders ``batch=N``): the documents, their chunks' features, their postings, and by how much it
changes each gram's number of chunks. A change takes effect only if its version is higher than what is stored, so batches may come in any order; a batch that is run again overwrites its own
folders, so it counts once. The work of a batch grows with the changed documents and with what was stored of them, not with the corpus. What is current is read by version; ``compacted`` writes it as one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from veinwork.domain import REGULATIONS, Profile
from veinwork.operators import inverted, retrieve
from veinwork.ship import ship

_KEYS = "doc_id bigint, version bigint"
_POSTINGS = f"gram string, ord bigint, mask int, {_KEYS}"
_DELTAS = "gram string, delta bigint"


class LiveIndex:
    """An index in a shared folder. ``cut`` makes the chunk table (doc_id, version, ord, title, law_title, article_no, content) of documents (doc_id, version and their other columns); ord must be the chunk's own."""

    def __init__(self, spark: SparkSession, root: str, documents: StructType, cut: Callable[[DataFrame], DataFrame], profile: Profile = REGULATIONS):
        self.spark, self.root, self.cut, self.profile = spark, root, cut, profile
        self.documents = StructType([f for f in documents if f.name not in ("doc_id", "version", "deleted")])
        empty = spark.createDataFrame([], f"{_KEYS}, deleted boolean").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in self.documents))
        self.schemas = {"changes": empty.schema, "features": self._features(empty).schema, "postings": spark.createDataFrame([], _POSTINGS).schema, "deltas": spark.createDataFrame([], _DELTAS).schema}
        for name, schema in self.schemas.items():  # so that each can be read before the first change
            if not self._has(f"{root}/{name}"):
                spark.createDataFrame([], schema).write.parquet(f"{root}/{name}/batch=-1")

    def _has(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _features(self, docs: DataFrame) -> DataFrame:
        return retrieve.features(self.cut(docs), self.profile, ("doc_id", "version"))

    def _read(self, name: str) -> DataFrame:
        spec = StructType([*self.schemas[name].fields]).add("batch", "long")
        return self.spark.read.schema(spec).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    @staticmethod
    def _latest(changes: DataFrame) -> DataFrame:
        """Each document's highest version; of equal versions a deletion, then the least row."""
        rest = [c for c in changes.columns if c not in ("doc_id", "version", "deleted")]
        top = changes.groupBy("doc_id").agg(F.max(F.struct("version", "deleted")).alias("x"))
        got = changes.join(top.select("doc_id", F.col("x.version").alias("version"), F.col("x.deleted").alias("deleted")), ["doc_id", "version", "deleted"])
        return got.groupBy("doc_id", "version", "deleted").agg(F.min(F.struct(*rest)).alias("x")).select("doc_id", "version", "deleted", *(F.col(f"x.{c}").alias(c) for c in rest))

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Takes changes (doc_id, version, deleted and the documents' columns) in. Null ids, versions and flags: rows without an id or version are left out, a null flag is no deletion."""
        ship(self.spark)
        names = [f.name for f in self.documents]
        new = changes.where("doc_id is not null and version is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("version").cast("bigint").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"), *names)
        new = self._latest(new)
        stored = self._read("changes").where(F.col("batch") != batch).join(new.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("version", "deleted")).alias("was"))
        taken = new.join(stored.select("doc_id", F.col("was.version").alias("old")), "doc_id", "left").where("old is null or version > old")
        self._write(taken.drop("old"), "changes", batch)
        own = lambda name: self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}/batch={batch}")
        taken = own("changes")
        self._write(self._features(taken.where("not deleted")), "features", batch)
        texts = own("features")
        self._write(texts.select("ord", *inverted._FIELDS, "doc_id", "version").mapInArrow(inverted._posted, self.schemas["postings"]), "postings", batch)
        gone = taken.select("doc_id").join(stored.select("doc_id", F.col("was.version").alias("version")), "doc_id")
        before = self._read("postings").where(F.col("batch") != batch).join(gone, ["doc_id", "version"], "left_semi")
        deltas = own("postings").select("gram", F.lit(1).alias("by")).union(before.select("gram", F.lit(-1).alias("by")))
        self._write(deltas.groupBy("gram").agg(F.sum("by").cast("bigint").alias("delta")).where("delta <> 0"), "deltas", batch)

    def follow(self, stream: DataFrame, checkpoint: str):
        """Takes the changes of a stream in, each micro-batch once."""
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _live(self) -> DataFrame:
        return self._read("changes").groupBy("doc_id").agg(F.max(F.struct("version", "deleted")).alias("x")).where("not x.deleted").select("doc_id", F.col("x.version").alias("version"))

    def frequencies(self) -> DataFrame:
        """(gram, df): in how many current chunks each gram occurs."""
        return self._read("deltas").groupBy("gram").agg(F.sum("delta").alias("df")).where("df > 0")

    def index(self) -> inverted.Index:
        """The current index, to search in."""
        live = self._live()
        now = lambda name: self._read(name).join(live, ["doc_id", "version"], "left_semi").drop("doc_id", "version", "batch")
        features = now("features")
        return inverted.Index(features, now("postings"), self.frequencies(), features.count())

    def compacted(self, root: str) -> LiveIndex:
        """The same in another folder, as one batch; deletions stay known, so that older versions that come late don't take effect."""
        out = LiveIndex(self.spark, root, self.documents, self.cut, self.profile)
        live = self._live()
        out._write(self._latest(self._read("changes").drop("batch")), "changes", 0)
        for name in ("features", "postings"):
            out._write(self._read(name).drop("batch").join(live, ["doc_id", "version"], "left_semi").select(*self.schemas[name].names), name, 0)
        out._write(self.frequencies().select("gram", F.col("df").alias("delta")), "deltas", 0)
        return out
