"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed letter trigrams, counted over all training texts. A document is a mixture: expectation-maximisation
estimates the languages' proportions from its trigrams' likelihoods. Languages are then taken out of the set, the one with
the smallest proportion first, as long as the penalised likelihood does not fall; the language with the largest proportion in the set that is
left is the prediction.

The counts have a fixed size, ``BUCKETS`` numbers a language, whatever the corpus; each partition counts for itself and sends
its sums. Texts are read whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Equal proportions go to the language
first in alphabetical order. Repeated rows get the same result each. If no training text has a letter, all are ``und``. A null doc_id
counts as not held out. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veinwork.llm.scratch import map_arrow, table
from veinwork.llm.words import mix, slices

BUCKETS = 1 << 16
#: What one more language must add to the log likelihood, times the logarithm of the number of trigrams (which overlap).
PENALTY = 3.0
ROUNDS = 30


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(text: str | None) -> np.ndarray:
    """The bucket of each trigram around a letter, with 0 in place of all that is no letter."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[0], _letters()[c], [0]]).astype(np.uint64)
    mid = np.flatnonzero(c[1:-1]) + 1
    key = (c[mid - 1] << np.uint64(42)) | (c[mid] << np.uint64(21)) | c[mid + 1]
    return (mix(key) >> np.uint64(48)).astype(np.int64)


def held_out(doc_id: str = "doc_id", parts: int = 3, part: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


class Model:
    def __init__(self, names: list[str], counts: np.ndarray, penalty: float = PENALTY):
        self.names, self.penalty = names, penalty
        total = counts.sum(axis=1, keepdims=True)
        self.log = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float64)

    def _mix(self, like: np.ndarray, weight: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log likelihood; ``like`` is relative to each trigram's best language."""
        share = start / start.sum()
        n = weight.sum()
        for _ in range(ROUNDS):
            got = share * ((weight / (like @ share)) @ like) / n
            moved = np.abs(got - share).max()
            share = got
            if moved < 1e-3:
                break
        return share, float(weight @ np.log(like @ share))

    def infer(self, text: str | None) -> tuple[str, float, list[str], float]:
        """The language, its proportion, the language set, and by how much a trigram's mean log likelihood is above that of noise."""
        at = trigrams(text)
        if not len(at) or not self.names:
            return "und", 0.0, [], 0.0
        if len(at) > 3000:
            at, weight = np.unique(at, return_counts=True)
            weight = weight.astype(np.float64)
        else:
            weight = np.ones(len(at))
        log = self.log[at]
        top = log.max(axis=1)
        like = np.exp(log - top[:, None])
        n, kept = weight.sum(), np.arange(len(self.names))
        share, value = self._mix(like, weight, np.ones(len(kept)))
        cost = self.penalty * np.log(n + 1)
        while len(kept) > 1:
            rest = np.delete(np.arange(len(kept)), len(kept) - 1 - int(np.argmin(share[::-1])))
            less, lower = self._mix(like[:, kept[rest]], weight, share[rest] + 1e-6)
            if value - lower >= cost:
                break
            kept, share, value = kept[rest], less, lower
        i = int(np.argmax(share))
        gain = (value + float(weight @ top)) / n + np.log(BUCKETS)
        return self.names[kept[i]], float(min(1.0, share[i])), [self.names[k] for k in kept], float(gain)


def train(texts: DataFrame) -> Model:
    """Counts every trigram of the (text, lang) rows whose lang is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    counted = map_arrow(texts.select("text", "lang").where("lang is not null and text is not null"), run, "lang string, bucket bigint, n bigint")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
    names = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(names), BUCKETS), np.int64)
    where = {x: i for i, x in enumerate(names)}
    counts[[where[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model(names, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs, gain) for each row of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = [shared.value.infer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "langs", "gain"])

    return map_arrow(docs.select("doc_id", "held_out", "text"), run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, langs array<string>, gain double")


def learned(docs: DataFrame) -> tuple[DataFrame, Model]:
    """The documents with ``held_out``, and the model of those that are not."""
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return docs, train(docs.where("not held_out"))


def filter_language(docs: DataFrame) -> DataFrame:
    """The documents without those in no learned language: no letters, or trigrams that noise explains as well."""
    known, model = learned(docs)
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = [shared.value.infer(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([g[0] != "und" and g[3] > 0 for g in got], pa.bool_()))

    return map_arrow(docs.select(*names), run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    docs, model = learned(table(spark, sf_dir, "documents"))
    return identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")
