"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its whole text. It is learned from preference pairs, a document of quality 1 over one of
quality 0, by the logistic loss on the difference of their features (Newton steps). The cut is a quantile of the training documents' worth:
the one that separates the labels best. The score is the logistic function of the worth, shifted so that the cut is at ``CUT``.

The classifier is fitted on at most ``MAX_LABELLED`` labelled rows (those with the least hash), ``MAX_PAIRS`` pairs; scoring is a narrow pass over all documents.
Where doc_ids repeat in the documents, at most twice that number of (document, label) rows, again those with the least hash.

Defined results: null and empty texts have the features of an empty text and are scored. Where the training rows have one label only, every
score is 1 or 0 accordingly; without any training row, 0.5. A doc_id that has labels several times counts for each; repeated documents get the same score each. A null doc_id counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from veinwork.llm.language import held_out
from veinwork.llm.scratch import map_arrow, table
from veinwork.llm.words import slices, split_words

MAX_LABELLED, MAX_PAIRS, CUT = 20_000, 200_000, 0.3
N_FEATURES = 29

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r", ".,;:?", "!", "|", "#$%&*@<>{}[]\\/=+~^_`", "\"'()-"]):
    for _c in _chars:
        _CLASS[ord(_c)] = _i + 1
_CLASS[128:] = 11


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    words, ends = split_words(texts)
    coded = words.dictionary_encode()
    codes, lengths = coded.indices.to_numpy(), pa.compute.binary_length(words).to_numpy()
    out = np.zeros((len(texts), N_FEATURES))
    for i, text in enumerate(texts.to_pylist()):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        n, own = max(1, len(raw)), codes[ends[i] : ends[i + 1]]
        share = np.bincount(_CLASS, np.bincount(raw, minlength=256), minlength=12) / n
        m = max(1, len(own))
        counts = np.unique(own, return_counts=True)[1] if len(own) else np.zeros(1)
        size = lengths[ends[i] : ends[i + 1]]
        again = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
        distinct = len(counts) / m
        out[i] = [*share, *np.sqrt(share[6:10]), np.log1p(len(raw)), np.log1p(len(own)), size.mean() if len(own) else 0, size.std() if len(own) else 0, distinct, np.log(m / max(1, len(counts))), counts.max() / m, again, (counts > 1).mean(), np.sqrt(again), len(own) < 5, len(own) < 30, share[2] > 0.3]
    return out


def preferences(good: np.ndarray, bad: np.ndarray, max_pairs: int = MAX_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are learned from: places of the preferred rows and of those they are preferred to."""
    rng = np.random.default_rng(7)
    pairs = min(max_pairs, 20 * max(len(good), len(bad)))
    return rng.choice(good, pairs), rng.choice(bad, pairs)


class Ranker:
    """worth(x) = weights . (x - mean) / spread, and the cut."""

    def __init__(self, x: np.ndarray, label: np.ndarray, max_pairs: int = MAX_PAIRS):
        self.constant = None
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        if not len(good) or not len(bad):
            self.constant = 0.5 if not len(x) else float(bool(len(good)))
            return
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - self.mean) / self.spread
        a, b = preferences(good, bad, max_pairs)
        pairs, d = len(a), z[a] - z[b]
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = d.T @ (1 - p) / pairs - 1e-3 * w
            curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(curve, gradient)
            w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        worth = z @ w
        q = np.linspace(0.005, 0.995, 199)
        cuts = np.quantile(worth, q)
        right = [((worth >= c) == (label == 1)).mean() for c in cuts]
        best = np.flatnonzero(np.array(right) == max(right))
        self.quantile, self.cut = float(q[best[len(best) // 2]]), float(cuts[best[len(best) // 2]])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        worth = ((x - self.mean) / self.spread) @ self.weights
        return 1 / (1 + np.exp(-np.clip(worth - self.cut + np.log(CUT / (1 - CUT)), -700, 700)))


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> Ranker:
    """From (doc_id, text) and the (doc_id, quality) rows that are to be learned from."""
    known = labels.where("quality is not null").select(F.col("doc_id").alias("_id"), "quality").orderBy(F.xxhash64("doc_id", "quality"), "doc_id").limit(max_labelled)
    # bounded by max_labelled rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["quality", "x"])

    # a doc_id that several documents have brings a row for each: the bound holds for these too, by the rows' own hash
    got = map_arrow(texts, run, "quality bigint, x array<double>").orderBy(F.xxhash64("x", "quality"), "x", "quality").limit(2 * max_labelled).toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(got.num_rows, N_FEATURES)
    return Ranker(x, got.column("quality").to_numpy())


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, held_out, score) for each row of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = shared.value.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got)], names=["doc_id", "held_out", "score"])

    return map_arrow(docs.select("doc_id", "held_out", "text"), run, f"doc_id {id_type}, held_out boolean, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(parts=5, part=0))
    labels = table(spark, sf_dir, "labels").where(~held_out(parts=5, part=0))
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
