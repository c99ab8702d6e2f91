"""Benchmark decontamination: which documents hold (nearly) all shingles of a test item.

Size-partitioned MinHash containment search. Items are dealt into size classes (powers of two of their number of
distinct shingles). An item's sketch is the bottom-k of its shingles under a hash, with k of its class so large that a
document which holds the threshold's share of the shingles must hold one of the k: where ``n <= upper``, at most
``floor((1 - t) * upper)`` shingles may be missing, and one more than that are kept. So the search misses nothing, at
any document length. A document is looked up in the sketches of those classes only whose smallest item it could
contain; each candidate is then checked by exact shingle containment, on the words themselves.

Defined results: null, empty and white-space texts have no shingles and match nothing, as item or as document. A text
of fewer than ``width`` words has one shingle, its whole sequence, so a short item matches only an equally short document.
Repeated rows give repeated result rows; repeated items give one row each. Columns other than the id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veinwork.llm.scratch import map_arrow, table
from veinwork.llm.words import mix, shingle_hashes, slices, split_words

#: Bytes of item shingles that one block of the test set may have; each block is broadcast on its own.
BLOCK_BYTES = 32 << 20


def word_shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    """The distinct shingles as words."""
    words, _ = split_words(pa.array([text], pa.string()))
    w = words.to_pylist()
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


class ContainmentIndex:
    """The sketches and full shingle sets of one block of items."""

    def __init__(self, ids: pa.Array, texts: list, width: int, percent: int):
        self.ids, self.texts, self.width, self.percent = ids, texts, width, percent
        self.sets = list(shingle_hashes(pa.array(texts, pa.large_string()), width))
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                classes.setdefault((len(s) - 1).bit_length(), []).append(i)
        self.classes = []
        for bits, members in sorted(classes.items()):
            k = (100 - percent) * (1 << bits) // 100 + 1
            keys = [self.sets[i][np.argsort(mix(self.sets[i]), kind="stable")[:k]] for i in members]
            owner = np.repeat(members, [len(x) for x in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            least = min(self.needed(len(self.sets[i])) for i in members)
            self.classes.append((least, keys[order], owner[order]))
        self.words: dict[int, set] = {}

    def needed(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def search(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Pairs (document, item) where the document holds enough of the item's hashed shingles."""
        sizes = np.array([len(x) for x in docs], np.int64)
        every = np.concatenate(docs) if len(docs) else np.empty(0, np.uint64)
        at = np.repeat(np.arange(len(docs)), sizes)
        found = set()
        for least, keys, owner in self.classes:
            fits = sizes[at] >= least
            x, d = (every, at) if fits.all() else (every[fits], at[fits])
            lo = np.searchsorted(keys, x)
            hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == x))
            for j in hit.tolist():
                p = lo[j]
                while p < len(keys) and keys[p] == x[j]:
                    found.add((int(d[j]), int(owner[p])))
                    p += 1
        for d, i in sorted(found):
            if len(np.intersect1d(docs[d], self.sets[i], assume_unique=True)) >= self.needed(len(self.sets[i])):
                yield d, i

    def confirmed(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, the item's number of shingles, how many of them the document holds), checked on the words themselves."""
        words: tuple[int, set] = (-1, set())
        for d, i in self.search(list(shingle_hashes(texts, self.width))):
            if words[0] != d:
                words = (d, word_shingles(texts[d].as_py(), self.width))
            n, same = self.exact(words[1], i)
            if same * 100 >= self.percent * n:
                yield d, i, n, same

    def exact(self, doc_words: set, i: int) -> tuple[int, int]:
        """The item's number of shingles and how many of them the document holds."""
        if i not in self.words:
            self.words[i] = word_shingles(self.texts[i], self.width)
        return len(self.words[i]), len(self.words[i] & doc_words)


def find_contaminated(
    docs: DataFrame, items: DataFrame, *, width: int = 5, percent: int = 80, doc_id: str = "doc_id",
    item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for each document that holds at least ``percent`` per
    cent of an item's distinct shingles.

    The items are taken in blocks of about ``block_bytes``, each broadcast, over all documents: a narrow pass without
    a shuffle. Documents are read in place, so neither long documents nor hot items gather anywhere.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, item_shingles bigint, shared bigint, containment double"
    out = None
    for index in _blocks(items, item_id, text, width, percent, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches, "text"):
                found = list(index.confirmed(batch.column("text")))
                d, i, n, same = (pa.array([f[k] for f in found], pa.int64()) for k in range(4))
                ratio = pa.array([f[3] / f[2] for f in found], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(d), index.ids.take(i), n, same, ratio], names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        hits = map_arrow(docs, search, schema)
        out = hits if out is None else out.union(hits)
    return out


def _blocks(items: DataFrame, item_id: str, text: str, width: int, percent: int, block_bytes: int) -> Iterator[ContainmentIndex]:
    """The items' indexes, a block of about ``block_bytes`` each."""
    items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) * 4 + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = part.toArrow()  # bounded by block_bytes
        yield ContainmentIndex(rows.column("item_id").combine_chunks(), rows.column("text").to_pylist(), width, percent)


def remove_contaminated(docs: DataFrame, items: DataFrame, *, width: int = 5, percent: int = 80, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no test item: each row is judged by its own text, whatever its id. A narrow pass for each block of items."""
    for index in _blocks(items, item_id, text, width, percent, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in shared.value.confirmed(batch.column(text))]] = False
                yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, clean, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all of ``benchmark``, five-word shingles, containment of 0.8 or more."""
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = """select {id}, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g
  from (select {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {table})"""

ORACLE = f"""with d as (select distinct * from ({_SHINGLES.format(id="doc_id", table="documents")})),
i as (select distinct * from ({_SHINGLES.format(id="item_id", table="benchmark")})),
n as (select item_id, count(*) as item_shingles from i group by item_id),
s as (select doc_id, item_id, count(*) as shared from i join d using (g) group by doc_id, item_id)
select doc_id, item_id, item_shingles, shared, shared / item_shingles as containment
from s join n using (item_id) where shared * 100 >= 80 * item_shingles"""
