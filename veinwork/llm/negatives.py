"""Hard negatives by Fagin's threshold algorithm.

For each anchor its positives are the nearest rows of its own label; for each positive, the negatives are the nearest rows of other labels whose score lies in a window
that the positive's score sets. Both are top lists over all rows, found alike: the rows are worked on in slices, and each slice has, for every dimension, its rows in the order of their components.
For an anchor, a list is read from its upper end where the anchor's component is positive, from the lower where it is negative, all lists to the same depth (sorted access); rows
met for the first time are scored in whole numbers (random access) and offered to the anchor's windows. The components at the current depth give a threshold that no unseen row exceeds: once it
is strictly below what each window still lets in (its kth score or its lower end), the slice is done. Windows go on from slice to slice, so later slices stop sooner. Each task sends its best
rows of each window; they are merged by rank.

Anchors are broadcast in blocks of bounded size over all rows, one block at a time, and nothing is left out: a slice whose threshold never falls far enough is read to the end.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; vectors of different lengths are compared as if zeros followed the shorter. An inner product beyond a long's range counts as the end of
the range. Of several rows with one id, the least vector is the anchor; otherwise each row counts, but none with the anchor's own id. Ties go to the smaller id. An anchor without positives,
and a positive without rows in its window, give no rows; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veinwork.llm.scratch import map_arrow, stage, table
from veinwork.llm.topk import _matrix, usable

#: Anchors that one broadcast has, rows of one slice, and the share of a slice that the first sorted access reads.
BLOCK, SLICE, FIRST = 4096, 16384, 512
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Slice:
    """Rows with their sorted lists. Numbers are doubles where every inner product with the anchors is exact in them, else unbounded integers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, peak: float):
        self.exact = peak * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) < 1 << 53
        self.ids, self.labels, self.rows = ids, labels, rows if self.exact else np.frompyfunc(int, 1, 1)(rows)
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.rows, self.order, 0)

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        got = self.rows[at] @ anchor
        return got.astype(np.int64) if self.exact else np.array([min(max(int(x), _LEAST), _MOST) for x in got], np.int64)


class Best:
    """The best ``k`` rows, by score and then by id, among those of the anchor's label (``same``) or of others whose score is within [low, high]."""

    def __init__(self, k: int, same: bool, low: int = _LEAST, high: int = _MOST):
        self.k, self.same, self.low, self.high = k, same, max(low, _LEAST), min(high, _MOST)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bound(self) -> int:
        """A row must score this much to come in."""
        if self.low > self.high:
            return _MOST + 1
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
        if self.low > self.high:
            return
        fits = (same == self.same) & (scores >= max(self.bound(), self.low)) & (scores <= self.high)
        if not fits.any():
            return
        s, i = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.ids, ids[fits]])
        if len(s) > 8 * self.k:
            edge = np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[s >= edge], i[s >= edge]
        at = np.lexsort((i, ~s))[: self.k]  # ~s falls as s grows, without overflow
        self.scores, self.ids = s[at], i[at]


def search(part: Slice, anchor: np.ndarray, label: int, own: int, windows: list[Best]) -> int:
    """Takes the slice's rows into the windows; the number of rows scored."""
    n = len(part.ids)
    anchor = anchor if part.exact else np.array([int(x) for x in anchor], object)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)

    def reached(depth: int) -> bool:
        """No row that all lists have below ``depth`` can come into a window."""
        t = (part.sorted[n - 1 - depth, up] * anchor[up]).sum() + (part.sorted[depth, down] * anchor[down]).sum()
        t = min(max(int(t), _LEAST), _MOST)
        return all(t < w.bound() for w in windows)

    if not n or (reached(0) and len(up) + len(down)):
        return 0
    seen, depth, step = np.zeros(n, bool), 0, max(16, n // FIRST)
    while True:
        to = min(n, depth + step)
        now = seen.copy()
        if len(up) + len(down):
            now[part.order[n - to : n - depth, up]] = True
            now[part.order[depth:to, down]] = True
        else:  # all scores are zero
            now[:], to = True, n
        fresh = np.flatnonzero(now & ~seen)
        fresh = fresh[part.ids[fresh] != own]
        scores, same = part.scores(fresh, anchor), part.labels[fresh] == label
        for w in windows:
            w.offer(scores, part.ids[fresh], same)
        seen, depth, step = now, to, 2 * step
        if depth == n or seen.all() or reached(depth):
            return int(seen.sum())


def _slices(batches: Iterator[pa.RecordBatch], width: int, peak: float, scale: int) -> Iterator[Slice]:
    held: list[pa.RecordBatch] = []

    def made() -> Slice:
        t = pa.Table.from_batches(held).combine_chunks()
        vectors = t.column("vector").combine_chunks()
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        return Slice(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _matrix(vectors, scale, width), peak)

    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            piece = batch.slice(a, SLICE)
            if held and sum(b.num_rows for b in held) + piece.num_rows > SLICE:
                yield made()
                held = []
            held.append(piece)
    if sum(b.num_rows for b in held):
        yield made()


def _top(rows: DataFrame, asked: pa.Table, windows: dict, scale: int) -> DataFrame:
    """(anchor_id, place, vec_id, score): of each partition of ``rows`` the best of each window. ``windows``: for each anchor the arguments of its ``Best``."""
    vectors = asked.column("vector").combine_chunks()
    anchors = _matrix(vectors, scale) if asked.num_rows else np.zeros((0, 0))
    whose = [(int(i), int(l), windows.get(int(i), [])) for i, l in zip(asked.column("vec_id").to_pylist(), asked.column("label").to_pylist())]
    shared = rows.sparkSession.sparkContext.broadcast((whose, anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, anchors = shared.value
        found = [[Best(*w) for w in ws] for _, _, ws in whose]
        for part in _slices(batches, anchors.shape[1], float(np.abs(anchors).max(initial=0)), scale):
            for (own, label, ws), anchor, best in zip(whose, anchors, found):
                if ws:
                    search(part, anchor, label, own, best)
        rows_ = [(own, p, b) for (own, _, _), bs in zip(whose, found) for p, b in enumerate(bs) if len(b.ids)]
        if rows_:
            n = [len(b.ids) for _, _, b in rows_]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([r[0] for r in rows_], n)), pa.array(np.repeat([r[1] for r in rows_], n).astype(np.int32)), pa.array(np.concatenate([b.ids for _, _, b in rows_])), pa.array(np.concatenate([b.scores for _, _, b in rows_]))],
                names=["anchor_id", "place", "vec_id", "score"])

    return map_arrow(rows.select("vec_id", "label", "vector"), run, "anchor_id bigint, place int, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``is_anchor`` holds for and each of its first ``positives``, the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` hundredths of the positive's."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(vector).alias("vector"), is_anchor.alias("is_anchor"))
    rows = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    least = rows.where("is_anchor").groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("x")).select("vec_id", "x.vector", "x.label")
    blocks = max(1, math.ceil(least.count() / (0.8 * block)))
    out = None
    for b in range(blocks):
        asked = least.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about 0.8 of a block's rows
        ids = asked.column("vec_id").to_pylist()
        near = stage(_ranked(_top(rows, asked, {i: [(positives, True)] for i in ids}, scale), positives), "positives")
        windows: dict[int, list[tuple]] = {i: [] for i in ids}
        pairs = near.orderBy("anchor_id", "rank").toArrow()  # at most ``positives`` rows for each of the block's anchors
        for i, s in zip(pairs.column("anchor_id").to_pylist(), pairs.column("score").to_pylist()):
            windows[i].append((negatives, False, -(-low * s // 100), high * s // 100))
        far = _ranked(_top(rows, asked, windows, scale), negatives).select("anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        own = near.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        got = far.join(own, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        done = stage(got, "negatives") if blocks > 1 else got
        out = done if out is None else out.union(done)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: every vector whose id is divisible by 100. Where 7 divides the id, the label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.e, c.e)::bigint as score from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select * from (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= 5),
n as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score, (row_number() over (partition by p.anchor_id, k order by s.score desc, s.vec_id))::int as rank
    from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10"""
