"""Exact top-k search by inner product of quantised vectors.

Exhaustive term-at-a-time accumulation: a slice of the candidates is turned into postings, for each dimension the rows
with a weight there; each query's non-zero dimensions are its terms, and term by term the weighted postings are scattered into a
dense array of scores. Partition selection keeps each query's best of the slice, merged with the best so far; what is left
of each partition (k rows a query) is merged over all partitions. The queries are broadcast in blocks of at most ``block`` rows over all candidates,
whatever their number; of several blocks one is on the driver at a time, since each block's result is written before the next is read.

Scores are exact. Vectors whose components are so large that a 64-bit sum could overflow are multiplied in unbounded integers, the others in 64 bits.

Defined results: vectors that are null or hold a null or non-finite component take no part; an empty vector
has the score 0 with all. Vectors of different lengths are compared as if zeros followed the shorter. The score is a long:
an inner product beyond its range counts as the end of the range. Ties go to the smaller vec_id. Where one vec_id has several rows, as a query it is the least of its vectors, as candidates
each row counts; rows with the query's own id never do. Rows with a null id take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veinwork.llm.scratch import map_arrow, stage, table

#: Queries that one broadcast has, queries that are scored together, candidates of one slice.
BLOCK, TOGETHER, SLICE = 8192, 256, 4096
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(vectors: pa.Array, scale: int, width: int | None = None) -> np.ndarray:
    """Rows of quantised components (whole numbers, as doubles, which hold them exactly), zeros after the shorter ones."""
    ends = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)
    use = col < width  # a component beyond all queries meets zeros only
    out[row[use], col[use]] = np.floor(scale * flat[ends[0] : ends[-1]][use])
    return out


def _scatter(queries: np.ndarray, rows: np.ndarray, kind: type) -> np.ndarray:
    """Scores of all rows for each query, a term at a time, in numbers of one kind."""
    scores = np.zeros((len(queries), len(rows)), kind)
    terms, postings = queries.T.astype(kind), np.ascontiguousarray(rows.T).astype(kind)
    for own, weights in zip(terms, postings):
        asking, at = np.flatnonzero(own), np.flatnonzero(weights)
        if not len(asking) or not len(at):
            continue
        if 2 * len(at) >= len(weights):  # most rows have this term: the posting is added whole, zeros with it, which is far quicker than by places
            if 2 * len(asking) >= len(own):
                scores += own[:, None] * weights
            else:
                scores[asking] += own[asking, None] * weights
        else:
            scores[asking[:, None], at] += own[asking, None] * weights[at]
    return scores


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers, exact within their range. 32 or 64 bits where no sum can overflow, else unbounded integers."""
    width = max(1, queries.shape[1])
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width
    if peak < 1 << 31:
        return _scatter(queries, rows, np.int32).astype(np.int64)
    if peak < 1 << 62:
        return _scatter(queries, rows, np.int64)
    safe = math.isqrt((1 << 62) // width)
    big_q, big_r = np.abs(queries).max(axis=1) > safe, np.abs(rows).max(axis=1) > safe
    out = np.zeros((len(queries), len(rows)), np.int64)
    out[np.ix_(~big_q, ~big_r)] = _scatter(queries[~big_q], rows[~big_r], np.int64)
    whole = np.frompyfunc(int, 1, 1)
    for q, r in ((big_q, np.ones(len(rows), bool)), (~big_q, big_r)):
        if q.any() and r.any():
            got = _scatter(whole(queries[q]), whole(rows[r]), object)
            out[np.ix_(q, r)] = np.frompyfunc(lambda x: min(max(x, _LEAST), _MOST), 1, 1)(got).astype(np.int64)
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best (scores, ids, whether there is one), ties to the smaller id. ``ids`` is ascending."""
    real = ids[None, :] != own[:, None]
    low = np.where(real, scores, _LEAST)
    k = min(k, len(ids))
    edge = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
    out = np.zeros((len(own), k), np.int64)
    for i, row in enumerate(low):
        over = np.flatnonzero(row > edge[i])
        tied = np.flatnonzero(row == edge[i])
        tied = tied[np.argsort(~real[i, tied], kind="stable")][: k - len(over)]  # in the order of the ids, the query's own last
        at = np.concatenate([over, tied])
        out[i] = at[np.lexsort((at, ~real[i, at], ~row[at]))] if len(at) else 0  # ~x falls as x grows, without overflow
    return np.take_along_axis(scores, out, 1), ids[out], np.take_along_axis(real, out, 1)


def _search(rows: DataFrame, part: pa.Table, k: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score): of each partition of ``rows`` the k best for each of one block's queries."""
    vectors = part.column("vector").combine_chunks()
    own_ids = part.column("vec_id").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((own_ids, _matrix(vectors, scale) if part.num_rows else np.zeros((0, 0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        kept: list[tuple | None] = [None] * math.ceil(len(own) / TOGETHER)
        for batch in batches:
            for a in range(0, batch.num_rows if len(own) else 0, SLICE):
                piece = batch.slice(a, SLICE).take(pa.array(np.arange(min(SLICE, batch.num_rows - a))))
                ids = piece.column("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, rows_ = ids[order], _matrix(piece.column("vector"), scale, queries.shape[1])[order]
                for g in range(len(kept)):
                    q = slice(g * TOGETHER, (g + 1) * TOGETHER)
                    s, i, r = best(accumulate(queries[q], rows_), ids, own[q], k)
                    if kept[g] is not None:
                        s, i, r = (np.concatenate(x, axis=1) for x in zip(kept[g], (s, i, r)))
                        at = np.lexsort((i, ~s, ~r), axis=1)[:, :k]
                        s, i, r = (np.take_along_axis(x, at, 1) for x in (s, i, r))
                    kept[g] = (s, i, r)
        for g, found in enumerate(kept):
            if found is not None:
                s, i, r = found
                ids = np.repeat(own[g * TOGETHER : (g + 1) * TOGETHER], s.shape[1])[r.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(i.ravel()[r.ravel()]), pa.array(s.ravel()[r.ravel()])], names=["query_id", "vec_id", "score"])

    return map_arrow(rows.select("vec_id", "vector"), run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for, the k highest integer inner products."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("is_query")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    asked = rows.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, math.ceil(asked.count() / (0.8 * block)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about 0.8 of a block's rows
        ranked = _search(rows, part, k, scale).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        done = stage(ranked, "nearest") if blocks > 1 else ranked  # k rows a query
        out = done if out is None else out.union(done)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all ``embeddings`` for every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
