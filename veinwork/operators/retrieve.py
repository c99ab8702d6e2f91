"""Retrieval of many questions at once over all chunks.

A question set is taken in blocks, each of which is broadcast; the chunks are scanned once for the terms' document frequencies and once
for the scores; what both scans read is cut and folded once and written. A slice of chunks is matched against all terms of a block at once (``scan``), and each
partition sends only its K best per question, so what is shuffled does not grow with questions times chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from veinwork.functions.text import dense, drop_meta, filled, fold, garbled, meta_value, strip, summary_body, weak_title
from veinwork.operators.scan import Asked
from veinwork.operators.score import quality_terms
from veinwork.operators.terms import fast_terms, method_question, profile_of
from veinwork.domain import REGULATIONS, Profile
from veinwork.scratch import stage
from veinwork.ship import ship

#: Questions that one broadcast has.
BLOCK = 2048


def features(chunks: DataFrame, profile: Profile = REGULATIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """What scoring needs of the chunk table (ord, title, law_title, article_no, content): compact texts and what
    each chunk gets whatever the question. Columns to ``keep`` come behind."""
    chunks = spread(chunks)
    content = F.substring(filled(F.col("content")), 1, profile.max_index_chars)
    marked = F.contains(F.col("content"), F.lit("["))  # most chunks have no marked lines, which costs no pattern then
    given = [F.col("title_compact")] if "title_compact" in chunks.columns else []
    got = chunks.select("ord", filled(F.col("title")).alias("title"), filled(F.col("law_title")).alias("law"), filled(F.col("article_no")).alias("article"), content.alias("content"), *given, *keep)
    got = got.withColumn("body", F.when(marked, drop_meta(F.col("content"), profile)).otherwise(strip(F.col("content"))))
    said = lambda k: F.contains(F.col("content"), F.lit(f"[{k}] true"))
    extra = [dense(fold(meta_value(F.col("content"), k))) for k in ("文号", "发文机关", "发布日期", "施行日期")]
    compact = lambda c: F.col(f"{c}_compact") if given and c == "title" else dense(fold(F.col(c)))
    out = got.select(
        "ord", *keep, fold("body").alias("body_folded"), "body", "title", F.when(marked, F.concat(*extra)).otherwise("").alias("extra_compact"),
        *(compact(c).alias(f"{c}_compact") for c in ("title", "law", "article")), said("疑似扫描").alias("scanned"),
        (said("疑似摘要页") | summary_body(F.col("body"), profile)).alias("summary"), (said("疑似乱码") | garbled(F.col("body"), True)).alias("garbled"), weak_title(F.col("title"), profile).alias("weak"),
    )
    out = derived(out)
    own = quality_terms(F.length("body_compact"), F.col("article_compact"), F.col("law_compact"), F.col("summary"), F.col("scanned"), F.col("garbled"), F.col("weak"))
    return out.select("ord", "full", "body_folded", "body_compact", "title_compact", "law_compact", "article_compact", "extra_compact", "scanned", "summary", "garbled", "weak", F.length("body_compact").alias("body_length"), own.alias("own"), *keep)


def derived(rows: DataFrame) -> DataFrame:
    """With the texts that follow from the others."""
    rows = rows.withColumn("body_compact", F.replace("body_folded", F.lit(" ")))
    return rows.withColumn("full", F.concat("title_compact", "law_compact", "article_compact", "extra_compact", "body_compact"))


def _blocks(questions: DataFrame, make, *columns) -> Iterator:
    """The question set in blocks of bounded size, each collected to be broadcast; ``columns`` are worked out for each block."""
    blocks = max(1, math.ceil(questions.count() / (0.8 * BLOCK)))
    for b in range(blocks):
        part = questions.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else questions
        yield make(sorted(part.select("qid", *columns).collect(), key=lambda r: r["qid"]))


#: The columns that a chunk's text is made of, in order, without the spaces of the last.
_TEXT = ["title_compact", "law_compact", "article_compact", "extra_compact", "body_folded"]
#: Rows and characters of a slice of chunks, bits of its table of hits, and rows whose scores are held before the best are taken.
ROWS, CHARACTERS, HIT_BITS, HELD = 64, 1 << 16, 1 << 24, 1024


class Slice:
    """Some chunks as Python lists by column; a column that isn't there is empty."""

    def __init__(self, batch: pa.RecordBatch):
        self.columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        self.n = batch.num_rows

    def __getitem__(self, column: str) -> list:
        return self.columns.get(column) or [""] * self.n

    def texts(self, asked: Asked) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The chunks' texts, of a title only the end that a term can stand in together with what follows; where the bodies begin; and what the titles hold."""
        end = lambda t: t[max(0, len(t) - max(0, asked.longest - 1)) :]
        head = [f"{end(t)}{law}{a}{e}" for t, law, a, e in zip(*(self[c] for c in _TEXT[:4]))]
        return [h + b.replace(" ", "") for h, b in zip(head, self["body_folded"])], np.array([*map(len, head)], np.int64), asked.hits(self["title_compact"])


def _slices(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[tuple[Slice, np.ndarray]]:
    """Chunks in slices of bounded size (one row at least), and their places, where they have any."""
    rows = max(1, min(ROWS, HIT_BITS // max(1, terms)))
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.schema.names if pa.types.is_string(batch.schema.field(c).type))
        part = np.cumsum(size) // CHARACTERS
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, min(a + rows, int(np.searchsorted(part, part[a], "right"))))
            piece = batch.slice(a, b - a)
            yield Slice(piece), piece.column("ord").to_numpy() if "ord" in piece.schema.names else None
            a = b


def _frequencies(texts: DataFrame, columns: list[str], asked: Asked) -> tuple[dict[int, int], int]:
    """In how many texts each term occurs, and the number of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        total, n = np.zeros(len(asked.all), np.int64), 0
        for part, _ in _slices(batches, len(asked.all)):
            read, _, title = part.texts(asked)
            total += np.count_nonzero(asked.read(read, np.zeros(part.n, np.int64), asked.words)[0][0] | title, axis=0)
            n += part.n
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *total[at].tolist()], pa.int64())], names=["term", "n"])

    ship(texts.sparkSession)
    got = spread(texts.select(*columns)).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each of the block's terms
    df = {r["term"]: r["n"] for r in got}
    return df, df.pop(-1, 0)


def _local_top(rows: DataFrame, columns: list[str], score, asked, k: int, id_type: str) -> DataFrame:
    """Scores every row for all questions of the block; each partition keeps its k best of each."""
    shared = rows.sparkSession.sparkContext.broadcast((asked, score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, score = shared.value
        best, kth = [(np.zeros(0), np.zeros(0, np.int64)) for _ in asked.ids], np.full(len(asked.ids), -np.inf)
        scores, orders = [], []

        def merge():
            s, o = np.concatenate(scores), np.concatenate(orders)
            fits = s >= kth
            for q in np.flatnonzero(fits.any(axis=0)).tolist():
                at = np.flatnonzero(fits[:, q])
                got, places = np.concatenate([best[q][0], s[at, q]]), np.concatenate([best[q][1], o[at]])
                at = np.lexsort((places, -got))[:k]
                best[q] = got[at], places[at]
                if len(at) == k:
                    kth[q] = got[at[-1]]
            scores.clear()
            orders.clear()

        for part, order in _slices(batches, len(asked.all)):
            scores.append(np.round(score(asked, part), 6))
            orders.append(order)
            if sum(map(len, orders)) >= HELD:
                merge()
        if orders:
            merge()
        n = [len(o) for _, o in best]
        ids = [i for i, m in zip(asked.ids, n) for _ in range(m)]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string() if id_type == "string" else pa.int64()), pa.array(np.concatenate([o for _, o in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["qid", "ord", "score"])

    ship(rows.sparkSession)
    return spread(rows.select("ord", *columns)).mapInArrow(run, f"qid {id_type}, ord bigint, score double")


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The k best rows, by score and then by place."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
        return keep[np.lexsort((order[keep], -scores[keep]))][:k]
    return np.lexsort((order, -scores))[:k]


def _merged(parts: list[DataFrame], k: int) -> DataFrame:
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("ord"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lexical(asked: Asked, part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, question) of the scores that depend on both, and what each chunk gets whatever the question."""
    texts, begin, title = part.texts(asked)
    (body, early), longest = asked.read(texts, begin, asked.trie)
    law, article = asked.hits(part["law_compact"]), asked.hits(part["article_compact"])
    in_title = asked.coverage(asked.terms, title)
    boost = np.zeros(longest.shape)
    for a in {a for a in asked.articles if a}:
        mine = np.array([x == a for x in asked.articles])
        boost[:, mine] = np.array([0.25 if x == a else 0.10 if a in b else 0.0 for x, b in zip(part["article_compact"], part["body_folded"])])[:, None]
    lexical = (
        0.36 * asked.coverage(asked.terms, body | early | title) + 0.20 * asked.coverage(asked.phrases, body) + 0.18 * (in_title + asked.coverage(asked.terms, (law | article) & ~title))
        + 0.12 * in_title + 0.08 * asked.coverage(asked.terms, law) + 0.06 * _share(asked, longest) + boost
    )
    return lexical, np.array(part["own"], float)[:, None]


def _share(asked: Asked, longest: np.ndarray) -> np.ndarray:
    upper = asked.trie.upper
    return np.divide(longest, upper, out=np.zeros(longest.shape), where=upper > 0)


def _plain(asked: Asked, part: Slice) -> np.ndarray:
    lexical, own = _lexical(asked, part)
    return lexical + own


class _Hybrid:
    """Adds the cosine of the vectors where both sides have one."""

    def __init__(self, vectors: list):
        n = max([1, *(len(v) for v in vectors if v is not None)])
        self.has = np.array([v is not None and len(v) > 0 for v in vectors])
        self.size = np.array([len(v) if v is not None else 0 for v in vectors])
        self.v = np.zeros((len(vectors), n))
        for i, v in enumerate(vectors):
            if v is not None:
                self.v[i, : len(v)] = v
        self.norm = np.sqrt((self.v**2).sum(axis=1))

    def __call__(self, asked: Asked, part: Slice) -> np.ndarray:
        lexical, own = _lexical(asked, part)
        vectors = part.columns["vector"]
        there = [i for i, v in enumerate(vectors) if v is not None]
        if there:
            d, norm, size = np.zeros((len(there), self.v.shape[1])), np.zeros((len(there), 1)), np.zeros((len(there), 1), np.int64)
            for i, k in enumerate(there):
                v = np.array(vectors[k], float)
                d[i, : min(len(v), d.shape[1])] = v[: d.shape[1]]
                norm[i], size[i] = np.sqrt((v**2).sum()), len(v)
            usable = self.has & (self.size == size) & (self.norm > 0) & (norm > 0)
            cos = np.divide(d @ self.v.T, self.norm * norm, out=np.zeros(usable.shape), where=usable)
            semantic = np.where(usable, (cos + 1) * 0.5, 0.0)
            lexical[there] = np.where(self.has, lexical[there] * 0.66 + semantic * 0.34, lexical[there])
        return lexical + own


class _Part:
    """One part of the lexical score on its own: coverage, phrases, fields or exact."""

    COLUMNS = {"coverage": _TEXT, "phrases": _TEXT[4:], "fields": _TEXT[:3], "exact": _TEXT[4:]}

    def __init__(self, name: str):
        self.name = name

    def __call__(self, a: Asked, part: Slice) -> np.ndarray:
        if self.name == "fields":
            return a.coverage(a.terms, a.hits(part["title_compact"]) | a.hits(part["law_compact"]) | a.hits(part["article_compact"]))
        texts, begin, title = part.texts(a)
        (body, early), longest = a.read(texts, begin, a.trie if self.name == "exact" else a.words)
        if self.name == "exact":
            return _share(a, longest)
        return a.coverage(a.terms, body | early | title) if self.name == "coverage" else a.coverage(a.phrases, body)


def spread(df: DataFrame) -> DataFrame:
    """Dealt out to all cores, where it comes in fewer parts."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def scanned(chunk_features: DataFrame) -> DataFrame:
    """What the scans read of the features, no text twice, as a written table; one that was made here stays as it is."""
    if getattr(chunk_features, "_scanned", False):
        return chunk_features
    out = stage(chunk_features.select("ord", *_TEXT, "own"), "scan")
    out._scanned = True
    return out


def retrieve(chunk_features: DataFrame, questions: DataFrame, k: int = REGULATIONS.top_k, profile: Profile = REGULATIONS, vectors: DataFrame | None = None, places: int = 1, part: str | None = None) -> DataFrame:
    """(qid, ord, score, rank): each question's k best chunks, by the whole score or one ``part`` of it. ``questions``: (qid, question) and, for hybrid scores, vector;
    ``vectors``: (ord, vector) of the chunks, or one for each run of so many ``places``, which all its chunks share. Questions without terms have no result. Scores are rounded to six places, ties go to the smaller ord."""
    id_type = questions.schema["qid"].dataType.simpleString()
    hybrid, parts = "vector" in questions.columns and vectors is not None, []
    weighed = part != "exact"  # the longest part of a question has no weights, so one scan does
    read = scanned(chunk_features) if weighed else chunk_features
    rows = read.join(vectors.select(F.col("ord").alias("run"), "vector"), F.expr(f"ord div {places}") == F.col("run"), "left") if hybrid else read
    columns = [*_Part.COLUMNS[part]] if part else [*_TEXT, "own", *["vector"] * hybrid]

    def make(got: list) -> tuple:
        got = [r for r in got if r["p"]["terms"] or r["p"]["phrases"]]
        asked = Asked([r["qid"] for r in got], [r["p"]["terms"] for r in got], [r["p"]["phrases"] for r in got], [r["p"]["compact"] for r in got], [r["p"]["article"] for r in got])
        return asked, _Hybrid([r["vector"] for r in got]) if hybrid else _Part(part) if part else _plain

    for asked, score in _blocks(questions, make, profile_of(F.col("question"), profile).alias("p"), *["vector"] * hybrid):
        if weighed:
            asked.weigh(*_frequencies(read, _TEXT, asked))
        parts.append(_local_top(rows, columns, score, asked, k, id_type))
    return _merged(parts, k)


def term_idf(chunk_features: DataFrame, questions: DataFrame, profile: Profile = REGULATIONS) -> DataFrame:
    """(term, df, idf) of all the questions' terms over all chunks."""
    spark = chunk_features.sparkSession
    parts = []
    for asked in _blocks(questions, lambda got: Asked([r["qid"] for r in got], [r["p"]["terms"] for r in got], [[] for _ in got], [""] * len(got), [""] * len(got)), profile_of(F.col("question"), profile).alias("p")):
        df, n = _frequencies(chunk_features, _TEXT, asked)
        parts.append(spark.createDataFrame([(t, int(df.get(i, 0)), math.log((n + 1.0) / (df.get(i, 0) + 0.5)) + 1.0) for i, t in enumerate(asked.all)], "term string, df bigint, idf double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _fast(asked: Asked, part: Slice) -> np.ndarray:
    c = lambda column: asked.coverage(asked.terms, asked.hits(part[column]))
    return c("content") * 0.54 + c("title") * 0.20 + c("doc_no") * 0.16 + c("article_no") * 0.10 + np.array(part["own"], float)[:, None]


def fast_recall(chunks: DataFrame, questions: DataFrame, k: int = REGULATIONS.fast_recall, profile: Profile = REGULATIONS) -> DataFrame:
    """(qid, ord, score, rank): the first stage over (ord, title, doc_no, article_no, content, content_type)."""
    from veinwork.functions.text import squeeze

    own = F.when(F.lower("content_type") == "structured_text", 0.08).otherwise(0.0) + F.when(dense(F.col("article_no")) != "", 0.04).otherwise(0.0)
    texts = chunks.select("ord", squeeze(F.concat_ws(" ", *(filled(F.col(c)) for c in ("title", "doc_no", "article_no", "content")))).alias("extra_compact"), *(squeeze(F.col(c)).alias(c) for c in ("content", "title", "doc_no", "article_no")), own.alias("own"))
    id_type = questions.schema["qid"].dataType.simpleString()
    parts = []
    for asked in _blocks(questions, lambda got: Asked([r["qid"] for r in got], [r["terms"] for r in got], [[] for _ in got], [""] * len(got), [""] * len(got)), fast_terms(F.col("question"), profile).alias("terms")):
        df, n = _frequencies(texts, ["extra_compact"], asked)
        asked.weigh(df, max(n, 1))
        parts.append(_local_top(texts, ["content", "title", "doc_no", "article_no", "own"], _fast, asked, k, id_type))
    return _merged(parts, k)


def _second(asked: str, text: str) -> float:
    """Pairs of characters in common, and the longest fragment of the question that the text holds, as in ``score.rerank``."""
    a, b = ({t[i : i + 2] for i in range(len(t) - 1)} or {t} for t in (asked, text))
    same, n = len(a & b), len(asked)
    phrase = 0.0
    if n >= 4:
        phrase = 1.0 if asked in text else next((k / min(12, n) for k in range(min(12, n), 3, -1) if any(asked[i : i + k] in text for i in range(n - k + 1))), 0.0)
    return same / (len(a) + len(b) - same) * 0.28 + phrase * 0.10


def second_stage(rows: DataFrame, k: int = REGULATIONS.fast_rerank) -> DataFrame:
    """(qid, ord, score, rank): the k best of the first stage's rows (qid, ord, first, asked, text), both texts squeezed, re-scored; with a column ``semantic`` rows that have one are scored with it too."""
    id_type = rows.schema["qid"].dataType.simpleString()
    hybrid = "semantic" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, first, asked, text = (b.column(c).to_pylist() for c in ("qid", "first", "asked", "text"))
            meant = b.column("semantic").to_pylist() if hybrid else [None] * len(first)
            lexical = [f * 0.62 + _second(a or "", t or "") for f, a, t in zip(first, asked, text)]
            scores = [round(s if m is None else s * 0.58 + m * 0.42, 6) for s, m in zip(lexical, meant)]
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("ord"), pa.array(scores, pa.float64())], names=["qid", "ord", "score"])

    ship(rows.sparkSession)
    return _merged([spread(rows).mapInArrow(run, f"qid {id_type}, ord bigint, score double")], k)


def merge_best(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Two result lists (qid, ord, score) as one: the better score of each chunk, the best ``limit``."""
    both = first.select("qid", "ord", "score").union(second.select("qid", "ord", "score")).groupBy("qid", "ord").agg(F.max("score").alias("score"))
    return _merged([both], limit)


def with_method_anchor(chunk_features: DataFrame, questions: DataFrame, k: int = REGULATIONS.top_k, profile: Profile = REGULATIONS) -> DataFrame:
    """(qid, ord, score, rank): the k best chunks, and for questions about ways of procurement also the best of the profile's anchor query (twice as many, 48 at least), the better score of each chunk.
    The anchor's list is the same for all, so it is retrieved once: at most 2k rows, handed to each such question."""
    spark, more = chunk_features.sparkSession, max(2 * k, 48)
    chunk_features = scanned(chunk_features)  # once for both
    first = retrieve(chunk_features, questions, k, profile)
    anchor = retrieve(chunk_features, spark.createDataFrame([(0, profile.method_anchor)], "qid bigint, question string"), more, profile).collect()
    asked = questions.where(method_question(fold(F.col("question"))))
    found = F.array(*(F.struct(F.lit(r["ord"]).cast("bigint").alias("ord"), F.lit(r["score"]).alias("score")) for r in anchor)) if anchor else F.array().cast("array<struct<ord:bigint,score:double>>")
    second = asked.select("qid", F.explode(found).alias("a")).select("qid", "a.ord", "a.score")
    return merge_best(first, second, max(3 * k, 72))


def number_first(results: DataFrame, matches: Column, plain: DataFrame, k: int) -> DataFrame:
    """Of a wide result, the k best rows that match; questions without any take the plain result."""
    hits = _merged([results.where(matches).select("qid", "ord", "score")], k)
    return hits.union(plain.join(hits.select("qid").distinct(), "qid", "left_anti").select(hits.columns))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, ord, score, rank): the k vectors with the highest mapped cosine, by brute force over all, in blocks of queries."""
    id_type = queries.schema["qid"].dataType.simpleString()
    parts = []

    class Block:
        def __init__(self, got):
            self.ids, self.h = [r["qid"] for r in got], _Hybrid([r["vector"] for r in got])

    for asked in _blocks(queries, Block, "vector"):
        v, norm, ids = asked.h.v, asked.h.norm, asked.ids
        shared = vectors.sparkSession.sparkContext.broadcast((v, norm, ids))

        def run(batches, shared=shared):
            v, norm, ids = shared.value
            s, o = np.zeros((len(ids), 0)), np.zeros(0, np.int64)
            best = [(np.zeros(0), o)] * len(ids)
            for batch in batches:
                rows = [np.array(x if x is not None else [], float) for x in batch.column("vector").to_pylist()]
                d = np.zeros((len(rows), v.shape[1]))
                for i, x in enumerate(rows):
                    if len(x) == v.shape[1]:
                        d[i] = x
                size = np.sqrt((d**2).sum(axis=1))
                cos = np.divide(v @ d.T, norm[:, None] * size, out=np.full((len(ids), len(rows)), -1.0), where=(norm[:, None] * size) > 0)
                s, o = np.round((cos + 1) * 0.5, 6), batch.column("ord").to_numpy()
                for q in range(len(ids)):
                    a, b = np.concatenate([best[q][0], s[q]]), np.concatenate([best[q][1], o])
                    at = _best(a, b, k)
                    best[q] = (a[at], b[at])
            many = [i for i, (x, _) in zip(ids, best) for _ in range(len(x))]
            if many:
                yield pa.RecordBatch.from_arrays([pa.array(many, pa.string() if id_type == "string" else pa.int64()), pa.array(np.concatenate([b for _, b in best])), pa.array(np.concatenate([a for a, _ in best]))], names=["qid", "ord", "score"])

        ship(vectors.sparkSession)
        parts.append(vectors.select("ord", "vector").mapInArrow(run, f"qid {id_type}, ord bigint, score double"))
    return _merged(parts, k)


