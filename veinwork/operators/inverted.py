"""Exact top lists from an inverted index, without a scan of the chunks.

The index is built once for a chunk table and used by any number of questions: ``postings`` (gram, ord, mask) has every substring of two to four characters of a chunk's compact text with the fields that hold it,
in buckets by gram; ``grams`` (gram, df) is its dictionary. A term of up to four characters is a gram; a longer one is looked up by its rarest gram, and the chunks found are
checked against their text.

A question is then answered by the threshold principle. Every term's list has a bound on what it can add to a score. The chunks in a question's rarest lists are scored first; their kth score is
a floor. Lists are then needed only, from the rarest on, until all that the remaining ones could add together stays below the floor: a chunk that stands in none of the needed lists can't be among the k best. Candidates
get their sums from the lists, and only those whose bound still reaches the floor are read and compared by text. All of it is joins and grouped sums over tables; what is shuffled are list
entries of the terms that are asked for, and no list or question is ever gathered in one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veinwork.domain import REGULATIONS, Profile
from veinwork.functions.text import bind
from veinwork.operators.retrieve import derived, spread
from veinwork.operators.score import idf
from veinwork.operators.terms import grams as grams_of, profile_of
from veinwork.scratch import bucketed, stage
from veinwork.ship import ship

LOW, HIGH = 2, 4
FULL, BODY, TITLE, LAW, ARTICLE = 1, 2, 4, 8, 16
#: List entries by which a question's first candidates are found, and the part of a score that only the text gives.
FIRST, TEXT_PART = 2000, 0.06
#: Scores are rounded to six places: bounds that are no further apart are taken as equal.
SLACK = 2e-6
_FIELDS = {"full": FULL, "body_compact": BODY, "title_compact": TITLE, "law_compact": LAW, "article_compact": ARTICLE}


@dataclass(frozen=True)
class Index:
    features: DataFrame  # as of ``retrieve.features``
    postings: DataFrame  # gram, ord, mask
    grams: DataFrame  # gram, df
    size: int  # chunks


#: Entries of one Arrow batch, about.
ENTRIES = 1 << 16


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ord, mask) of chunks (ord and the fields), and behind them the other columns of the chunk."""
    said = {bit: ("", set()) for bit in _FIELDS.values()}  # chunks of one document have their title in common
    for batch in batches:
        columns = [(bit, batch.column(c).to_pylist()) for c, bit in _FIELDS.items()]
        others = ["ord", *(c for c in batch.schema.names if c != "ord" and c not in _FIELDS)]
        grams, masks, rows = [], [], []
        for row in range(batch.num_rows):
            found: dict[str, int] = {}
            for bit, texts in columns:  # the first holds all others
                t = texts[row] or ""
                if said[bit][0] != t:
                    said[bit] = (t, {t[i : i + n] for n in range(LOW, HIGH + 1) for i in range(len(t) - n + 1)})
                for g in said[bit][1]:
                    found[g] = found.get(g, 0) | bit
            grams.extend(found)
            masks.extend(found.values())
            rows.append((row, len(found)))
            if len(grams) >= ENTRIES or row == batch.num_rows - 1:
                at = pa.array(np.repeat(*np.array(rows).T))
                first, *rest = (batch.column(c).take(at) for c in others)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), first, pa.array(masks, pa.int32()), *rest], names=["gram", "ord", "mask", *others[1:]])
                grams, masks, rows = [], [], []


def build(chunk_features: DataFrame, buckets: int | None = None) -> Index:
    """The index of a chunk table's features."""
    spark = chunk_features.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    features = derived(stage(chunk_features.drop("full", "body_compact"), "features")).select(chunk_features.columns)  # no text twice on disk
    ship(spark)
    entries = spread(features.select("ord", *_FIELDS)).mapInArrow(_posted, "gram string, ord bigint, mask int")
    postings = bucketed(entries, "postings", "gram", buckets)
    return Index(features, postings, bucketed(postings.groupBy("gram").agg(F.count("*").alias("df")), "grams", "gram", buckets), features.count())


def _hits(index: Index, terms: DataFrame) -> DataFrame:
    """(term, ord, mask) of every chunk that holds one of the ``terms`` (term), distinct and of two characters or more."""
    long = terms.where(F.length("term") > HIGH).select("term", F.explode(F.array_distinct(grams_of(F.col("term"), HIGH))).alias("gram"))
    known = long.join(index.grams, "gram", "left")  # a gram that no chunk has: neither the term
    rarest = known.groupBy("term").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("x")).where("x.df > 0").select("term", F.col("x.gram").alias("gram"))
    short = terms.where(F.length("term") <= HIGH).join(index.postings, F.col("term") == F.col("gram")).select("term", "ord", "mask")
    near = rarest.join(index.postings.select("gram", "ord"), "gram").select("term", "ord")
    said = None
    for c, bit in _FIELDS.items():
        one = F.when(F.contains(F.col(c), F.col("term")), bit).otherwise(0)
        said = one if said is None else said + one
    checked = near.join(index.features.select("ord", *_FIELDS), "ord").select("term", "ord", said.cast("int").alias("mask")).where("mask > 0")
    return short.union(checked)


def _has(mask: Column, bits: int) -> Column:
    return F.when(mask.bitwiseAND(F.lit(bits)) != 0, 1.0).otherwise(0.0)


def longest_shared(query: Column, text: Column, low: int, high: int) -> Column:
    """As ``score.longest_shared``, by halves: a text that shares n characters shares n - 1."""
    if low == high:
        return F.when(F.exists(grams_of(query, low), lambda g: F.contains(text, g)), low).otherwise(low - 1)
    mid = (low + high + 1) // 2
    hit = F.exists(grams_of(query, mid), lambda g: F.contains(text, g))
    return F.when(hit, longest_shared(query, text, mid + 1, high) if mid < high else F.lit(mid)).otherwise(longest_shared(query, text, low, mid - 1) if mid > low else F.lit(low - 1))


def _fragment(query: Column, text: Column) -> Column:
    n = F.length(query)
    share = bind(longest_shared(query, text, 4, 12), lambda k: F.when(k < 4, 0).otherwise(k))
    return F.when((n >= 4) & F.contains(text, query), 1.0).when(n >= 6, share / F.least(F.lit(12), n)).otherwise(0.0)


def asked_terms(questions: DataFrame, profile: Profile = REGULATIONS) -> DataFrame:
    """(qid, term, is_term, is_phrase, is_article) of every question (qid, question)."""
    p = questions.select("qid", profile_of(F.col("question"), profile).alias("p")).where((F.size("p.terms") > 0) | (F.size("p.phrases") > 0))
    article = F.when(F.length("p.article") >= LOW, F.array("p.article")).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat("p.terms", "p.phrases", article))
    got = p.select("qid", "p", F.explode(every).alias("term"))
    return got.select("qid", "term", F.array_contains("p.terms", F.col("term")).alias("is_term"), F.array_contains("p.phrases", F.col("term")).alias("is_phrase"), (F.col("p.article") == F.col("term")).alias("is_article"))


def frequencies(index: Index, hits: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df, w, fields): in how many chunks each term occurs, its weight, and all fields that it occurs in."""
    own = hits.groupBy("term").agg(F.count("*").alias("df"), F.bit_or("mask").alias("fields"))
    got = terms.join(own, "term", "left").fillna(0, ["df", "fields"])
    return got.withColumn("w", idf(F.lit(float(index.size)), F.col("df")))


def term_idf(index: Index, questions: DataFrame, profile: Profile = REGULATIONS) -> DataFrame:
    """(term, df, idf) of all the questions' terms."""
    terms = asked_terms(questions, profile).where("is_term").select("term").distinct()
    return frequencies(index, _hits(index, terms), terms).select("term", "df", F.col("w").alias("idf"))


def _parts(c: Column) -> dict[str, Column]:
    """What a hit adds to the sums of a score, by its fields."""
    term, phrase = F.when(F.col("is_term"), F.col("w")).otherwise(0.0), F.when(F.col("is_phrase"), F.col("w")).otherwise(0.0)
    return {"s_full": term * _has(c, FULL), "s_body": phrase * _has(c, BODY), "s_any": term * _has(c, TITLE | LAW | ARTICLE), "s_title": term * _has(c, TITLE), "s_law": term * _has(c, LAW)}


def _total(part: dict[str, Column]) -> Column:
    share = lambda s, of: F.when(F.col(of) > 0, s / F.col(of)).otherwise(0.0)
    return 0.36 * share(part["s_full"], "all_terms") + 0.20 * share(part["s_body"], "all_phrases") + 0.18 * share(part["s_any"], "all_terms") + 0.12 * share(part["s_title"], "all_terms") + 0.08 * share(part["s_law"], "all_terms")


def _summed(asked: DataFrame, hits: DataFrame, pairs: DataFrame, totals: DataFrame, static: DataFrame) -> DataFrame:
    """(qid, ord, low, high) of the ``pairs`` (qid, ord): the least and the most that their score can be, from the lists alone."""
    rows = pairs.join(asked.select("qid", "term", "is_term", "is_phrase", "is_article", "w"), "qid").join(hits, ["term", "ord"])
    sums = rows.groupBy("qid", "ord").agg(*(F.sum(v).alias(k) for k, v in _parts(F.col("mask")).items()), F.max(F.when(F.col("is_article"), F.col("mask"))).alias("article_mask"), F.max(F.when(F.col("is_article"), F.col("term"))).alias("article"))
    got = sums.join(totals, "qid").join(static, "ord").withColumn("sure", _total({k: F.col(k) for k in ("s_full", "s_body", "s_any", "s_title", "s_law")}))
    same = F.coalesce(F.col("article") == F.col("article_compact"), F.lit(False))
    inside = F.when(F.coalesce(_has(F.col("article_mask"), BODY), F.lit(0.0)) > 0, 0.10).otherwise(0.0)
    low = F.col("sure") + F.col("own") + F.when(same, 0.25).otherwise(0.0)
    return got.select("qid", "ord", low.alias("low"), (low + F.when(same, 0.0).otherwise(inside) + TEXT_PART).alias("high"))


def _read(index: Index, pairs: DataFrame, questions: DataFrame, profile: Profile) -> DataFrame:
    """(qid, ord, score) of the pairs (qid, ord, low): what the lists give, and what only the texts do."""
    p = questions.select("qid", profile_of(F.col("question"), profile).alias("p")).select("qid", F.col("p.compact").alias("compact"), F.col("p.article").alias("asked"))
    got = pairs.join(index.features.select("ord", "body_compact", "body_folded", "article_compact"), "ord").join(p, "qid")
    inside = (F.col("asked") != "") & (F.col("article_compact") != F.col("asked")) & F.contains(F.col("body_folded"), F.col("asked"))
    score = F.col("low") + F.when(inside, 0.10).otherwise(0.0) + TEXT_PART * _fragment(F.col("compact"), F.col("body_compact"))
    return got.select("qid", "ord", F.round(score, 6).alias("score"))


def _kth(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(qid, floor): each question's kth value, where it has so many."""
    order = Window.partitionBy("qid").orderBy(F.desc(column))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select("qid", F.col(column).alias("floor"))


def top_chunks(index: Index, questions: DataFrame, k: int = REGULATIONS.top_k, profile: Profile = REGULATIONS, first: int = FIRST) -> DataFrame:
    """(qid, ord, score, rank): the same rows as ``retrieve.retrieve`` gives, from the index.

    Questions without terms have no result; a question whose terms no chunk has gets none either unless fewer than k chunks hold one (then all chunks count, as there).
    """
    asked = stage(asked_terms(questions, profile), "asked")
    terms = asked.select("term").distinct()
    hits = stage(_hits(index, terms), "hits")
    asked = stage(asked.join(frequencies(index, hits, terms), "term"), "asked")
    totals = asked.groupBy("qid").agg(F.sum(F.when(F.col("is_term"), F.col("w"))).alias("all_terms"), F.sum(F.when(F.col("is_phrase"), F.col("w"))).alias("all_phrases")).fillna(0.0)
    totals = stage(totals, "totals")
    static = index.features.select("ord", "own", "article_compact")
    bound = asked.join(totals, "qid").withColumn("most", _total(_parts(F.col("fields"))) + F.when(F.col("is_article"), 0.25).otherwise(0.0))
    rarest = Window.partitionBy("qid").orderBy("df", "term")
    bound = stage(bound.withColumn("entries", F.sum("df").over(rarest)).withColumn("rest", F.sum("most").over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing))).select("qid", "term", "entries", "rest", "df"), "bounds")

    def listed(lists: DataFrame) -> DataFrame:
        return lists.select("qid", "term").join(hits.select("term", "ord"), "term").select("qid", "ord").distinct()

    some = _summed(asked, hits, listed(bound.where((F.col("entries") <= first) | (F.col("entries") == F.col("df")))), totals, static)
    floor = stage(_kth(some, "low", k), "floor")
    best_own = index.features.agg(F.max("own")).first()[0] or 0.0
    needed = bound.join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("rest") + best_own + TEXT_PART + SLACK >= F.col("floor")))
    found = stage(_summed(asked, hits, listed(needed), totals, static), "candidates")

    # Questions whose lists name fewer than k chunks are filled up with the best of the others, which score what they get whatever the question.
    few = totals.select("qid").join(found.groupBy("qid").count(), "qid", "left").where(F.coalesce("count", F.lit(0)) < k).select("qid")
    best = index.features.select("ord", "own").orderBy(F.desc("own"), "ord").limit(2 * k).collect() if not few.isEmpty() else []
    if best:
        every = F.explode(F.array(*(F.struct(F.lit(r["ord"]).cast("bigint").alias("ord"), F.lit(float(r["own"])).alias("low")) for r in best)))
        missing = few.withColumn("x", every).select("qid", "x.ord", "x.low").join(found.select("qid", "ord"), ["qid", "ord"], "left_anti")  # k of these are in no list, as the lists name fewer than k
        found = found.unionByName(missing.select("qid", "ord", "low", F.col("low").alias("high")))

    # The best by their sums are read first; of the others, those whose bound reaches the kth of these.
    order = Window.partitionBy("qid").orderBy(F.desc("low"), "ord")
    placed = stage(found.withColumn("place", F.row_number().over(order)), "candidates")
    lead = stage(_read(index, placed.where(F.col("place") <= 4 * k), questions, profile), "read")
    floor = _kth(lead, "score", k)
    late = placed.where(F.col("place") > 4 * k).join(floor, "qid").where(F.col("high") + SLACK >= F.col("floor"))
    every = lead.union(_read(index, late, questions, profile))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "ord", "score", "rank")
