"""The fast path from questions to answers: recall over all chunks, a second stage with vectors over the few that are left, evidence, digest or a model's answer, links.

The corpus is scanned by the recall alone; what follows touches at most ``fast_recall`` rows a question, so its shuffles grow with the questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from veinwork.domain import REGULATIONS, Profile
from veinwork.functions.meta import official_url
from veinwork.functions.text import blank, clean_answer, excerpt, filled, has_any, squeeze, strip
from veinwork.operators import answer as A, retrieve as R, selection as E
from veinwork.operators.score import cosine01
from veinwork.scratch import stage


def embedding_text(title: Column, law: Column, article: Column, body: Column, profile: Profile = REGULATIONS) -> Column:
    """What a chunk's vector is made of in the full index: its names and its body, a line each, cut to ``embedded_chars``. Nulls are empty."""
    return F.substring(strip(F.concat_ws("\n", filled(title), filled(law), filled(article), filled(body))), 1, profile.embedded_chars)


def fast_embedding_text(title: Column, article: Column, content: Column, profile: Profile = REGULATIONS) -> Column:
    """What a candidate's vector is made of in the fast path: squeezed names and an excerpt of ``fast_embedded_chars``."""
    return squeeze(F.concat_ws(" ", filled(title), filled(article), excerpt(content, profile.fast_embedded_chars)))


def fast_kinds(question: Column, profile: Profile = REGULATIONS) -> Column:
    """struct<broad, compare, definition> by the fast path's own words."""
    q = squeeze(question)
    both = F.contains(q, F.lit("与")) & F.contains(q, F.lit("和"))
    definition = has_any(q, profile.fast_definition) | F.startswith(q, F.lit("定义"))
    return F.struct(has_any(q, profile.fast_broad).alias("broad"), (has_any(q, profile.fast_compare) | both).alias("compare"), definition.alias("definition"))


def candidates(chunks: DataFrame, questions: DataFrame, profile: Profile = REGULATIONS) -> DataFrame:
    """The first stage's rows (qid, first) with their chunks' columns and their question, written once: at most ``fast_recall`` rows a question, which all later steps read. Blank questions have none."""
    questions = questions.where(~blank(F.col("question")))
    first = R.fast_recall(chunks, questions, profile.fast_recall, profile).select("qid", "ord", F.col("score").alias("first"))
    return stage(chunks.join(first, "ord").join(questions.select("qid", "question"), "qid"), "candidates")


def second_stage(rows: DataFrame, question_vectors: DataFrame | None = None, vectors: DataFrame | None = None, profile: Profile = REGULATIONS) -> DataFrame:
    """(qid, ord, score, rank) of candidates, re-scored. With vectors of questions (qid, vector) and chunks (ord, vector) a pair that has both
    gets their cosine over the dimensions they share; other pairs keep their lexical score."""
    text = squeeze(F.concat_ws(" ", filled(F.col("title")), filled(F.col("article_no")), filled(F.col("content"))))
    got = rows.select("qid", "ord", "first", squeeze(F.col("question")).alias("asked"), text.alias("text"))
    if vectors is not None:
        pairs = rows.select("qid", "ord").join(question_vectors.select("qid", F.col("vector").alias("_q")), "qid").join(vectors.select("ord", F.col("vector").alias("_c")), "ord")
        pairs = pairs.where(F.col("_q").isNotNull() & F.col("_c").isNotNull())
        got = got.join(pairs.select("qid", "ord", cosine01(F.col("_q"), F.col("_c"), truncate=True).alias("semantic")), ["qid", "ord"], "left")
    return R.second_stage(got, profile.fast_rerank)


def embedded(rows: DataFrame, embed: Callable[[list[str]], list], profile: Profile = REGULATIONS) -> tuple[DataFrame, DataFrame]:
    """Vectors of the candidates' questions and chunks by a model, each text once: (qid, vector) and (ord, vector)."""
    asked = rows.groupBy("qid").agg(F.first("question").alias("question")).select("qid", squeeze(F.col("question")).alias("text")).where("text <> ''")
    said = rows.dropDuplicates(["ord"]).select("ord", fast_embedding_text(F.col("title"), F.col("article_no"), F.col("content"), profile).alias("text"))
    return A.embed_with(asked, embed).select("qid", "vector"), A.embed_with(said, embed).select("ord", "vector")


def evidence(rows: DataFrame, ranked: DataFrame, lead: float = 0.12, profile: Profile = REGULATIONS) -> DataFrame:
    """The rows that answer each question, as (candidates' columns, score, rank, place, evidence_title, snippet, url, definition): the first alone where it is
    clearly ahead of the second and the question is neither broad nor a comparison, else all of the second stage."""
    kind = fast_kinds(F.col("question"), profile)
    top = E.leads(ranked)
    got = rows.join(ranked.select("qid", "ord", "score", "rank"), ["qid", "ord"]).withColumn("_kind", kind).join(top.select("qid", "top", "second"), "qid")
    got = got.where((F.col("rank") == 1) | ~E.fast_single(F.col("top"), F.col("second"), F.col("_kind.broad"), F.col("_kind.compare"), lead))
    title = F.concat(filled(F.col("title")), *(F.when(blank(F.col(c)), "").otherwise(F.concat(F.lit(a), F.col(c), F.lit(z))) for c, a, z in (("article_no", " ", ""), ("doc_no", "（", "）"))))
    return got.select(
        *rows.columns, "score", "rank", F.col("rank").alias("place"), title.alias("evidence_title"), excerpt(F.col("content"), 900).alias("snippet"),
        official_url(F.col("source_url"), F.col("content")).alias("url"), F.col("_kind.definition").alias("definition"),
    )


def digests(rows: DataFrame, down: Column, keep: int = 3) -> DataFrame:
    """(qid, digest): the first rows of the evidence in place of an answer; ``down`` says that no model answered."""
    line = F.concat(F.col("place").cast("string"), F.lit(". "), "evidence_title", F.lit("\n   "), excerpt(F.col("snippet"), 220))
    got = rows.where(F.col("place") <= keep).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"), F.max(down).alias("down"))  # at most ``keep`` rows a question
    head = F.when(F.col("down"), f"{A.UNAVAILABLE}，以下为快速模式证据汇总：\n\n").otherwise("根据快速模式命中证据，给出摘要：\n\n")
    return got.select("qid", strip(F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"))).alias("digest"))


def answers(rows: DataFrame, chat: Callable[[list[str]], list[str]] | None = None, profile: Profile = REGULATIONS) -> DataFrame:
    """(qid, answer) out of evidence: the model's, cleaned, or the digest where there is no model, none answers or the answer is blank; then the links to the sources it mentions."""
    if chat is None:
        said = rows.select("qid").distinct().withColumn("answer", F.lit(A.UNAVAILABLE))
    else:
        asked = A.prompts(rows.select("qid", "question", "place", F.col("evidence_title").alias("title"), "snippet"))
        said = A.answer_with(asked.select("qid", "prompt"), chat).select("qid", "answer")
    down = A.unavailable(F.col("answer"))
    said = said.withColumns({"_down": down, "answer": clean_answer(F.col("answer"), profile)})
    short = digests(rows.join(said.select("qid", "_down"), "qid"), F.col("_down"))
    said = said.join(short, "qid").select("qid", F.when(blank(F.col("answer")) | A.unavailable(F.col("answer")), F.col("digest")).otherwise(F.col("answer")).alias("answer"))
    return with_links(said, rows)


def with_links(said: DataFrame, rows: DataFrame) -> DataFrame:
    """Answers (qid, answer) with up to four links below: the sources mentioned, in order of mention; the first that has an address if none is."""
    links = A.links(rows.select("qid", "rank", "title", "doc_no", "article_no", "url").join(said, "qid"), label=F.when(blank(F.col("title")), "原文链接").otherwise(F.col("title")))
    line = F.concat(F.lit("- ["), "label", F.lit("]("), "url", F.lit(")"))
    lists = links.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))  # at most four a question
    below = F.concat(strip(F.col("answer")), F.lit("\n\n原文链接（官网）：\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return said.join(lists, "qid", "left").select("qid", F.when(F.col("lines").isNull(), F.col("answer")).otherwise(strip(below)).alias("answer"))


def ask(
    chunks: DataFrame, questions: DataFrame, question_vectors: DataFrame | None = None, vectors: DataFrame | None = None, embed: Callable[[list[str]], list] | None = None,
    chat: Callable[[list[str]], list[str]] | None = None, profile: Profile = REGULATIONS,
) -> DataFrame:
    """(qid, answer) of questions (qid, question) over chunks (ord, title, doc_no, article_no, content, content_type, source_url). Vectors come from tables, or from ``embed`` for the recalled candidates alone."""
    rows = candidates(chunks, questions, profile)
    if embed is not None:
        question_vectors, vectors = embedded(rows, embed, profile)
    return answers(evidence(rows, second_stage(rows, question_vectors, vectors, profile), profile=profile), chat, profile)
