"""Queries on the fast path: second stage with vectors, evidence, answers with links, inputs of embeddings, and the second retrieval of the full path."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinwork.domain import REGULATIONS as P
from veinwork.operators import fast as Q
from veinwork.plans.base import CORPUS_SQL, QUESTIONS_SQL, any_sql, collapse_sql, corpus, pick, pick_sql, query, questions, squeeze_sql, strip_sql, table
from veinwork.plans.retrieval import _STAGE1, _STAGE2, _top

# Half of the questions are broad or compare something; the others may be answered by one row.
_ASKED = ["", "有哪些要点", "甲与乙和丙的边界", "什么是定义"]
_ASKED_SQL = f"select qid, question || ' ' || {pick_sql(_ASKED, 'qid')} as question from ({QUESTIONS_SQL})"


def _questions(spark, sf):
    return questions(spark, sf).select("qid", F.concat("question", F.lit(" "), pick(_ASKED, F.col("qid"))).alias("question"))


def _chunks(spark, sf):
    """The corpus with addresses; every fifth document has none."""
    url = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("见 https://law.test/"), F.col("doc_id"), F.lit(")")))
    return corpus(spark, sf).withColumns({"content_type": F.lit("structured_text"), "source_url": url})


def _vectors(spark, sf):
    """Vectors of the questions, but for one in ten, and of the chunks by their documents: one in seven has none, one in three is shorter."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 10 <> 9").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    own = v.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 48)).otherwise(F.col("embedding")).alias("vector"))
    return asked, own


def _second(spark, sf):
    rows = Q.candidates(_chunks(spark, sf), _questions(spark, sf))
    asked, own = _vectors(spark, sf)
    vectors = rows.select("ord", "doc_id").distinct().join(own, "doc_id").select("ord", "vector")
    return rows, Q.second_stage(rows, asked, vectors)


_COS = "(list_cosine_similarity(qv.embedding[1:d]::double[], cv.embedding[1:d]::double[]) + 1) * 0.5"
_SETUP = f"""cc as materialized ({CORPUS_SQL}), {_STAGE1.replace(QUESTIONS_SQL, _ASKED_SQL).replace(f"({CORPUS_SQL})", "cc")}, {_STAGE2},
    lx as materialized (select qid, ord, doc_id, score * 0.62 + common / (nq + nd - common) * 0.28 + (case when length(qt) >= 4 and contains(dt, qt) then 1.0 when length(qt) <= 3 then 0.0 else longest / least(12, length(qt)) end) * 0.10 as lexical from s3 join cc using (ord)),
    r2 as materialized ({_top(f"select qid, ord, round(case when qv.vec_id is not null and cv.vec_id is not null then lexical * 0.58 + {_COS} * 0.42 else lexical end, 6) as score from (select *, case when doc_id % 3 = 0 then 48 else 1000000 end as d from lx) left join (select * from embeddings where vec_id % 10 <> 9) qv on qv.vec_id = qid left join (select * from embeddings where vec_id % 7 <> 0) cv on cv.vec_id = doc_id", P.fast_rerank)})"""


@query("fast_second_stage", f"with {_SETUP} select qid, ord, score, rank from r2")
def fast_second_stage(spark, sf):
    """The best rows of every question after the second stage with vectors."""
    return _second(spark, sf)[1].select("qid", "ord", "score", "rank")


_N = "lower(regexp_replace(question, '\\s+', '', 'g'))"
_CUT = "case when length({t}) > {n} then substr({t}, 1, {n}) || ' ...' else {t} end"
_EVIDENCE = f"""{_SETUP}, ld as (select qid, max(score) filter (rank = 1) as top, max(score) filter (rank = 2) as second from r2 group by qid),
    fk as (select qid, {any_sql(_N, P.fast_broad)} or {any_sql(_N, P.fast_compare)} or (contains({_N}, '与') and contains({_N}, '和')) as many from fq),
    ev as materialized (select qid, ord, score, rank as place, title, article_no, doc_no, title || ' ' || article_no || '（' || doc_no || '）' as evidence_title, {_CUT.format(t=collapse_sql('content'), n=900)} as snippet, case when doc_id % 5 = 0 then regexp_extract(content, '(?i)https?://[^\\s)]+') else 'https://law.test/' || doc_id end as url
      from r2 join cc using (ord) join ld using (qid) join fk using (qid) where rank = 1 or not (second is null or (not many and top >= 0.58 and top - second >= 0.12)))"""


@query("fast_evidence", f"with {_EVIDENCE} select qid, ord, score, place, evidence_title, md5(snippet) as snippet, url from ev")
def fast_evidence(spark, sf):
    """The evidence of every question, whole or by the first row alone."""
    return Q.evidence(*_second(spark, sf)).select("qid", "ord", "score", "place", "evidence_title", F.md5("snippet").alias("snippet"), "url")


_FIND = "case when {x} <> '' and instr(a, {x}) > 0 then instr(a, {x}) - 1 end"
_TURN = "order by case when p < 0 then 2147483647 else p end, place"


@query("fast_ask", f"""with {_EVIDENCE}, dg as materialized (select qid, {strip_sql(f"'当前大模型不可用，以下为快速模式证据汇总：' || chr(10) || chr(10) || string_agg(place || '. ' || evidence_title || chr(10) || '   ' || {_CUT.format(t=collapse_sql('snippet'), n=220)}, chr(10) || chr(10) order by place)")} as answer from ev where place <= 3 group by qid),
    mn as (select *, coalesce({_FIND.format(x='dn')}, {_FIND.format(x='t')}, {_FIND.format(x='substr(t, 1, 12)')}, {_FIND.format(x='ar')}, -1) as p from (select qid, place, url, case when {strip_sql('title')} = '' then '原文链接' else title end as label, {squeeze_sql('answer')} as a, {squeeze_sql('doc_no')} as dn, {squeeze_sql('title')} as t, {squeeze_sql('article_no')} as ar from ev join dg using (qid) where url <> '')),
    lk as (select qid, string_agg('- [' || label || '](' || url || ')', chr(10) order by nth) as links from (select *, row_number() over (partition by qid {_TURN}) as nth from (select *, max(p >= 0) over (partition by qid) as found, row_number() over (partition by qid, label {_TURN}) as turn from mn) where turn = 1) where (found and p >= 0 and nth <= 4) or (not found and nth = 1) group by qid)
    select qid, case when links is null then answer else {strip_sql("answer || chr(10) || chr(10) || '原文链接（官网）：' || chr(10) || links")} end as answer from dg left join lk using (qid)""")
def fast_ask(spark, sf):
    """The fast path's answer to every question without a model: digest and links."""
    return Q.answers(Q.evidence(*_second(spark, sf)))


_LINE = "coalesce(split_part(text, chr(10), 1), '')"


@query("embedding_inputs", f"""select doc_id, md5(substr({strip_sql(f"{_LINE} || chr(10) || coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(text, '')")}, 1, {P.embedded_chars})) as full_input,
    md5({squeeze_sql(f"{_LINE} || coalesce(lang, '') || " + _CUT.format(t=collapse_sql('text'), n=P.fast_embedded_chars))}) as fast_input from documents""")
def embedding_inputs(spark, sf):
    """What vectors of all documents are made of, in both paths."""
    line, c = F.substring_index("text", "\n", 1), F.col
    return table(spark, sf, "documents").select("doc_id", F.md5(Q.embedding_text(line, c("source"), c("lang"), c("text"))).alias("full_input"), F.md5(Q.fast_embedding_text(line, c("lang"), c("text"))).alias("fast_input"))
