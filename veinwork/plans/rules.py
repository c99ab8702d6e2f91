"""Queries on re-scoring rules, evidence order, links and answer states: over the retrieved chunks of all questions, whole texts and all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinwork.domain import NUMERALS, REGULATIONS as P
from veinwork.functions import meta as M, text as T
from veinwork.operators import answer as A, retrieve as R, score as S, selection as E, terms as Q
from veinwork.plans.base import any_sql, collapse_sql, corpus, dense_sql, distinct_sql, fold_sql, grams_sql, list_sql, phrased, phrased_sql, pick, pick_sql, query, questions, QUESTIONS_SQL, squeeze_sql, strip_sql, table
from veinwork.plans.retrieval import CANDIDATES_SQL, lexical_topk, _PLAIN, _top
from veinwork.scratch import stage
from veinwork.plans.texts import GARBLED_SQL, intent_sql, keywords_sql, kinds_sql, pairs_sql, SUMMARY_SQL

# What the rules look for is in no synthetic text: it is added to questions, titles and chunks by their numbers.
_ASKED = ["政府采购法第二条规定什么", "政府采购有哪几种采购方式", "小微企业的扣除比例", "江苏的规定 条件", "公开招标与邀请招标的区别", "本国产品价格扣除 20", "关于印发政府采购管理办法的通知", "处罚是什么"]
_LAWS = ["中华人民共和国政府采购法", "某通知", "关于印发政府采购管理办法的通知", "江苏省某办法（附件: 表1）", "x"]
_SAID = ["", "采购方式包括公开招标和邀请招标。", "对小微企业价格扣除百分之二十，本国产品评审优惠。", "应当符合条件，违法的处罚。", "公开招标适用情形", "投诉处理，中小企业"]
_REGIONS = ["NATIONAL", "PROVINCIAL", "MUNICIPAL", "UNKNOWN"]
_PATHS = ["/c/a.md", "/c/b.md", "/c/list.txt"]


def _retrieved(spark, sf):
    """The plain top list with its questions and chunks, as the rules see them."""
    asked = questions(spark, sf).select("qid", F.concat("question", F.lit(" "), pick(_ASKED, F.col("qid"))).alias("question"))
    top = stage(lexical_topk(spark, sf).select("qid", "ord", F.col("score").alias("base")), "top")
    chunk = corpus(spark, sf, top).select(
        "ord", pick(_LAWS, F.col("doc_id")).alias("law_title"), "article_no", "doc_no", pick(_REGIONS, F.col("doc_id")).alias("region"), pick(_PATHS, F.col("ord")).alias("source_path"),
        F.concat(pick(_SAID, F.col("ord")), "content").alias("body"), T.summary_body(F.col("content")).alias("summary"), T.garbled(F.col("content")).alias("garbled"),
    )
    return stage(top.join(chunk, "ord").join(asked, "qid"), "retrieved")


def _rules(rows):
    rows = rows.withColumn("intent", Q.intent(F.col("question"))).withColumn("words", Q.keywords(F.col("question"), F.col("intent.keywords"))).withColumn("number", M.asked_doc_number(F.col("question")))
    none = F.lit("")
    row = {k: F.col(k) for k in ("region", "body", "doc_no", "summary", "garbled")} | {"path": F.col("source_path"), "law": F.col("law_title"), "article": F.col("article_no"), "snippet": none, "doc_type": none, "attachment_type": none, "scanned": F.lit(False)}
    return rows, S.tune_rules(F.col("question"), F.col("intent"), F.col("words"), F.col("number"), row)


_ASKED_REL = f"(select qid as id, question || ' ' || {pick_sql(_ASKED, 'qid')} as t from ({QUESTIONS_SQL})) f"
_CUES = " + ".join(f"(case when intent_type = '{name}' and {any_sql('m', cues)} then {plus} else 0.0 end)" for name, cues, plus in P.intent_cues)
_RULES_SQL = {
    "title_match": f"case when title_style and length(qd) >= 8 and length(ld) >= 8 and (contains(ld, qd) or len(list_filter({grams_sql('qd', 10)}, lambda g: contains(ld, g))) > 0) then 0.34 else 0.0 end",
    "coverage": "least(0.14, cov * 0.16) - (case when cov < 0.16 then 0.07 else 0.0 end)",
    "domestic": f"case when not contains(n, '本国产品') then 0.0 when contains(m, '本国产品') then 0.18 + (case when {any_sql('m', ('价格扣除', '评审优惠', '优惠'))} then 0.06 else 0.0 end) when contains(m, '中小企业') then -0.22 else -0.18 end",
    "ratio": f"case when ratio then (case when regexp_matches(m, '{P.ratio_cue}') then 0.22 else -0.14 end) - (case when {any_sql('m', ('争议处理', '监督检查', '投诉处理', '附件'))} then 0.08 else 0.0 end) else 0.0 end",
    "method": f"case when method then (case when {any_sql('m', ('采购方式', '采用以下方式', '方式包括'))} then 0.16 else 0.0 end) + (case when {any_sql('m', P.methods)} then 0.24 else 0.0 end) + (case when contains(lf, '政府采购法') then 0.28 else 0.0 end) - (case when {any_sql('m', ('ppp', '社会资本合作', '政府和社会资本合作项目'))} then 0.10 else 0.0 end) else 0.0 end",
    "intent": _CUES,
    "target_law": "case when target_law <> '' and contains(lf, replace(target_law, '中华人民共和国', '')) then 0.22 else 0.0 end",
    "target_article": "case when target_article = '' then 0.0 when article_no = target_article then 0.32 when contains(m, target_article) then 0.10 else -0.12 end",
    "doc_number": "case when number = '' then 0.0 when contains(named, number) then 0.42 else -0.16 end",
    "compare": f"case when not pair then 0.0 else (case when hl and hr then 0.13 when hl or hr then -0.08 else -0.14 end) - (case when {any_sql('n', ('适用边界', '适用范围', '适用情形'))} and not {any_sql('m', ('适用', '情形', '条件', '范围'))} then 0.08 else 0.0 end) end",
    "law_form": f"(case when {any_sql('lf', P.form_words)} then 0.05 else 0.0 end) - (case when {any_sql('lf', P.annex_words)} then 0.05 else 0.0 end)",
    "region": f"case when regional then (case when {any_sql('pl', P.local_words)} then 0.10 else -0.03 end) else (case when {any_sql('pl', P.national_words)} then 0.11 else 0.0 end) - (case when {any_sql('pl', P.local_words)} then 0.08 else 0.0 end) end",
    "flags": "0.0 - ((case when summary then 0.18 else 0.0 end) + (case when garbled then 0.12 else 0.0 end))",
    "length": "0.0 - ((case when size < 40 then 0.42 when size < 120 then 0.14 else 0.0 end) + (case when size > 1500 then least(0.18, (size - 1500) / 4200.0) else 0.0 end))",
    "manifest": "case when regexp_matches(source_path, '(list|list_new|list_sorted)\\.txt$') then -0.55 else 0.0 end",
}
_HOLDS = "(length({t}) >= 2 and (contains(m, {t}) or contains(replace(m, ' ', ''), {t})))"
#: Retrieved rows with all that the rules need: questions are worked out once each.
TUNED_SQL = f"""{CANDIDATES_SQL}, kq as materialized (select id as qid, f.t as question, {fold_sql('f.t')} as n, replace({fold_sql('f.t')}, ' ', '') as qd, i.* exclude (id), k.* exclude (id), p.id is not null as pair, replace({fold_sql('left_side')}, ' ', '') as left_side, replace({fold_sql('right_side')}, ' ', '') as right_side,
      translate(replace(regexp_extract({dense_sql('f.t')}, '{P.doc_no_asked}'), ' ', ''), '（）〔〕()[]', '') as number from {_ASKED_REL} join ({intent_sql(_ASKED_REL)}) i using (id) join ({kinds_sql(_ASKED_REL)}) k using (id) left join ({pairs_sql(_ASKED_REL)}) p using (id)),
    kw as materialized (select *, list_filter(list_transform({keywords_sql('n', 'words')}, lambda k: {fold_sql('k')}), lambda k: length(k) >= 2 and not list_contains({list_sql(P.question_stopwords)}, k)) as keys from kq),
    kc as materialized (select qid, ord, top.score as base, law_title, article_no, doc_no, region, source_path, body, summary, garbled, lf, replace(lf, ' ', '') as ld, {fold_sql("law_title || '  ' || body")} as m, {fold_sql("region || ' ' || law_title || ' '")} as pl, length({dense_sql('body')}) as size, translate({squeeze_sql("doc_no || '  ' || law_title")}, '（）〔〕()[]', '') as named
      from top join (select *, {fold_sql('law_title')} as lf from (select ord, {pick_sql(_LAWS, 'doc_id')} as law_title, article_no, doc_no, {pick_sql(_REGIONS, 'doc_id')} as region, {pick_sql(_PATHS, 'ord')} as source_path, {pick_sql(_SAID, 'ord')} || content as body, {SUMMARY_SQL.format(d=dense_sql('content'), x='content')} as summary, {GARBLED_SQL.format(d=dense_sql('content'))} as garbled from cc)) using (ord)),
    kr as materialized (select *, {", ".join(f"({sql})::double as r_{name}" for name, sql in _RULES_SQL.items())} from (select *, {_HOLDS.format(t='left_side')} as hl, {_HOLDS.format(t='right_side')} as hr, case when len(keys) = 0 or m = '' then 0.0 else len(list_filter(keys, lambda k: contains(m, k))) / len(keys) end as cov from kc join kw using (qid))),
    kt as materialized (select *, round(least(1.0, greatest(0.0, base + {" + ".join(f"r_{name}" for name in _RULES_SQL)})), 6) as score from kr)"""


@query("tune_rules", f"with {TUNED_SQL} select qid, ord, {', '.join(f'round(r_{name}, 6) as {name}' for name in _RULES_SQL)} from kr")
def tune_rules(spark, sf):
    """Every rule of the re-scoring, for every retrieved chunk."""
    rows, rules = _rules(_retrieved(spark, sf))
    return rows.select("qid", "ord", *(F.round(c, 6).alias(name) for name, c in rules.items()))


def _tuned(spark, sf):
    rows, rules = _rules(_retrieved(spark, sf))
    kind = Q.kinds(F.col("question"))
    merged = T.fold(F.concat_ws(" ", "law_title", "body"))
    return rows.withColumns({"score": F.round(S.tuned(F.col("base"), rules), 6), "ratio": kind["ratio"], "title_style": kind["title_style"], "ratio_row": S.ratio_cue(merged), "domestic_row": F.contains(merged, F.lit("本国产品"))})


_PLACES = "row_number() over (partition by qid order by {}score desc, base desc, ord) as rank"


@query("tune_scores", f"with {TUNED_SQL} select qid, ord, score, row_number() over (partition by qid order by score desc, base desc, ord) as place from kt")
def tune_scores(spark, sf):
    """The retrieved chunks in their order after the re-scoring."""
    return E.ranked(_tuned(spark, sf)).select("qid", "ord", "score", F.col("rank").cast("bigint").alias("place"))


_RANKED = f"ra as materialized (select *, {_PLACES.format('')}, regexp_matches(m, '{P.ratio_cue}') as ratio_row, contains(m, '本国产品') as domestic_row, title_style and r_title_match > 0 as hit from kt)"


@query("title_hits_first", f"with {TUNED_SQL}, {_RANKED} select qid, ord, row_number() over (partition by qid order by hit desc, score desc, base desc, ord)::int as rank from ra")
def title_hits_first(spark, sf):
    return E.title_hits_first(E.ranked(_tuned(spark, sf))).select("qid", "ord", "rank")


@query("ratio_first", f"""with {TUNED_SQL}, {_RANKED}, o as (select *, max(ratio and ratio_row) over (partition by qid) as found, row_number() over (partition by qid order by (ratio and ratio_row) desc, (ratio and ratio_row and domestic_row) desc, score desc, base desc, ord) as turn from ra)
    select qid, ord, (case when found then turn else rank end)::int as rank from o where not found or ratio and ratio_row or turn <= 3""")
def ratio_first(spark, sf):
    return E.ratio_first(E.ranked(_tuned(spark, sf))).select("qid", "ord", "rank")


# The whole way from a question to its evidence and digest.
_ASK = f"""{TUNED_SQL}, {_RANKED.replace('from kt', "from (select * from (select *, row_number() over (partition by qid, law_title, article_no, source_path order by score desc, base desc, ord) as k from kt) where k = 1)")},
    lim as (select qid, case when not definition then 6 when top >= 0.78 and (second is null or top - second >= 0.18) then 2 else 3 end as most from (select qid, any_value(definition or intent_type = 'DEFINITION') as definition, max(score) filter (rank = 1) as top, max(score) filter (rank = 2) as second from ra group by qid)),
    fl as (select * exclude (rank), {_PLACES.format('')} from (select *, max(ok) over (partition by qid) as some_ok from (select *, score >= greatest(0.03, 0.55 * max(score) over (partition by qid)) as ok from ra)) where ok or (not some_ok and rank <= 6)),
    rf as (select *, (case when found then turn else rank end) as r2 from (select *, max(ratio and ratio_row) over (partition by qid) as found, row_number() over (partition by qid order by (ratio and ratio_row) desc, (ratio and ratio_row and domestic_row) desc, score desc, base desc, ord) as turn from fl) where not found or ratio and ratio_row or turn <= 3),
    sd as (select *, hit and row_number() over (partition by qid order by hit desc, r2) = 1 as seed from rf),
    pl as (select *, row_number() over (partition by qid order by (c > 2)::int, seed desc, r2) as place from (select *, row_number() over (partition by qid, law_title order by seed desc, r2) as c from sd)),
    got as materialized (select * from pl join lim using (qid) where place <= most)"""
_SNIP = f"case when length({collapse_sql('body')}) > 200 then substr({collapse_sql('body')}, 1, 200) || ' ...' else {collapse_sql('body')} end"


def _evidence(spark, sf):
    """Retrieved, re-scored, one row for an article, above the floor, rows of a ratio or of the title asked for first, at most two of a law."""
    best = E.dedupe_best(_tuned(spark, sf))
    w = E.Window.partitionBy("qid")
    of = lambda place: F.max(F.when(F.col("rank") == place, F.col("score"))).over(w)
    definition = Q.kinds(F.col("question"))["definition"] | (F.col("intent.intent_type") == "DEFINITION")
    best = best.withColumn("most", E.evidence_limit(of(1), of(2), definition))
    return E.per_law(E.ratio_first(E.above_floor(best)), F.col("title_style") & S.strong_title(F.col("question"), F.col("law_title")), F.col("most"))


@query("compat_evidence", f"with {_ASK} select qid, ord, score, place::int as place, law_title, article_no from got")
def compat_evidence(spark, sf):
    return _evidence(spark, sf).select("qid", "ord", "score", "place", "law_title", "article_no")


@query("compat_ask", f"""with {_ASK} select qid, '当前大模型不可用，先基于检索证据给出参考结论。' || chr(10) || '结论：已命中多条相关依据，请按以下优先顺序核对。' || chr(10) || '依据列表：' || chr(10) || string_agg(place || '. ' || law_title || ' ' || article_no || chr(10) || '   摘要：' || case when length({_SNIP}) > 180 then substr({_SNIP}, 1, 180) || '...' else {_SNIP} end, chr(10) order by place) as answer from got where place <= 3 group by qid""")
def compat_ask(spark, sf):
    """The answer to every question as given without a model: a digest of its evidence."""
    rows = _evidence(spark, sf)
    return A.fallback_answers(rows.select("qid", "place", F.concat_ws(" ", "law_title", "article_no").alias("title"), T.excerpt(F.col("body"), 200).alias("snippet")))


# An answer names some of its sources: every second question's its second source, by title or number.
def _answered(spark, sf):
    rows = E.ranked(_tuned(spark, sf)).where("rank <= 6")
    named = F.when(F.col("qid") % 2 == 0, F.max(F.when(F.col("rank") == 2, F.when(F.col("qid") % 4 == 0, F.col("doc_no")).otherwise(F.col("law_title")))).over(E.Window.partitionBy("qid"))).otherwise("")
    return rows.select("qid", "rank", F.col("law_title").alias("title"), F.when(F.col("ord") % 3 == 0, F.col("doc_no")).otherwise("").alias("doc_no"), "article_no", F.concat(F.lit("http://"), "ord").alias("url"), F.concat(F.lit("依据："), named).alias("answer"))


_FIND = "case when {x} <> '' and instr(a, {x}) > 0 then instr(a, {x}) - 1 end"


@query("source_links", f"""with {TUNED_SQL}, {_RANKED}, an as (select qid, rank, law_title as title, case when ord % 3 = 0 then doc_no else '' end as doc_no, article_no, 'http://' || ord as url, '依据：' || case when qid % 2 = 0 then coalesce(max(case when rank = 2 then case when qid % 4 = 0 then doc_no else law_title end end) over (partition by qid), '') else '' end as answer from ra where rank <= 6),
    mentioned as (select *, coalesce({_FIND.format(x='dn')}, {_FIND.format(x='t')}, {_FIND.format(x='substr(t, 1, 12)')}, {_FIND.format(x='ar')}, -1) as p, coalesce(nullif(doc_no, ''), title) as label from (select *, {squeeze_sql('answer')} as a, {squeeze_sql('doc_no')} as dn, {squeeze_sql('title')} as t, {squeeze_sql('article_no')} as ar from an)),
    one as (select *, max(p >= 0) over (partition by qid) as found, row_number() over (partition by qid, label order by case when p < 0 then 2147483647 else p end, rank) as turn from mentioned)
    select qid, label, url, place::int as place from (select *, row_number() over (partition by qid order by case when p < 0 then 2147483647 else p end, rank) as place from one where turn = 1) where (found and p >= 0 and place <= 4) or (not found and place = 1)""")
def source_links(spark, sf):
    return A.links(_answered(spark, sf))


_STATES = ["未找到足够依据", "", "结论：可以", "当前大模型不可用，先给出", "Request TIMEOUT"]
_DOWN = "(contains(a, '模型不可用') or contains(a, 'network') or contains(a, 'timeout'))"


@query("answer_states", f"select id, {strip_sql('t')} = '' or contains(t, '未找到足够依据') as missed, {_DOWN} as unavailable, {strip_sql('t')} <> '' and not starts_with(t, '当前大模型不可用') and not {_DOWN} as cacheable from (select id, t, {squeeze_sql('t')} as a from {phrased_sql(_STATES)})")
def answer_states(spark, sf):
    t = F.col("t")
    return phrased(spark, sf, _STATES).select("id", A.missed(t).alias("missed"), A.unavailable(t).alias("unavailable"), A.cacheable(t).alias("cacheable"))


# A model's replies on intents: to every third question none that can be read.
_ABOUT = ["政府采购法是什么", "办理流程", "有什么处罚"]
_REPLIES = ['{"intent_type": "process", "keywords": ["流程"], "target_article": "见第三条"}', "no reply", 'x {"intent_type": "NEW", "target_law": " 某法 "} y']


@query("merged_intent", f"""select id, case when j is null then i.intent_type when upper(trim(j->>'$.intent_type')) in ('DEFINITION', 'PROCESS', 'CONDITION', 'PENALTY', 'OTHER') then upper(trim(j->>'$.intent_type')) else 'OTHER' end as intent_type, coalesce(nullif(trim(j->>'$.target_law'), ''), i.target_law) as target_law,
    coalesce(nullif(regexp_extract(coalesce(j->>'$.target_article', ''), '第[{NUMERALS}]+条'), ''), i.target_article) as target_article, array_to_string({distinct_sql('w')}[1:16], '|') as keywords
    from (select i, j, id, i.words || coalesce(from_json(j->'$.keywords', '["VARCHAR"]'), []) as w from (select item_id as id, try_cast(regexp_extract({pick_sql(_REPLIES, 'item_id // 3')}, '(?s)(\\{{.*\\}})', 1) as json) as j from benchmark) join ({intent_sql(phrased_sql(_ABOUT, 'benchmark'))}) i using (id)) m""")
def merged_intent(spark, sf):
    reply = pick(_REPLIES, F.floor(F.col("id") / 3))
    m = Q.merged_intent(Q.intent(F.col("t")), reply)
    return phrased(spark, sf, _ABOUT, "benchmark").select("id", m.alias("m")).select("id", "m.intent_type", "m.target_law", "m.target_article", F.array_join("m.keywords", "|").alias("keywords"))


@query("shrink_summary", "select page_id, case when length(t) > 700 then substr(t, 1, 700) || '...' else t end as text from (select page_id, regexp_replace(regexp_replace('发稿时间 x' || chr(10) || coalesce(html, ''), '(?m)^\\s*(发稿时间|访问量|当前位置|上一篇|下一篇|打印本页|关闭窗口).*$', '', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') as t from pages)")
def shrink_summary(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.shrink_summary(F.concat(F.lit("发稿时间 x\n"), F.coalesce("html", F.lit("")))).alias("text"))


# The second retrieval of questions about ways of procurement, by the anchor query as question -1.
_ANCHORED_SQL = f"select id as qid, f.t as question from {_ASKED_REL} union all select -1, '{P.method_anchor}'"


@query("method_topk", f"""with {CANDIDATES_SQL.split(', top as materialized')[0].replace(QUESTIONS_SQL, _ANCHORED_SQL)}, every as materialized ({_top(_PLAIN, 48)}), way as (select id as qid from ({kinds_sql(_ASKED_REL)}) where method)
    {_top("select qid, ord, max(score) as score from (select qid, ord, score from every where qid >= 0 and rank <= 24 union all select way.qid, ord, score from way cross join every where every.qid = -1) group by qid, ord", 72)}""")
def method_topk(spark, sf):
    asked = questions(spark, sf).select("qid", F.concat("question", F.lit(" "), pick(_ASKED, F.col("qid"))).alias("question"))
    return R.with_method_anchor(R.features(corpus(spark, sf)), asked)
