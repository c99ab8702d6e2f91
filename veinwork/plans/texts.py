"""Queries on texts: normalisation, metadata, chunking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veinwork.domain import REGULATIONS as P
from veinwork.functions import meta as M, text as T
from veinwork.operators import chunk as C, terms as Q
from veinwork.operators.retrieve import spread
from veinwork.operators.workspace import split_codes
from veinwork.plans.base import ORACLES, any_sql, collapse_sql, corpus, CORPUS_SQL, dense_sql, distinct_sql, fold_sql, grams_sql, list_sql, phrased, phrased_sql, pick, pick_sql, query, questions, QUESTIONS_SQL, squeeze_sql, strip_sql, table, windows_sql, WINDOWS_SQL
from veinwork.scratch import shared_dir
from veinwork.sources import stores

_NUM = "[一二三四五六七八九十百千万0-9]+"


@query("normalize_text", f"select doc_id, md5({fold_sql('text')}) as folded, length({fold_sql('text')}) as n from documents")
def normalize_text(spark, sf):
    f = T.fold(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(f).alias("folded"), F.length(f).cast("bigint").alias("n"))


@query("normalize_fast", f"select doc_id, md5({squeeze_sql('text')}) as squeezed from documents")
def normalize_fast(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("squeezed"))


@query("compact_text", f"""select doc_id, length({dense_sql('text')}) as dense, case when length({collapse_sql('text')}) > 120 then substr({collapse_sql('text')}, 1, 120) || ' ...' else {collapse_sql('text')} end as excerpt,
    case when length(coalesce(text, '')) > 80 then substr(text, 1, 80) || '...' else coalesce(text, '') end as shortened from documents""")
def compact_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(T.dense(t)).cast("bigint").alias("dense"), T.excerpt(t, 120).alias("excerpt"), T.shorten(t, 80).alias("shortened"))


@query("char_bigrams", f"select qid, array_to_string({distinct_sql('g')}, '|') as bigrams from (select qid, case when length(d) < 2 then [d] else {grams_sql('d', 2)} end as g from (select qid, {dense_sql('question')} as d from ({QUESTIONS_SQL})))")
def char_bigrams(spark, sf):
    return questions(spark, sf).select("qid", F.array_join(Q.char_bigrams(F.col("question")), "|").alias("bigrams"))


_STOP = list_sql(P.stopwords)
_DIGITS = "length(regexp_replace(g, '[^\\p{Nd}]', '', 'g')) >= greatest(2, length(g) - 1)"


def _grams(x: str, low: int, high: int) -> str:
    every = " || ".join(grams_sql(x, n) for n in range(high, low - 1, -1))
    return f"list_filter({every}, lambda g: not list_contains({_STOP}, g) and not ({_DIGITS}))"


_WORDS = f"list_filter(string_split(f, chr(32)), lambda w: length(w) >= 2 and not list_contains({_STOP}, w))"
TERMS_SQL = f"""select qid, question, f, c, terms[1:72] as terms, case when len(long) > 0 then long else more[1:24] end as phrases from (
    select *, list_filter(terms, lambda t: length(t) >= 4)[1:24] as long, {distinct_sql('m')} as more from (
    select *, {distinct_sql('wg')} as terms from (select *, w || g[1:72] as wg from (select *, {distinct_sql('w0')}[1:72] as w, {distinct_sql('g0')} as g from (
    select *, {_WORDS} as w0, {_grams('c', 2, 4)} as g0, {_grams('c', 4, 6)} as m from (
    select *, replace(f, ' ', '') as c from (select qid, question, {fold_sql('question')} as f from ({QUESTIONS_SQL}))))))))"""


@query("ngram_terms", f"select qid, array_to_string({distinct_sql('g')}[1:72], '|') as grams from (select qid, {_grams('c', 2, 4)} as g from (select qid, replace({fold_sql('question')}, ' ', '') as c from ({QUESTIONS_SQL})))")
def ngram_terms(spark, sf):
    return questions(spark, sf).select("qid", F.array_join(Q.gram_terms(T.dense(T.fold(F.col("question"))), 2, 4, P.max_terms), "|").alias("grams"))


@query("word_terms", f"select qid, array_to_string({distinct_sql('w')}[1:72], '|') as words from (select qid, {_WORDS} as w from (select qid, {fold_sql('question')} as f from ({QUESTIONS_SQL})))")
def word_terms(spark, sf):
    return questions(spark, sf).select("qid", F.array_join(Q.word_terms(T.fold(F.col("question"))), "|").alias("words"))


@query("query_profile", f"select qid, array_to_string(terms, '|') as terms, array_to_string(phrases, '|') as phrases, c as compact, regexp_extract(f, '第{_NUM}条') as article from ({TERMS_SQL})")
def query_profile(spark, sf):
    p = questions(spark, sf).select("qid", Q.profile_of(F.col("question")).alias("p"))
    return p.select("qid", F.array_join("p.terms", "|").alias("terms"), F.array_join("p.phrases", "|").alias("phrases"), "p.compact", "p.article")


FAST_SQL = f"""select qid, question, s, {distinct_sql('g')}[1:96] as terms from (select *, list_filter(regexp_split_to_array(s, '[^\\p{{Han}}A-Za-z0-9]+'), lambda w: length(w) >= 2) || {" || ".join(grams_sql('s', n) for n in (2, 3, 4))} as g
    from (select qid, question, {squeeze_sql('question')} as s from ({QUESTIONS_SQL})))"""


@query("fast_terms", f"select qid, array_to_string(terms, '|') as terms from ({FAST_SQL})")
def fast_terms(spark, sf):
    return questions(spark, sf).select("qid", F.array_join(Q.fast_terms(F.col("question")), "|").alias("terms"))


GARBLED_SQL = "(length({d}) >= 120 and length(regexp_replace({d}, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]', '', 'g')) / length({d}) < 0.12 and length(regexp_replace({d}, '[^A-Za-z]', '', 'g')) / length({d}) > 0.45)"
WEAK_SQL = f"(length({{t}}) < 4 or ((regexp_matches({{t}}, '^[（(]?[0-9一二三四五六七八九十]+[)）.、]\\s*.+$') or starts_with({{t}}, '1.')) and not {{cue}}))"
SUMMARY_SQL = f"({{d}} = '' or (length({{d}}) <= 2600 and regexp_matches({{x}}, '{P.summary_hint}')::int + (contains({{d}}, '附件') and contains({{d}}, '.pdf'))::int + (not regexp_matches({{x}}, '第{_NUM}条'))::int >= 2))"


@query("quality_flags", f"""select ord, length(d) as n, {GARBLED_SQL.format(d='d')} as garbled, {SUMMARY_SQL.format(d='d', x='content')} as summary_like,
    {WEAK_SQL.format(t='t', cue=any_sql('t', P.legal_cues))} as weak_title from (select *, {dense_sql('content')} as d, {collapse_sql('title')} as t from ({CORPUS_SQL}))""")
def quality_flags(spark, sf):
    c, t = F.col("content"), F.col("title")
    return corpus(spark, sf).select("ord", F.length(T.dense(c)).cast("bigint").alias("n"), T.garbled(c).alias("garbled"), T.summary_body(c).alias("summary_like"), T.weak_title(t).alias("weak_title"))


_KEYS = ["thtion", "anen", "qui la", "zu"]


def _snippet_sql(t: str, most: int) -> str:
    return f"""case when {t} = '' then '[正文缺失]' when hit is null then case when length({t}) > {most} then substr({t}, 1, {most}) || '...' else {t} end
      else (case when greatest(1, hit - 140) > 1 then '...' else '' end) || substr({t}, greatest(1, hit - 140), {most}) || (case when greatest(1, hit - 140) - 1 + {most} < length({t}) then '...' else '' end) end"""


@query("snippet_window", f"""select doc_id, {_snippet_sql('t', 760)} as snippet from (select doc_id, t, list_min(list_filter([{", ".join(f"instr(f, '{k}')" for k in _KEYS)}], lambda p: p > 0)) as hit
    from (select doc_id, t, {fold_sql('t')} as f from (select doc_id, {collapse_sql('text')} as t from documents)))""")
def snippet_window(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.window(F.col("text"), F.array(*map(F.lit, _KEYS))).alias("snippet"))


_META = [
    "[文号] 财库〔2022〕3号\n[发文机关] 财政部\n[疑似扫描] true\n正文第一行\n[未知] x\n[文号] 财库〔2023〕9号",
    "无头部\n- Law_Level:  地方 \n- url: https://a.example/x",
    "",
    "[疑似乱码] TRUE\n[疑似摘要页] false\nabc",
]


@query("meta_lines", f"""select id, {strip_sql("regexp_replace(t, '(?m)^\\[(" + "|".join(P.meta_keys) + ")\\].*$', '', 'g')")} as body, {strip_sql("regexp_replace(t, '(?m)^\\[[^\\]]+\\].*$', '', 'g')")} as bare,
    {strip_sql("regexp_extract(t, '(?m)^\\[文号\\]\\s*(.+)$', 1)")} as first_number, coalesce(trim(list_last(regexp_extract_all(t, '(?m)^\\[文号\\]\\s*(.*)$', 1))), '') as last_number,
    coalesce(lower(trim(list_last(regexp_extract_all(t, '(?m)^\\[疑似扫描\\]\\s*(.*)$', 1)))) = 'true', false) as scanned, coalesce(lower(trim(list_last(regexp_extract_all(t, '(?m)^\\[疑似乱码\\]\\s*(.*)$', 1)))) = 'true', false) as garbled,
    {strip_sql("regexp_extract(t, '(?im)^-\\s*law_level:\\s*(.*)$', 1)")} as law_level from {phrased_sql(_META)}""")
def meta_lines(spark, sf):
    t = F.col("t")
    return phrased(spark, sf, _META).select("id", T.drop_meta(t).alias("body"), T.drop_marked(t).alias("bare"), T.meta_value(t, "文号").alias("first_number"), F.coalesce(T.meta_map(t)["文号"], F.lit("")).alias("last_number"), M.flags(t)["scanned"].alias("scanned"), M.flags(t)["garbled"].alias("garbled"), T.dash_value(t, "law_level").alias("law_level"))


_RULES = [
    "关于印发 财库 [2022] 3 号 的通知 第二十六条 第一款 自2024年3月5日起施行 财政部办公厅", "财政部令第74号 （一）采购 2024-3-5 和 2024/12/15", "中华人民共和国政府采购法", "政府采购法实施条例（附件: 表1）",
    "江苏省政策法规 某某管理办法 苏财购〔2021〕17号 扬州市财政局", "plain text, no numbers", "某县住房城乡建设部通知 2024年12月31日", "国办发〔2025〕34号 国家法规", "", "2024-03-05 发布",
]


def _numbered_sql(x: str, p: str) -> str:
    g = lambda i: f"regexp_extract({x}, '{p}', {i})"
    return f"case when {g(0)} <> '' then {g(1)} || '〔' || {g(2)} || '〕' || {g(3)} || '号' end"


_UNBRACKET = "translate({x}, '（）()【】[]', '')"
_ORDER = f"case when regexp_extract(u, '{P.doc_no_order}') <> '' then regexp_extract(u, '{P.doc_no_order}', 1) || '第' || regexp_extract(u, '{P.doc_no_order}', 2) || '号' end"
_ISSUER = "coalesce(" + ", ".join(f"case when contains(u, '{i}') then '{i}' end" for i in P.issuers) + ", regexp_extract(u, '" + P.issuer_fuzzy.replace("IsHan", "Han") + "', 1))"


@query("document_numbers", f"""select id, coalesce({_numbered_sql('u', P.doc_no)}, {_ORDER}, '') as doc_no, coalesce(translate(coalesce({_numbered_sql('t', P.doc_no_asked)}, {_numbered_sql('d', P.doc_no_asked)}), '（）〔〕()[]', ''), '') as asked,
    regexp_replace(regexp_extract(t, '{P.doc_no_fast}'), '\\s+', '', 'g') as fast from (select id, t, {dense_sql('t')} as d, {_UNBRACKET.format(x=dense_sql('t'))} as u from {phrased_sql(_RULES)})""")
def document_numbers(spark, sf):
    t = F.col("t")
    return phrased(spark, sf, _RULES).select("id", M.doc_number(t).alias("doc_no"), M.asked_doc_number(t).alias("asked"), M.fast_doc_number(t).alias("fast"))


@query("legal_fields", f"""select id, regexp_extract(t, '第{_NUM}条') as article, coalesce(nullif(regexp_extract(t, '第{_NUM}款'), ''), regexp_extract(t, '（{_NUM}）')) as clause,
    case when trim(t) = '' then '未知法规' else {strip_sql(f"regexp_replace(t, '{P.attachment_suffix}', '')")} end as law,
    case when contains(t, '中华人民共和国') and ends_with(t, '法') then 'LAW' when contains(t, '条例') then 'ADMIN_REGULATION' when {any_sql('t', ('办法', '规定', '规则', '细则'))} then 'MINISTERIAL_RULE'
      when {any_sql('t', ('通知', '意见', '决定', '指引'))} then 'NORMATIVE_DOC' else 'OTHER' end as category,
    case when contains(t, '国家法规') then 'NATIONAL' when contains(t, '江苏省政策法规') then 'PROVINCIAL' when contains(t, '扬州文件制度') then 'MUNICIPAL' else 'UNKNOWN' end as region,
    {_ISSUER} as issuer from (select id, t, {_UNBRACKET.format(x=dense_sql('t'))} as u from {phrased_sql(_RULES)})""")
def legal_fields(spark, sf):
    t = F.col("t")
    return phrased(spark, sf, _RULES).select("id", M.article_no(t).alias("article"), M.clause_no(t).alias("clause"), M.law_title(t).alias("law"), M.category(t).alias("category"), M.region(t).alias("region"), M.issuer(t).alias("issuer"))


def _date_sql(x: str) -> str:
    t = f"translate({dense_sql(x)}, '／－—.', '/---')"
    one = lambda p: f"case when regexp_extract({t}, '{p}') <> '' then regexp_extract({t}, '{p}', 1) || '-' || lpad(regexp_extract({t}, '{p}', 2), 2, '0') || '-' || lpad(regexp_extract({t}, '{p}', 3), 2, '0') end"
    return f"coalesce({one(P.date_cn)}, {one(P.date_iso)}, {strip_sql(x)})"


@query("publish_dates", f"""select id, case when len(a) > 0 then {_date_sql('a[len(a)]')} else '' end as published, case when e <> '' then {_date_sql('e')} else '' end as effective, len(a) as n
    from (select id, regexp_extract_all(t, '{P.date_cn}', 0) || regexp_extract_all(t, '{P.date_iso}', 0) as a, regexp_extract(t, '{P.date_effective}', 1) as e from {phrased_sql(_RULES)})""")
def publish_dates(spark, sf):
    t = F.col("t")
    return phrased(spark, sf, _RULES).select("id", M.publish_date(t).alias("published"), M.effective_date(t).alias("effective"), F.size(M.all_dates(t)).cast("bigint").alias("n"))


@query("date_extract", f"""select event_id, {_date_sql('t')} as day from (select event_id, case event_id % 3 when 0 then year(ts) || '年' || month(ts) || '月' || day(ts) || '日'
    when 1 then year(ts) || '-' || month(ts) || '-' || day(ts) else '于 ' || strftime(ts, '%Y/%m/%d') end as t from events)""")
def date_extract(spark, sf):
    y, m, d = F.year("ts").cast("string"), F.month("ts").cast("string"), F.day("ts").cast("string")
    k = F.col("event_id") % 3
    t = F.when(k == 0, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日"))).when(k == 1, F.concat_ws("-", y, m, d)).otherwise(F.concat(F.lit("于 "), F.date_format("ts", "yyyy/MM/dd")))
    return table(spark, sf, "events").select("event_id", M.date(t).alias("day"))


@query("deterministic_id", """select page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (position(substr(h, 17, 1) in '0123456789abcdef') - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id
    from (select page_id, md5(coalesce(url, '')) as h from pages)""")
def deterministic_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", M.path_id(F.col("url")).alias("id"))


def _html_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace(coalesce({x}, ''), '(?is)<!--.*?-->|<(?:script|style)\\b[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{char}')"
    return collapse_sql(t)


@query("html_text", f"select page_id, md5({_html_sql('html')}) as text, length({_html_sql('html')}) as n from pages")
def html_text(spark, sf):
    t = T.html_to_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(t).alias("text"), F.length(t).cast("bigint").alias("n"))


@query("official_url", "select page_id, regexp_extract('来源 ' || coalesce(url, '') || ') 等', '(?i)https?://[^\\s)]+') as url from pages")
def official_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", M.official_url(F.lit(None).cast("string"), F.concat(F.lit("来源 "), F.coalesce("url", F.lit("")), F.lit(") 等"))).alias("url"))


_TITLES = ["采购法 第二条 第一款（财库〔2022〕3号）", "采购法 第二条 （一）", "政府采购法", "", "实施条例第十条"]
_PARTS = "^(.*?)(第[一二三四五六七八九十百千万0-9]+条)?(\\s*第[一二三四五六七八九十百千万0-9]+款)?(?:（(.+?)）)?$"


@query("title_parts", f"""select id, case when t = '' then '未知法规' when trim(regexp_extract(t, '{_PARTS}', 1)) = '' then t else trim(regexp_extract(t, '{_PARTS}', 1)) end as law, trim(regexp_extract(t, '{_PARTS}', 2)) as article,
    trim(regexp_extract(t, '{_PARTS}', 3)) as clause, trim(regexp_extract(t, '{_PARTS}', 4)) as doc_no from (select doc_id as id, {collapse_sql(f"split_part(coalesce(text, ''), chr(10), 1) || ' ' || {pick_sql(_TITLES, 'doc_id')}")} as t from documents)""")
def title_parts(spark, sf):
    """Titles are the documents' first lines, with what a displayed title says of its place."""
    said = F.concat(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.lit(" "), pick(_TITLES, F.col("doc_id")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), M.title_parts(said).alias("p")).select("id", "p.*")


_COMPARE = ["请解释公开招标与邀请招标的区别", "询价和竞争性谈判的适用边界是什么", "没有比较", "A与B关系"]


_SIDE = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(d, '" + P.compare + "', {}), '^(请解释|解释|说明|请按法规依据说明|请按依据说明|请按法规说明)', ''), '^(在[一-龥]{{1,8}}，)', ''), '(的|之)$', '')"


def pairs_sql(source: str) -> str:
    sides = [strip_sql(_SIDE.replace("{2,20}", "{{2,20}}").format(i)) for i in (1, 3)]
    return f"select id, l as left_side, r as right_side from (select id, {sides[0]} as l, {sides[1]} as r from (select id, {dense_sql('t')} as d from {source})) where length(l) >= 2 and length(r) >= 2"


@query("compare_pairs", pairs_sql(phrased_sql(_COMPARE, "benchmark")))
def compare_pairs(spark, sf):
    return phrased(spark, sf, _COMPARE, "benchmark").select("id", Q.compare_pair(F.col("t")).alias("p")).where("p is not null").select("id", F.col("p.left").alias("left_side"), F.col("p.right").alias("right_side"))


_ASKED = ["啥是政府采购法？办理流程，有哪些条件", "政府采购有哪几种采购方式", "第二十六条的处罚是什么意思", "关于印发 实施条例 的通知 20 价格", "本国产品价格减免 江苏"]
_INTENT = "case " + " ".join(f"when {any_sql('q', w)} then '{k}'" for k, w in P.intents) + " else 'OTHER' end"


def intent_sql(source: str) -> str:
    """(id, intent_type, target_law, target_article, words)."""
    return f"""select id, {_INTENT} as intent_type, case when contains(q, '政府采购法') then '中华人民共和国政府采购法' when contains(q, '实施条例') then '中华人民共和国政府采购法实施条例' else '' end as target_law,
    regexp_extract(q, '第{_NUM}条') as target_article, {distinct_sql("list_filter(regexp_split_to_array(q, '[\\s，。！？、,.!?;；:：]+'), lambda w: length(w) >= 2)")}[1:12] as words
    from (select id, lower(replace(replace(replace({strip_sql('t')}, '啥是', '什么是'), '啥叫', '什么是'), '啥意思', '什么意思')) as q from {source})"""


@query("query_intent", f"select id, intent_type, target_law, target_article, array_to_string(words, '|') as keywords from ({intent_sql(phrased_sql(_ASKED, 'benchmark'))})")
def query_intent(spark, sf):
    got = phrased(spark, sf, _ASKED, "benchmark").select("id", Q.intent(F.col("t")).alias("i"))
    return got.select("id", "i.intent_type", "i.target_law", "i.target_article", F.array_join("i.keywords", "|").alias("keywords"))


_METHOD = f"(contains(n, '采购') and {any_sql('n', ('几种', '多少种', '方式'))})"


def kinds_sql(source: str) -> str:
    return f"""select id, {any_sql('n', P.broad)} as broad, contains(n, '与') and {any_sql('n', ('适用边界', '区别', '差异', '关系', '比较'))} as compare, {any_sql('n', P.ratio_words)} or (contains(n, '20') and contains(n, '价格')) as ratio,
    {any_sql('n', ('什么是', '是什么', '是指', '定义', '概念', '含义'))} as definition, {_METHOD} as method,
    {any_sql('n', ('关于', '印发', '转发'))} and {any_sql('n', P.title_words)} as title_style, {any_sql('n', P.region_words)} as regional from (select id, {fold_sql('t')} as n from {source})"""


@query("question_kinds", kinds_sql(phrased_sql(_ASKED, "benchmark")))
def question_kinds(spark, sf):
    return phrased(spark, sf, _ASKED, "benchmark").select("id", Q.kinds(F.col("t")).alias("k")).select("id", "k.*")


def keywords_sql(n: str, own: str) -> str:
    """The keywords of a folded question; ``own`` is a list."""
    extra = lambda test, words: f"(case when {test} then {list_sql(words)} else [] end)"
    every = " || ".join([
        f"list_filter(list_transform({own}, lambda k: {fold_sql('k')}), lambda k: length(k) >= 2)", f"list_filter(string_split({n}, ' '), lambda w: length(w) >= 2 and not list_contains({list_sql(P.question_stopwords)}, w))",
        extra(f"contains({n}, '减免')", ("扣除", "优惠", "价格扣除", "评审优惠")), extra(f"contains({n}, '本国产品')", ("本国产品标准", "声明函", "组件成本")), extra(any_sql(n, ("20", "二十")), ("20%", "20％", "百分之二十")),
        extra(_METHOD.replace("(n,", f"({n},"), ("采购方式", *P.methods, "政府采购法", "第二十六条")),
    ])
    return f"list_transform([{every}], lambda a: {distinct_sql('a')}[1:20])[1]"


_EXPANDED = ["价格减免 20 本国产品", "政府采购有哪几种方式", "甲乙"]


@query("query_expansion", f"""select id, {strip_sql(f"t || case when contains(n, '减免') then ' 价格扣除 评审优惠 优惠' else '' end || case when contains(n, '本国产品') then ' 本国产品标准 声明函 组件成本' else '' end || case when {any_sql('n', ('20', '二十'))} then ' 20% 20％ 百分之二十' else '' end || case when {_METHOD} then ' 政府采购法 第二十六条 采购方式 {' '.join(P.methods)}' else '' end")} as query,
    array_to_string({keywords_sql('n', '[]::varchar[]')}, '|') as keywords, array_to_string({distinct_sql('c')}, '|') as codes from (select id, t, {fold_sql('t')} as n, list_filter(regexp_split_to_array(t, '[\\s,，;；]+'), lambda x: x <> '') as c from {phrased_sql(_EXPANDED, 'benchmark')})""")
def query_expansion(spark, sf):
    t = F.col("t")
    return phrased(spark, sf, _EXPANDED, "benchmark").select("id", Q.enriched_query(t, t).alias("query"), F.array_join(Q.keywords(t, F.array().cast("array<string>")), "|").alias("keywords"), F.array_join(split_codes(t), "|").alias("codes"))


_ARTICLES = ["[文号] x\n总则\n序言\n第一条 甲。依照第二条办理。\n第二条 乙\n  第三条 丙", "# 标题\n正文一\n\n1. 小节\n正文二；", "只有一段", "", "第一章 总则\n内容\n第二章 分则\n内容\n内容"]
_ART = f"第{_NUM}条"
_STARTS = f"regexp_replace(regexp_replace(t, '({_ART})', chr(10) || '\\1', 'g'), chr(10) || chr(10) || '({_ART})', chr(10) || '\\1', 'g')"


@query("article_blocks", f"""select id, pos - 1 as pos, {strip_sql('part')} as block from (select id, unnest(p[2:]) as part, unnest(range(1, len(p))) as pos from (select id, string_split(regexp_replace({_STARTS}, '(?m)^([^\\S\\n]*{_ART})', chr(1) || '\\1', 'g'), chr(1)) as p from {phrased_sql(_ARTICLES)}))""")
def article_blocks(spark, sf):
    return phrased(spark, sf, _ARTICLES).select("id", F.posexplode(C.article_blocks(C.at_line_starts(F.col("t")))).alias("pos", "block")).select("id", F.col("pos").cast("bigint").alias("pos"), "block")


def _sections_sql(source: str) -> str:
    return f"""select id, row_number() over (partition by id order by g) - 1 as pos, string_agg(line || chr(10), '' order by i) as section from (select id, i, line, sum(h) over (partition by id order by i) as g from (
    select id, i, line, (regexp_matches(line, '^(#{{1,6}}\\s+.+|第{_NUM}[章节条款].*|[0-9]+[.、].+)$'))::int as h from (select id, i, {strip_sql('raw')} as line from (
    select id, unnest(string_split(t, chr(10))) as raw, unnest(range(1, 1 + len(string_split(t, chr(10))))) as i from {source})) where line <> '')) group by id, g
    union all select id, 0, t from {source} where {strip_sql('t')} = ''"""


@query("sections", _sections_sql(phrased_sql(_ARTICLES)))
def sections(spark, sf):
    got = phrased(spark, sf, _ARTICLES).select("id", F.posexplode(C.sections(F.col("t"))).alias("pos", "section"))
    return got.select("id", F.col("pos").cast("bigint").alias("pos"), "section")


@query("document_sections", _sections_sql("(select doc_id as id, coalesce(text, '') as t from documents) f"))
def document_sections(spark, sf):
    got = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(C.sections(F.col("text"))).alias("pos", "section"))
    return got.select("id", F.col("pos").cast("bigint").alias("pos"), "section")


@query("paragraphs", f"select page_id, i - 1 as pos, p as paragraph from (select page_id, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as i from (select page_id, list_filter(list_transform(regexp_split_to_array(replace(coalesce(html, ''), '</p>', chr(10) || ' ' || chr(10)), '\\n\\s*\\n'), lambda x: {strip_sql('x')}), lambda x: length(x) >= 120) as ps from pages))")
def paragraphs(spark, sf):
    got = table(spark, sf, "pages").select("page_id", F.posexplode(C.paragraphs(F.replace("html", F.lit("</p>"), F.lit("\n \n")))).alias("pos", "paragraph"))
    return got.select("page_id", F.col("pos").cast("bigint").alias("pos"), "paragraph")


_HEADED = ["---\ndoc_no: \"财库〔2022〕3号\"\nissuer: 财政部\nurl: https://a.example/1\n---\n前言\n#### 第一条 总则\n" + "采购活动应当遵循公开透明原则。" * 3 + "\n#### 第二条\n短\n#### 第三条 附则\n" + "本办法自公布之日起施行。" * 4, "无前言\n\n" + "这一段足够长。" * 20 + "\n\n短段"]


@query("headed_articles", f"""select id, h as heading, {strip_sql('x')} as content from (select id, unnest(hs) as h, unnest(string_split(regexp_replace(t, '(?m)^{P.article_heading}$', chr(1), 'g'), chr(1))[2:]) as x from (select id, t, regexp_extract_all(t, '(?m)^{P.article_heading}$', 1) as hs from {phrased_sql(_HEADED)})) where length({strip_sql('x')}) >= 30""")
def headed_articles(spark, sf):
    return phrased(spark, sf, _HEADED).select("id", F.explode(C.headed_articles(F.col("t"))).alias("a")).select("id", "a.heading", "a.content")


@query("front_matter", f"""select id, coalesce(trim(replace(regexp_extract(b, '(?m)^doc_no:(.*)$', 1), '"', '')), '') as doc_no, coalesce(trim(regexp_extract(b, '(?m)^issuer:(.*)$', 1)), '') as issuer, coalesce(trim(regexp_extract(b, '(?m)^url:(.*)$', 1)), '') as url, length(body) as n
    from (select id, regexp_extract(t, '(?s)^---\\n(.*?)\\n---\\n', 1) as b, regexp_replace(t, '(?s)^---\\n.*?\\n---\\n', '') as body from {phrased_sql(_HEADED)})""")
def front_matter(spark, sf):
    got = phrased(spark, sf, _HEADED).select("id", M.front_matter(F.col("t")).alias("f"))
    of = lambda k: F.coalesce(F.col("f.fields")[k], F.lit("")).alias(k)
    return got.select("id", of("doc_no"), of("issuer"), of("url"), F.length("f.body").cast("bigint").alias("n"))


def _dash_sql(key: str) -> str:
    return f"nullif({strip_sql(f"regexp_extract(body, '(?im)^-[^\\S\\n]*{key}:[^\\S\\n]*(.*)$', 1)")}, '')"


_FRONT = "nullif(trim(trim(regexp_extract(b, '(?m)^{}:(.*)$', 1)), '\"'), '')"
_FAST_NO = f"nullif(regexp_replace(regexp_extract(body, '{P.doc_no_fast}'), '\\s+', '', 'g'), '')"


@query("fast_chunks", f"""select '文件' || id as title, coalesce({_FRONT.format('doc_no')}, {_FAST_NO}, '') as doc_no, coalesce({_FRONT.format('issuer')}, '') as issuer, coalesce({_dash_sql('law_level')}, '') as law_level, part.h as article_no, part.x as content, '/c/文件' || id || '.md' as source_path, 'structured_text' as content_type,
    coalesce({", ".join(_FRONT.format(k) for k in ("source_url", "url", "source_link"))}, {", ".join(_dash_sql(k) for k in ("source_url", "url", "source_link", "来源链接"))}, '') as source_url, pos::int - 1 as pos
    from (select *, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as pos from (select *, list_filter(case when regexp_matches(body, '(?m)^{P.article_heading}$') then list_transform(list_zip(regexp_extract_all(body, '(?m)^{P.article_heading}$', 1), string_split(regexp_replace(body, '(?m)^{P.article_heading}$', chr(1), 'g'), chr(1))[2:]), lambda z: {{'h': {strip_sql('z[1]')}, 'x': {strip_sql('z[2]')}, 'n': 30}})
      else list_transform(regexp_split_to_array(body, '\\n\\s*\\n'), lambda z: {{'h': '', 'x': {strip_sql('z')}, 'n': 120}}) end, lambda z: length(z.x) >= z.n) as parts
    from (select id, regexp_extract(t, '(?s)^---\\n(.*?)\\n---\\n', 1) as b, regexp_replace(t, '(?s)^---\\n.*?\\n---\\n', '') as body from {phrased_sql(_HEADED)})))""")
def fast_chunks(spark, sf):
    return C.fast_chunks(phrased(spark, sf, _HEADED).select(F.concat(F.lit("/c/文件"), "id", F.lit(".md")).alias("path"), F.col("t").alias("text")))


@query("chunk_windows", f"select doc_id, pos, md5(piece) as piece, length(piece) as size from {WINDOWS_SQL}")
def chunk_windows(spark, sf):
    got = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(C.windows(F.col("text"))).alias("pos", "piece"))
    return got.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("piece").alias("piece"), F.length("piece").cast("bigint").alias("size"))


@query("chunk_dedup", f"select doc_id, len(u) as n, md5(array_to_string(u, chr(10))) as lines from (select doc_id, {distinct_sql('l')} as u from (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {strip_sql('x')}), lambda x: {dense_sql('x')} <> '') as l from documents))")
def chunk_dedup(spark, sf):
    u = C.unique_stripped(F.split(F.coalesce("text", F.lit("")), "\n"))
    return table(spark, sf, "documents").select("doc_id", F.size(u).cast("bigint").alias("n"), F.md5(F.array_join(u, "\n")).alias("lines"))


@query("substantive_chunks", f"""select doc_id, i - 1 as pos, length(line) as n from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) as i from documents)
    where {dense_sql('line')} <> '' and (length({dense_sql("regexp_replace(line, '(?m)^\\[[^\\]]+\\].*$', '', 'g')")}) >= 36 or regexp_matches(line, '{_ART}'))""")
def substantive_chunks(spark, sf):
    got = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).where(C.substantive(F.col("line")))
    return got.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.length("line").cast("bigint").alias("n"))


_CHUNK_TITLES = ["某办法", "某条例（附件: 表1）", "关于某事的通知"]
_BODY = "regexp_replace(raw, '(?m)^\\[[^\\]]+\\].*$', '', 'g')"
_CLAUSE = f"coalesce(nullif(regexp_extract(raw, '第{_NUM}款'), ''), regexp_extract(raw, '（{_NUM}）'))"


@query("chunk_documents", f"""with d as materialized (select id, {pick_sql(_CHUNK_TITLES, 'id')} as title, {pick_sql(['某办法', '某条例', '关于某事的通知'], 'id')} as law_title, {pick_sql(['MINISTERIAL_RULE', 'ADMIN_REGULATION', 'NORMATIVE_DOC'], 'id')} as doc_category, t as text, {_STARTS} as t from {phrased_sql(_ARTICLES)}),
    a as materialized (select id, unnest(p[2:]) as part, unnest(range(1, len(p))) as i from (select id, string_split(regexp_replace(t, '(?m)^([^\\S\\n]*{_ART})', chr(1) || '\\1', 'g'), chr(1)) as p from d)),
    s as materialized ({_sections_sql('d')}), long as materialized (select id * 1000000 + pos as id, section as t from s where length(section) > 800),
    every as (select id, i, 0 as j, part from a where id in (select id from a group by id having count(*) > 1)
      union all select id, pos, 0, section from s where length(section) <= 800 and id not in (select id from a group by id having count(*) > 1)
      union all select id // 1000000, id % 1000000, pos, piece from {windows_sql('long')} where id // 1000000 not in (select id from a group by id having count(*) > 1)),
    u as (select id, {distinct_sql('l')} as l from (select id, list({strip_sql('part')} order by i, j) filter ({dense_sql('part')} <> '') as l from every group by id))
    select id || '#' || pos as chunk_id, id::varchar as document_id, title, 'NATIONAL' as region_level, '/c/a.md' as source_path, '[法规标题] ' || law_title || chr(10) || '[法规类别] ' || doc_category || chr(10) || case when article_no <> '' then '[条号] ' || article_no || chr(10) else '' end || case when {_CLAUSE} <> '' then '[款项] ' || {_CLAUSE} || chr(10) else '' end || raw as content,
      law_title, article_no, doc_category, pos from (select id, raw, pos::int - 1 as pos, regexp_extract(raw, '{_ART}') as article_no from (select id, unnest(l) as raw, unnest(range(1, len(l) + 1)) as pos from u)) join d using (id)
    where regexp_matches(title, '{P.attachment_suffix}') or contains(text, '[文档类型] 附件') or length({dense_sql(_BODY)}) >= 36 or ({dense_sql(_BODY)} <> '' and regexp_matches({_BODY}, '{_ART}')) or (contains(raw, '[文档类型] 主文') and regexp_matches(raw, '(\\[疑似扫描\\] true|\\[提示\\] 主文抽取失败|\\[提示\\] 主文疑似扫描稿或可读文本为空)'))""")
def chunk_documents(spark, sf):
    return C.chunk_documents(_documents_to_cut(spark, sf))


def _documents_to_cut(spark, sf):
    return spread(phrased(spark, sf, _ARTICLES)).select(F.col("id").cast("string").alias("id"), pick(_CHUNK_TITLES, F.col("id")).alias("title"), F.lit("NATIONAL").alias("region_level"), F.lit("/c/a.md").alias("source_path"), F.col("t").alias("text"))


_CUT_SQL, _, _REST = ORACLES["chunk_documents"].partition("    select id || '#' ||")
_CUT_FROM, _, _KEPT = ("from " + _REST.partition("doc_category, pos from ")[2]).partition("\n    where ")


@query("ingest_counters", f"{_CUT_SQL} select (select count(*) from d) as documents, count(*) filter ({_KEPT}) as chunks, count(*) filter (not ({_KEPT})) as skipped {_CUT_FROM}")
def ingest_counters(spark, sf):
    """The counters of writing all chunks, taken while they are written."""
    got = stores.ingest(_documents_to_cut(spark, sf), f"{shared_dir(spark)}/veinwork/chunks-{uuid.uuid4().hex}")
    return spark.createDataFrame([(got["documents"], got["chunks"], got["skipped"])], "documents bigint, chunks bigint, skipped bigint")


_ANSWERS = ["<think>plan\nx</think>结论：可以。\n\n\n\n来源路径: /home/a/b.md\n见 /opt/data/x.pdf 末", "", "<THINK>未完", "正常\n\n回答"]


@query("sanitize_answer", f"""select id, case when length(a) > {P.answer_chars} then substr(a, 1, {P.answer_chars}) || '...' else a end as answer from (select id, {strip_sql("regexp_replace(regexp_replace(regexp_replace(" + strip_sql("regexp_replace(" + strip_sql("regexp_replace(t, '(?is)<think>.*?</think>', '', 'g')") + ", '(?is)<think>.*$', '', 'g')") + ", '(?im)^\\s*(\\*\\*)?(目录|文件绝对路径|文件路径|来源路径|绝对路径)(\\*\\*)?\\s*[:：].*$', '', 'g'), '(?i)(/users/\\S+|/home/\\S+|/opt/\\S+|/tmp/\\S+|/var/\\S+|[a-z]:\\\\\\\\\\S+)', '[已隐藏路径]', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} as a from {phrased_sql(_ANSWERS)})""")
def sanitize_answer(spark, sf):
    return phrased(spark, sf, _ANSWERS).select("id", T.clean_answer(F.col("t")).alias("answer"))


# Every tenth document's meta.json is empty, and every tenth none; the others hold the whole text as a note.


@query("meta_json", """select id, coalesce(nullif(trim(j->>'$.title'), ''), nullif(trim(j->>'$.name'), ''), '') as title, coalesce(nullif(trim(j->>'$."文号"'), ''), '') as doc_no, coalesce(nullif(trim(j->>'$.url'), ''), '') as source_url,
    coalesce(array_to_string(list_filter([case when coalesce(j->>'$.note', '') <> '' then 'note=' || case when length(x) > 200 then substr(x, 1, 200) || '...' else x end end, case when j->>'$.n' is not null then 'n=' || (j->>'$.n') end], lambda x: x is not null), ';'), '') as extras
    from (select id, j, """ + collapse_sql("j->>'$.note'") + """ as x from (select doc_id as id, case doc_id % 10 when 0 then null when 1 then '{}'::json else json_object('name', source, '文号', '财库〔2022〕' || doc_id || '号', 'url', 'https://a.example', 'note', coalesce(text, ''), 'n', doc_id) end as j from documents))""")
def meta_json(spark, sf):
    held = F.to_json(F.struct(F.col("source").alias("name"), F.concat(F.lit("财库〔2022〕"), "doc_id", F.lit("号")).alias("文号"), F.lit("https://a.example").alias("url"), F.coalesce("text", F.lit("")).alias("note"), F.col("doc_id").alias("n")))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "not json").when(F.col("doc_id") % 10 == 1, "{}").otherwise(held).alias("t"))
    got = docs.select("id", M.meta_json(F.col("t")).alias("m"))
    return got.select("id", "m.title", "m.doc_no", "m.source_url", F.array_join(F.transform(F.map_entries("m.extras"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("extras"))
