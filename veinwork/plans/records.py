"""Queries on evaluations, workspaces and files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veinwork.functions import meta as M
from veinwork.operators import evaluate as V, workspace as W
from veinwork.domain import REGULATIONS as P
from veinwork.plans.base import dense_sql, pick, pick_sql, query, strip_sql, table
from veinwork.plans.texts import GARBLED_SQL, _html_sql
from veinwork.scratch import shared_dir
from veinwork.sources import extract, files as S, reports, stores
from veinwork.streaming import ingest as I, memo


def _results(spark, sf):
    """Answers to evaluate: labelled documents; toxic ones failed, poor short ones are empty. The latency is the text's length."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    answer = F.when((F.col("quality") == 0) & (F.col("n_chars") < 800), "").otherwise(F.col("text"))
    status = V.answer_status(answer, F.col("toxic") == 0)
    anchor = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit(" the "))
    return docs.select("doc_id", "lang", "source", "n_chars", answer.alias("answer"), status.alias("status"), anchor.alias("anchor"), V.anchored(anchor, answer).alias("anchor_hit"), F.col("n_chars").cast("double").alias("latency_ms"))


_RESULTS = """results as (select doc_id, lang, source, n_chars, answer, case when toxic <> 0 then 'ERR' when regexp_replace(answer, '\\s+', '', 'g') = '' then 'EMPTY' else 'OK' end as status, anchor,
    trim(anchor) <> '' and contains(answer, trim(anchor)) as anchor_hit, n_chars::double as latency_ms from (select *, case when quality = 0 and n_chars < 800 then '' else text end as answer, case when doc_id % 3 = 0 then '' else ' the ' end as anchor from documents join labels using (doc_id)))"""


@query("eval_summary", f"""with {_RESULTS}, l as (select *, case when status in ('OK', 'EMPTY') then latency_ms end as took from results) select count(*) as total, count(*) filter (status = 'OK') as ok, count(*) filter (status = 'EMPTY') as empty, count(*) filter (status not in ('OK', 'EMPTY')) as err,
    round(100.0 * count(*) filter (status = 'OK') / count(*), 2)::double as success_rate, count(*) filter (trim(anchor) <> '') as anchor_total, count(*) filter (anchor_hit) as anchor_hit, round(100.0 * count(*) filter (anchor_hit) / count(*) filter (trim(anchor) <> ''), 2)::double as anchor_hit_rate,
    trunc(quantile_cont(took, 0.5))::int as p50, trunc(quantile_cont(took, 0.95))::int as p95, round(avg(took), 2) as mean from l""")
def eval_summary(spark, sf):
    return V.summary(_results(spark, sf))


@query("anchor_hit", f"with {_RESULTS} select doc_id, status, anchor_hit from results")
def anchor_hit(spark, sf):
    return _results(spark, sf).select("doc_id", "status", "anchor_hit")


_RUN = "select doc_id, lang as category, source, case when status = 'EMPTY' then 'MISS' else status end as status, round(n_chars / 10000.0, 4) as top_score, n_chars < 500 as fallback, n_chars % 5 as evidence_count, anchor, source as top_title, answer from results"


def _run(spark, sf):
    return _results(spark, sf).select("doc_id", F.col("lang").alias("category"), "source", F.when(F.col("status") == "EMPTY", "MISS").otherwise(F.col("status")).alias("status"), F.round(F.col("n_chars") / 10000.0, 4).alias("top_score"), (F.col("n_chars") < 500).alias("fallback"), (F.col("n_chars") % 5).alias("evidence_count"), "anchor", F.col("source").alias("top_title"), "answer")


@query("regression_metrics", f"""with {_RESULTS}, r as ({_RUN}) select count(*) as total, count(*) filter (status = 'OK') as ok, count(*) filter (status = 'MISS') as miss, count(*) filter (status = 'ERR') as err, count(*) filter (fallback) as fallback, count(*) filter (evidence_count = 0) as empty_evidence,
    count(*) filter (trim(anchor) <> '' and (contains(top_title, trim(anchor)) or contains(answer, trim(anchor)))) as anchor_hit, round(avg(top_score::double) filter (status <> 'ERR'), 4) as avg_top_score from r""")
def regression_metrics(spark, sf):
    return V.regression_metrics(_run(spark, sf))


@query("category_stats", f"with {_RESULTS}, r as ({_RUN}) select coalesce(nullif(category, ''), '未分类') as category, count(*) as n, count(*) filter (status = 'OK') as ok, count(*) filter (status = 'MISS') as miss, round(coalesce(avg(top_score::double) filter (status <> 'ERR'), 0), 4) as avg_top_score from r group by 1")
def category_stats(spark, sf):
    return V.by_category(_run(spark, sf))




@query("compare_old_new", f"""with {_RESULTS}, new as (select doc_id::varchar as question, case when status = 'EMPTY' then 'MISS' else status end as status from results), old as (select doc_id::varchar as question, case when doc_id % 4 = 0 then 'MISS' when doc_id % 4 = 1 then 'OK' else case when status = 'EMPTY' then 'MISS' else status end end as old_status from results where doc_id % 5 <> 0)
    select question, status, old_status, case when old_status is null then 'NEW_ONLY' when old_status = 'MISS' and status = 'OK' then 'IMPROVED' when old_status = 'OK' and status = 'MISS' then 'REGRESSED' when old_status = status then 'SAME' else 'CHANGED' end as compare from new left join old using (question)""")
def compare_old_new(spark, sf):
    new = _run(spark, sf).select(F.col("doc_id").cast("string").alias("question"), "status", "answer")
    k = F.col("doc_id") % 4
    old = _run(spark, sf).where(F.col("doc_id") % 5 != 0).select(F.col("doc_id").cast("string").alias("question"), F.when(k == 0, "MISS").when(k == 1, "OK").otherwise(F.col("status")).alias("status"), "answer", F.col("doc_id").alias("pos"))
    return V.compare_runs(new, old).select("question", "status", "old_status", "compare")


@query("compare_counts", f"""with {_RESULTS}, new as (select doc_id, case when status = 'EMPTY' then 'MISS' else status end as status from results) select compare, count(*) as n from (select case when doc_id % 5 = 0 then 'NEW_ONLY' when o = 'MISS' and status = 'OK' then 'IMPROVED' when o = 'OK' and status = 'MISS' then 'REGRESSED' when o = status then 'SAME' else 'CHANGED' end as compare
    from (select *, case when doc_id % 4 = 0 then 'MISS' when doc_id % 4 = 1 then 'OK' else status end as o from new)) group by compare""")
def compare_counts(spark, sf):
    return compare_old_new(spark, sf).groupBy("compare").agg(F.count("*").alias("n"))


@query("stratified_sample", """select doc_id, source, round::int as round, place::int as place from (select *, row_number() over (order by round, size desc, source) as place from (select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) as round, count(*) over (partition by source) as size from documents) where round <= 50) where place <= 50""")
def stratified_sample(spark, sf):
    return V.stratified(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 50).select("doc_id", "source", "round", "place")


@query("pdf_candidates", f"""select source as source_path, count(*) as chunks, arg_max({strip_sql('text')}, length({strip_sql('text')}) * 100000000 - doc_id) as best_content, list_sort(list(distinct lang)) as article_nos from documents group by source having max(length({strip_sql('text')})) >= 80""".replace("list_sort(list(distinct lang))", "array_to_string(list_sort(list(distinct lang)), '|')"))
def pdf_candidates(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("source_path"), F.col("text").alias("content"), F.col("doc_id").alias("ord"), F.col("lang").alias("article_no"))
    return V.candidates_by_path(rows).withColumn("article_nos", F.array_join("article_nos", "|"))


_TEMPLATES = ["《{title}》主要规范什么事项？", "依据《{title}》，核心的合规要求有哪些？", "《{title}》对应的办理流程大致分哪几个阶段？", "按《{title}》，最容易被忽略的时限要求是什么？"]


@query("question_templates", "select page_id as pos, replace([" + ", ".join(f"'{t}'" for t in _TEMPLATES) + "][page_id % 4 + 1], '{title}', url) as question from pages")
def question_templates(spark, sf):
    return V.templated(table(spark, sf, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("title")), _TEMPLATES)


_DRAWN = {"template": ["{law}对{topic}有什么要求？", "{topic}适用{law}哪一条？"], "law": ["政府采购法", "实施条例", "招标投标法"]}


def _drawn_sql(name: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in _DRAWN[name]) + f"][('0x' || substr(md5('7|{name}|' || item_id), 1, 7))::bigint % {len(_DRAWN[name])} + 1]"


@query("random_questions", f"select item_id, replace(replace({_drawn_sql('template')}, '{{law}}', {_drawn_sql('law')}), '{{topic}}', coalesce(text, '')) as question from benchmark")
def random_questions(spark, sf):
    return V.drawn_questions(table(spark, sf, "benchmark"), "item_id", "text", {"law": _DRAWN["law"]}, _DRAWN["template"])


# Workspaces.


@query("history", "select conv_id, count(*) as n_messages, count(*) filter (role = 'user') as n_user, max(turn) as last_turn, substr(" + strip_sql("arg_min(text, turn) filter (role = 'user')") + ", 1, 80) as title from conversations group by conv_id order by last_turn desc, conv_id limit 50")
def history(spark, sf):
    return W.history(table(spark, sf, "conversations"))


@query("project_summary", "select conv_id % 10 as project_id, count(distinct conv_id) as n_conversations, count(*) as n_messages, sum(length(coalesce(text, '')))::bigint as n_chars from conversations group by 1")
def project_summary(spark, sf):
    return W.project_summary(table(spark, sf, "conversations"), F.col("conv_id") % 10)


@query("last_active", "select c_custkey as project_id, greatest(c_custkey % 1000, m) as last_active from customer left join (select o_custkey, max(o_orderkey) as m from orders group by 1) on o_custkey = c_custkey")
def last_active(spark, sf):
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 1000).alias("updated_at"))
    talks = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("updated_at"))
    return W.last_active(projects, talks)


@query("conversation_search", "select conv_id, turn from conversations where contains(lower(coalesce(text, '')), 'the') and contains(lower(coalesce(text, '')), 'of')")
def conversation_search(spark, sf):
    return W.find(table(spark, sf, "conversations"), F.col("text"), "the OF").select("conv_id", "turn")


_CODES = "select upper(trim(user_id::varchar || '-' || event_type)) as code from events where coalesce(event_type, '') <> ''"


def _codes(spark, sf):
    return table(spark, sf, "events").where(F.coalesce("event_type", F.lit("")) != "").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("code"))


def _known(spark, sf):
    return table(spark, sf, "customer").select(F.upper(F.concat(F.col("c_custkey").cast("string"), F.lit("-CLICK"))).alias("code"))


@query("invite_import", f"select distinct code from ({_CODES}) where code not in (select upper(c_custkey::varchar || '-CLICK') from customer)")
def invite_import(spark, sf):
    return W.import_codes(_codes(spark, sf), _known(spark, sf))


@query("invite_counts", f"with c as ({_CODES}), k as (select upper(c_custkey::varchar || '-CLICK') as code from customer) select count(*) as given, count(distinct code) filter (code not in (select code from k)) as imported, count(*) - count(distinct code) filter (code not in (select code from k)) as skipped from c")
def invite_counts(spark, sf):
    return W.import_counts(_codes(spark, sf), _known(spark, sf))


@query("invite_stats", "select count(*) as total, count(*) filter (c_acctbal > 0) as active, count(*) filter (c_mktsegment is not null and trim(c_mktsegment) <> '' and c_nationkey % 2 = 0) as used from customer")
def invite_stats(spark, sf):
    return W.code_stats(table(spark, sf, "customer").select((F.col("c_acctbal") > 0).alias("active"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("used_by")))


@query("active_sessions", "select user_id, max(ts) as last_access, count(*) as touches from events group by user_id having epoch((select max(ts) from events)) - epoch(max(ts)) <= 86400 * 3")
def active_sessions(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts")).first()[0]
    return W.active_sessions(events, F.lit(now), 86400 * 3)


@query("user_sessions", "select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts) as s from (select user_id, ts, (lag(ts) over (partition by user_id order by ts) is null or ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes)::int as fresh from events)) group by user_id, s")
def user_sessions(spark, sf):
    got = I.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("latest_state", "select user_id, ts, event_type from (select user_id, max(ts) as ts, arg_max(event_type, ts) as event_type from events group by user_id) where event_type <> 'purchase'")
def latest_state(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_type", (F.col("event_type") == "purchase").alias("deleted"))
    return W.latest_state(rows, ["user_id"], "ts").select("user_id", "ts", "event_type")


# The events as a workspace's log: some of them name another user's project, one that is not there, or a project in which the conversation does not stand.
_LOG = """log as materialized (select event_id as seq, floor(epoch(ts))::bigint as moment, user_id, (user_id + (event_id % 11 = 0)::int) * 10 + (event_id // 3) % 4 as project_id, user_id * 10 + (event_id // 7) % 3 as talk_id, ' ' || event_type || ' ' || event_id || ' ' as text,
      case when event_type = 'signup' then 'create_project' when event_type = 'error' and event_id % 8 = 0 then 'delete_project' when event_type = 'error' then 'update_project' when event_type = 'purchase' then 'create_talk' when event_type = 'click' then 'move_talk' else 'append' end as kind from events),
    life as materialized (select m.*, (select min(seq) from log d where d.kind = 'delete_project' and d.project_id = m.project_id and d.user_id = m.user_id and d.seq > m.born) as dead from (select project_id, arg_min(user_id, seq) as user_id, trim(arg_min(text, seq)) as name, arg_min(moment, seq) as created_at, min(seq) as born from log where kind = 'create_project' group by project_id) m),
    ok as materialized (select log.*, dead, row_number() over (partition by user_id, talk_id order by seq) as i from log join life using (project_id, user_id) where seq > born and (dead is null or seq < dead) and kind in ('create_talk', 'move_talk', 'append')),
    fold as (select user_id, talk_id, 0::bigint as i, null::bigint as p, null::bigint as over, null::bigint as source, null::varchar as title, null::bigint as created, null::bigint as updated, 0 as said, 'none' as did, false as ever from (select distinct user_id, talk_id from ok)
      union all select f.user_id, f.talk_id, k.i, case when yes and kind <> 'append' then project_id else p end, case when yes and kind <> 'append' then dead else over end, case when yes and kind = 'move_talk' then p end, case when yes and kind = 'create_talk' then trim(text) else title end,
        case when yes and kind = 'create_talk' then moment else created end, case when yes then moment else updated end, said + (yes and kind = 'append')::int, case when yes then kind else 'none' end, ever or (yes and kind = 'create_talk')
        from fold f join ok k on k.user_id = f.user_id and k.talk_id = f.talk_id and k.i = f.i + 1,
        lateral (select case kind when 'create_talk' then not ever when 'move_talk' then ever and (over is null or seq < over) and project_id <> p else ever and (over is null or seq < over) and project_id = p end as yes))"""
_TOUCHED = """touched as (select p as project_id, updated as moment from fold where did <> 'none' union all select source, updated from fold where did = 'move_talk' union all select project_id, moment from log join life using (project_id, user_id) where kind = 'update_project' and seq > born and (dead is null or seq < dead)),
    named as (select project_id, trim(arg_max(text, seq)) as name from log join life using (project_id, user_id) where kind = 'update_project' and seq > born and (dead is null or seq < dead) group by project_id)"""


def _log(spark, sf):
    e, n = table(spark, sf, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "create_project").when((F.col("event_type") == "error") & (n % 8 == 0), "delete_project").when(F.col("event_type") == "error", "update_project")
    kind = kind.when(F.col("event_type") == "purchase", "create_talk").when(F.col("event_type") == "click", "move_talk").otherwise("append")
    return e.select(
        n.alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "user_id", ((F.col("user_id") + (n % 11 == 0).cast("int")) * 10 + F.floor(n / 3) % 4).alias("project_id"), (F.col("user_id") * 10 + F.floor(n / 7) % 3).alias("talk_id"),
        F.concat(F.lit(" "), "event_type", F.lit(" "), n, F.lit(" ")).alias("text"), kind.alias("kind"),
    )


@query("workspace_talks", f"with recursive {_LOG} select f.user_id, f.talk_id, p as project_id, title, created as created_at, updated as updated_at, said::bigint as n_messages from fold f join (select user_id, talk_id, max(i) as i from fold group by user_id, talk_id) using (user_id, talk_id, i) where p is not null and over is null")
def workspace_talks(spark, sf):
    log = _log(spark, sf)
    spans = W.talk_spans(log, W.project_lives(log))
    return W.talks(spans, W.talk_messages(log, spans))


@query("workspace_projects", f"with recursive {_LOG}, {_TOUCHED} select l.user_id, l.project_id, coalesce(n.name, l.name) as name, l.created_at, greatest(l.created_at, coalesce(t, 0)) as updated_at, row_number() over (partition by l.user_id order by l.project_id % 10 = 2 desc, greatest(l.created_at, coalesce(t, 0)) desc, l.project_id) as rank from life l left join named n using (project_id) left join (select project_id, max(moment) as t from touched group by project_id) using (project_id) where dead is null")
def workspace_projects(spark, sf):
    log = _log(spark, sf)
    lives = W.project_lives(log)
    spans = W.talk_spans(log, lives)
    return W.pinned_order(W.projects(log, lives, spans, W.talk_messages(log, spans)), F.col("project_id") % 10 == 2)


@query("merge_store", "select s_suppkey::varchar as id, coalesce(arg_max(p, changed), any_value(s_name)) as payload from supplier left join (select c_custkey as k, c_name as p, c_acctbal as changed from customer where c_custkey % 3 = 0) on k = s_suppkey group by s_suppkey")
def merge_store(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("payload"))
    c = table(spark, sf, "customer").where(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("payload"), F.col("c_acctbal").alias("at"))
    return stores.merge_document(s, c.join(s.select("id"), "id", "left_semi"))


@query("owned_projects", "select o_orderkey as id, c_name as username from orders left join customer on c_custkey = o_custkey")
def owned_projects(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_user_id"))
    return W.owned(p, table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))).select("id", "username")


@query("legacy_hash", "select c_custkey, sha256(c_name) as hash from customer")
def legacy_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", W.legacy_hash(F.col("c_name")).alias("hash"))


# Files.

# Every document is a file's text; eleven of them make four folders, which are numbered.
_FILES = [
    "/国家法规/a%/content.md", "/国家法规/a%/通知.pdf", "/国家法规/a%/附件/模板.xlsx", "/江苏省政策法规/b%/办法.docx", "/江苏省政策法规/b%/清单.xls", "/江苏省政策法规/b%/list.txt",
    "/扬州文件制度/c%/封面.pdf", "/扬州文件制度/c%/目录.doc", "/d%/content.html", "/d%/实施细则流程.pdf", "/d%/note.zip",
]
_FIRST_WORDS = ["发稿时间 附件.pdf 见附件\n", *[""] * 7, "来源：门户\n", "", "采购活动应当依照本办法进行。" * 60]


def _numbered(paths: list[str], every: int):
    return F.replace(pick(paths, F.col("doc_id")), F.lit("%"), F.floor(F.col("doc_id") / every).cast("string"))


def _numbered_sql(paths: list[str], every: int) -> str:
    return f"replace({pick_sql(paths, 'doc_id')}, '%', (doc_id // {every})::varchar)"


def _file_rows(spark, sf):
    text = F.concat(pick(_FIRST_WORDS, F.col("doc_id")), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select(_numbered(_FILES, len(_FILES)).alias("path"), text.alias("text")).withColumn("size", F.length("text"))


_REFERENCE = f"(regexp_matches(name, '{P.reference_file}') and not regexp_matches(name, '{P.legal_file}'))"
_KINDS = f"""(select *, ext in ('md','txt','html','htm','pdf','doc','docx','xls','xlsx','csv','ppt','pptx') and name <> 'list.txt' as is_primary, ext in ('pdf','doc','docx','xls','xlsx','txt','md','html','htm') and name <> 'list.txt' as is_attachment,
    name in ('content.md', 'content.html') as is_content, {_REFERENCE} as is_reference from (select *, regexp_extract(path, '([^/]*)$', 1) as name, regexp_extract(path, '\\.([^./]*)$', 1) as ext, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder
    from (select {_numbered_sql(_FILES, len(_FILES))} as path, {pick_sql(_FIRST_WORDS, 'doc_id')} || coalesce(text, '') as text from documents)))"""
_ARTICLES_IN = f"len(regexp_extract_all(text, '{P.article}'))"
_PRIMARIES = f"""(select *, case when page is null then case when plain then '目录无 content.*，过滤明显参考类文件后入库' else '目录无 content.*，全部文件按独立主文入库' end when switched then 'content.* 疑似摘要，自动切换为正文文件' else '命中 content.*' end as reason
    from (select *, summary and best is not null as switched from (select *, max(case when path = page then n = 0 or (n <= 2400 and articles <= 1 and (hints >= 2 or (coalesce(longest, 0) > 0 and coalesce(longest, 0) >= greatest(1200.0, n * 1.6)))) end) over w as summary, arg_max(path, (rating, path)) filter (path <> page and not is_reference) over w as best, max(not is_content and not is_reference) over w as plain
    from (select *, max(case when path <> page and not is_reference then n end) over (partition by folder) as longest from (select *, min(case when is_content then path end) over (partition by folder) as page, length({dense_sql('text')}) as n, {_ARTICLES_IN} as articles,
      regexp_matches(text, '{P.summary_hint_ingest}')::int + (length({dense_sql('text')}) <= 2400)::int + (contains(text, '.pdf') or contains(text, '附件'))::int as hints,
      case ext when 'pdf' then 120 when 'doc' then 110 when 'docx' then 110 when 'md' then 90 when 'txt' then 90 when 'html' then 75 when 'htm' then 75 when 'xls' then 60 when 'xlsx' then 60 else 0 end
        + (case when regexp_matches(name, '{P.legal_file}') then 35 else 0 end) - (case when regexp_matches(name, '{P.reference_file}') then 35 else 0 end) + floor(least(30.0, log10(greatest(1, length(text))) * 6))::int as rating from {_KINDS} where is_primary)) window w as (partition by folder)))
    where case when page is not null then path = case when switched then best else page end else not plain or not is_reference end)"""


@query("primary_selection", f"select path, reason from {_PRIMARIES}")
def primary_selection(spark, sf):
    return S.primaries(_file_rows(spark, sf)).select("path", "reason")


@query("attachments", f"""with k as materialized (select * from {_KINDS}), m as materialized (select path as main, folder from {_PRIMARIES}), f as (select folder from k group by folder having max(is_content) or count(*) filter (is_primary) <= 1)
    select distinct main as "primary", path from (select main, path from m join (select path, regexp_extract(path, '^(.*?)/附件/', 1) as folder from k where is_attachment and contains(path, '/附件/')) using (folder)
      union all select main, path from m join (select path, folder from k where is_attachment and not is_content and folder in (select folder from f)) using (folder)) where main <> path""")
def attachments(spark, sf):
    rows = _file_rows(spark, sf)
    return S.attachments(rows, S.primaries(rows))


@query("attachment_kind", f"""select path, case when regexp_matches(name, '\\.(xls|xlsx|csv)$') or regexp_matches(name, '{P.reference_attachment}') or {GARBLED_SQL.format(d='d')} or not (regexp_matches(name, '{P.legal_attachment}') or length(d) > 1200 or regexp_matches(d, '{P.article_any}'))
    then '参考型附件' else '正文型附件' end as kind from (select path, name, {dense_sql('text')} as d from {_KINDS})""")
def attachment_kind(spark, sf):
    return _file_rows(spark, sf).select("path", S.attachment_kind(M.file_name(F.col("path")), F.col("text")).alias("kind"))


@query("file_kinds", f"select path, name, is_primary, is_attachment, is_content, is_reference from {_KINDS}")
def file_kinds(spark, sf):
    return S.file_kinds(_file_rows(spark, sf)).select("path", "name", "is_primary", "is_attachment", "is_content", "is_reference")


@query("raw_attachments", f"select regexp_replace(name, '\\.[^.]+$', '') as title, '附件原文 ' || regexp_replace(name, '\\.[^.]+$', '') || ' ' || regexp_extract(folder, '([^/]*)$', 1) || ' ' || name as content, path as source_path from {_KINDS}")
def raw_attachments(spark, sf):
    return S.raw_attachment_rows(_file_rows(spark, sf)).select("title", "content", "source_path")


_NAMES = ["/国家法规/政府采购法实施条例%/1_正文.pdf", "/data/x%/03-关于某事项的通知.docx", "/a%/corpus/abc.md"]


@query("titles_of_files", f"select doc_id as id, {_numbered_sql(['政府采购法实施条例%', '关于某事项的通知', 'corpus'], 3)} as title, {_numbered_sql(['政府采购法实施条例%', '关于某事项的通知', '短'], 3)} as repaired from documents")
def titles_of_files(spark, sf):
    """Titles out of the files' paths alone, one path for a document."""
    path = _numbered(_NAMES, 3)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), M.title(F.lit(""), path).alias("title"), M.repaired_title(F.lit("短"), path).alias("repaired"))


@query("documents_of_files")
def documents_of_files(spark, sf):
    """A meta.json lies in every second folder."""
    rows = _file_rows(spark, sf)
    folders = rows.select(M.parent(F.col("path")).alias("folder")).distinct().where(F.crc32("folder") % 2 == 0)
    metas = folders.select("folder", F.to_json(F.struct(F.lit("某通知").alias("title"), F.concat(F.lit("财库 [2022] "), F.crc32("folder") % 900 + 1, F.lit(" 号")).alias("文号"), F.lit("x").alias("note"))).alias("json"))
    return S.documents(S.primaries(rows), metas)


@query("export_lines", "select conv_id, turn, sum(greatest(1, ceil(length(l) / 95.0)))::bigint as n from (select conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as l from conversations) group by conv_id, turn")
def export_lines(spark, sf):
    from veinwork.operators.answer import export_lines as lines

    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(lines(F.col("text"))).cast("bigint").alias("n"))



def _requests(spark, sf):
    """Events as requests to two instances: the type and a user's group are the question; answers of low value are not kept, a purchase of a high value reloads the corpus."""
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 2).alias("instance"), F.col("event_id").alias("id"), "ts", memo.memo_key(F.concat_ws(" ", "event_type", (F.col("user_id") % 10).cast("string"))).alias("key"),
                    (F.col("value") >= 5).alias("cacheable"), ((F.col("event_type") == "purchase") & (F.col("value") >= 60)).alias("reload"))


@query("answer_memo", """with recursive r as (select event_id as id, user_id % 2 as instance, ts, event_type || (user_id % 10) as key, value >= 5 as cacheable, event_type = 'purchase' and value >= 60 as reload from events),
    o as (select *, sum(reload::int) over (partition by instance order by ts, id) as era, row_number() over (partition by instance order by ts, id) as place from r),
    k as materialized (select * from o where not reload and cacheable),
    p as (select instance, key, era, min(ts) as made from k group by all
      union select p.instance, p.key, p.era, (select min(ts) from k where k.instance = p.instance and k.key = p.key and k.era = p.era and k.ts > p.made + interval 30 minutes) from p where p.made is not null),
    m as (select id, max(p.made) as made from o join p on not reload and p.instance = o.instance and p.key = o.key and p.era = o.era and p.made < o.ts and o.ts <= p.made + interval 30 minutes group by id)
    select instance, id, m.made is not null as hit, m.made from r left join m using (id)""")
def answer_memo(spark, sf):
    return memo.replay(_requests(spark, sf)).withColumn("made", F.col("made").cast("timestamp_ntz"))


_KINDS = ["html", "pdf", "txt", "bin", "PDF"]


@query("mixed_files", f"""select page_id, md5(text) as text, length(text) as n, false as scanned, strategy from (select page_id, case when k in ('html', 'pdf', 'PDF') then {_html_sql('html')} when k = 'txt' then html else '' end as text,
    case k when 'html' then 'html' when 'txt' then 'plain' when 'bin' then 'unsupported' else 'html-mime' end as strategy from (select page_id, coalesce(html, '') as html, {pick_sql(_KINDS, 'page_id')} as k from pages))""")
def mixed_files(spark, sf):
    """Pages as files of several names, two of them wrong."""
    pages = table(spark, sf, "pages")
    files = pages.select("page_id", F.concat(F.lit("/c/"), F.col("page_id"), F.lit("."), pick(_KINDS, F.col("page_id"))).alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return extract.read_by_content(files).select("page_id", F.md5("text").alias("text"), F.length("text").cast("bigint").alias("n"), "scanned", "strategy")


_ODD = '{"}] \\ "['


@query("restored_store", "select 'd' || doc_id as chunk_id, md5('{\"}] \\ \"[' || coalesce(text, '')) as content, length(coalesce(text, '')) as n, coalesce(lang, '') as region_level from documents")
def restored_store(spark, sf):
    """Every whole text through a store of JSON arrays and back; braces, quotes and escapes before each so that the cut has to tell them from structure."""
    item = F.struct(F.concat(F.lit("d"), "doc_id").alias("chunkId"), F.concat(F.lit(_ODD), F.coalesce("text", F.lit(""))).alias("content"), F.coalesce("lang", F.lit("")).alias("regionLevel"))
    folder = f"{shared_dir(spark)}/veinwork/store-{uuid.uuid4().hex}"
    table(spark, sf, "documents").select(F.concat(F.lit("["), F.to_json(item), F.lit("]"))).write.text(folder)
    got = stores.read_chunk_store(spark, folder)
    return got.select(F.col("chunkId").alias("chunk_id"), F.md5("content").alias("content"), (F.length("content") - len(_ODD)).cast("bigint").alias("n"), F.col("regionLevel").alias("region_level"))


# A compared run of all answers: every fifth has no old one.
def _compared(spark, sf):
    old = F.when(F.col("doc_id") % 5 != 0, F.when(F.col("doc_id") % 4 == 0, "MISS").when(F.col("doc_id") % 4 == 1, "OK").otherwise(F.col("status")))
    rows = _run(spark, sf).withColumns({"pos": F.col("doc_id"), "question": F.concat(F.lit("q<"), "doc_id", F.lit(">")), "old_status": old, "old_top_title": F.col("category"), "old_answer": F.col("answer")})
    now = F.col("status")
    verdict = F.when(old.isNull(), "NEW_ONLY").when((old == "MISS") & (now == "OK"), "IMPROVED").when((old == "OK") & (now == "MISS"), "REGRESSED").when(old == now, "SAME").otherwise("CHANGED")
    return rows.withColumns({"compare": verdict, "compare_notes": F.concat_ws("/", "old_status", "status")})


_FIG = "case when {x} like '%.' then {x} || '0' else {x} end"
_SCORE = _FIG.format(x="rtrim(top_score::decimal(30,4)::varchar, '0')")
_COMPARED = f"""{_RESULTS}, r as ({_RUN}), o as (select *, doc_id as pos, 'q<' || doc_id || '>' as question, case when doc_id % 5 = 0 then null when doc_id % 4 = 0 then 'MISS' when doc_id % 4 = 1 then 'OK' else status end as old_status, coalesce(nullif(category, ''), '未分类') as cat from r),
    c as materialized (select *, case when old_status is null then 'NEW_ONLY' when old_status = 'MISS' and status = 'OK' then 'IMPROVED' when old_status = 'OK' and status = 'MISS' then 'REGRESSED' when old_status = status then 'SAME' else 'CHANGED' end as compare, concat_ws('/', old_status, status) as compare_notes,
      case when length(pos::varchar) < 3 then lpad(pos::varchar, 3, '0') else pos::varchar end as number, {_SCORE} as score from o)"""
_SHORT = "case when length({t}) > {n} then substr({t}, 1, {n}) || '...' else {t} end"


def _one_line(x: str, n: int) -> str:
    return _SHORT.format(t=strip_sql(f"translate({x}, chr(10) || chr(13), '  ')"), n=n)


def _joined(*lines: str) -> str:
    return " || chr(10) || ".join(lines)


_PAGE = _joined(
    "'# 第 ' || number || ' 题（' || cat || '）'", "''", "'## 问题'", "question", "''", "'## 旧版结果'", "'- old_status: ' || coalesce(old_status, '')", "'- old_top_title: ' || coalesce(category, '')", f"'- old_answer_snippet: ' || {_one_line('answer', 480)}", "''",
    "'## 新版结果'", "'- status: ' || status", "'- evidence_count: ' || evidence_count", "'- top_score: ' || score", "'- anchor: ' || anchor", "''", "'## Top1 证据标题'", "coalesce(top_title, '')", "''", "'## 对比结论'", "'- compare: ' || compare", "'- notes: ' || compare_notes", "''", "'## 回答'", "coalesce(answer, '')",
)


def _escaped(x: str) -> str:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{name}')"
    return x


_CARD = f"""'<article class=''card''><h2>' || number || '. ' || {_escaped('cat')} || '</h2><div><b>问题:</b> ' || {_escaped('question')} || '</div><div><b>状态:</b> ' || status || ' | <b>evidence:</b> ' || evidence_count || ' | <b>top_score:</b> ' || score || '</div><div><b>Top1:</b> ' || {_escaped("coalesce(top_title, '')")} || '</div><div><b>旧版状态:</b> ' || coalesce(old_status, '')
    || '</div><div><b>旧版Top1:</b> ' || {_escaped("coalesce(category, '')")} || '</div><div><b>对比:</b> ' || compare || ' / ' || compare_notes || '</div><pre>' || {_escaped("coalesce(answer, '')")} || '</pre></article>'"""


@query("question_pages", f"with {_COMPARED} select doc_id, md5({_PAGE}) as page, md5({_CARD}) as card, length({_PAGE}) as n from c")
def question_pages(spark, sf):
    """The page and the printed card of every answer."""
    page = reports.page(True)
    return _compared(spark, sf).select("doc_id", F.md5(page).alias("page"), F.md5(reports.card(True)).alias("card"), F.length(page).cast("bigint").alias("n"))


_MANY = ", ".join(f"count(*) filter ({x}) as {n}" for n, x in (("ok", "status = 'OK'"), ("miss", "status = 'MISS'"), ("err", "status = 'ERR'"), ("fallback", "fallback"), ("empty_evidence", "evidence_count = 0"), ("anchor_hit", "trim(anchor) <> '' and (contains(top_title, trim(anchor)) or contains(answer, trim(anchor)))")))
_TOTALS = ", ".join(f"'- {m.upper()}: ' || {m}" for m in reports.METRICS[:-1]) + ", '- AVG_TOP_SCORE: ' || " + _FIG.format(x="rtrim(avg_top_score::decimal(30,4)::varchar, '0')")


def _list(part: int, lines: str, source: str) -> str:
    return f"select {part} as part, (unnest(range(len(l)))) as n, unnest(l) as line from (select [{lines}] as l from {source})"


def _sampled(part: int, head: str, where: str, lines: str, most: int = 8) -> str:
    first = f"(select * from c where {where} order by pos limit {most})"
    return f"select {part} as part, (unnest(range(2))) as n, unnest(['', '{head}']) as line where exists (from c where {where}) union all select {part + 1}, pos * 3 + unnest(range(3)), unnest([{lines}]) from {first}"


@query("evaluation_report", f"""with {_COMPARED}, m as (select count(*) as total, {_MANY}, round(avg(top_score::double) filter (status <> 'ERR'), 4) as avg_top_score from c), k as (select {", ".join(f"count(*) filter (compare = '{x}') as {x.lower()}" for x in reports.COMPARED)} from c)
    {" union all ".join([_list(0, "'# Run', '', '## 总体结果'", '(select 1)'), _list(1, _TOTALS, 'm'), _list(2, "'', '## 新旧对比'", '(select 1)'), _list(3, ", ".join(f"'- {x}: ' || {x.lower()}" for x in reports.COMPARED), 'k'),
      _sampled(4, '## MISS 样本', "status = 'MISS'", f"'- 问题：' || question, '  - top_title: ' || coalesce(top_title, ''), '  - answer_snippet: ' || {_one_line('answer', 380)}"),
      _sampled(6, '## 回退样本', "compare = 'REGRESSED'", "'- 问题：' || question, '  - old_status: ' || old_status || ' -> new_status: ' || status, '  - notes: ' || compare_notes")])}""")
def evaluation_report(spark, sf):
    """The summary of the compared run."""
    return reports.report(_compared(spark, sf), "Run", True)


_LAW_TITLES = ["", "关于印发办法的通知（财库〔2022〕3号）", "2022年第5号公告", "某条例"]
_SUFFIXES = [".pdf", ".PDF", ".md", "（苏财购〔2021〕7号）.pdf"]
_NUMBERED = "coalesce(nullif(regexp_extract({x}, '([\\x{{4e00}}-\\x{{9fa5}}]{{1,8}}[〔\\[]\\d{{4}}[〕\\]]\\d+号)', 1), ''), nullif(regexp_extract({x}, '(\\d{{4}}年第?\\d+号)', 1), ''))"


@query("pdf_documents", f"""with c as (select doc_id as ord, '/c/' || coalesce(source, '') || '/' || doc_id % 11 || {pick_sql(_SUFFIXES, 'doc_id')} as source_path, {pick_sql(_LAW_TITLES, 'doc_id // 3')} as law_title, case when doc_id % 2 = 0 then split_part(coalesce(text, ''), chr(10), 1) else '' end as title, {strip_sql('text')} as content from documents),
    g as (select source_path, count(*) as chunks, md5(arg_max(content, length(content) * 100000000 - ord)) as best_content, arg_min(coalesce(nullif(law_title, ''), nullif(title, ''), regexp_extract(source_path, '([^/]*?)\\.[^./]*$', 1)), ord) as title from c where lower(source_path) like '%.pdf' group by source_path having max(length(content)) >= 80)
    select *, coalesce({_NUMBERED.format(x='title')}, {_NUMBERED.format(x='source_path')}, '') as doc_no from g""")
def pdf_documents(spark, sf):
    """The pdf files among paths of several kinds, with titles and numbers."""
    text = F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("/c/"), F.coalesce("source", F.lit("")), F.lit("/"), (F.col("doc_id") % 11).cast("string"), pick(_SUFFIXES, F.col("doc_id")))
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), path.alias("source_path"), pick(_LAW_TITLES, F.floor(F.col("doc_id") / 3)).alias("law_title"), F.when(F.col("doc_id") % 2 == 0, F.substring_index(text, "\n", 1)).otherwise("").alias("title"), text.alias("content"), F.lit("").alias("article_no"),
    )
    return V.pdf_candidates(rows).select("source_path", "chunks", F.md5("best_content").alias("best_content"), "title", "doc_no")
