"""Rules whose results are worked out by hand."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veinwork.domain import REGULATIONS as P
from veinwork.functions import meta as M, text as T
from veinwork.operators import answer as A, chunk as C, retrieve as R, score as S, selection as E, terms as Q, workspace as W
from veinwork.sources import files, stores
from veinwork.streaming import ingest


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lit(*values):
    return [F.lit(v) for v in values]


def test_texts(spark):
    assert one(spark, T.fold(F.lit("财库〔2022〕3号 ABC")), T.squeeze(F.lit(" A b\n")), T.shorten(F.lit("abcdef"), 3), T.excerpt(F.lit("a  b\nc"), 3)) == ("财库 2022 3号 abc", "ab", "abc...", "a b ...")
    assert one(spark, T.garbled(F.lit("word " * 40)), T.garbled(F.lit("")), T.garbled(F.lit(""), True), T.garbled(F.lit("法律" * 80))) == (True, False, True, False)
    assert one(spark, *(T.mostly_digits(F.lit(t)) for t in ("2022", "3号", "12号"))) == (True, False, True)
    assert one(spark, T.fold(F.lit(None).cast("string")), T.window(F.lit(" "), F.array(F.lit("a")))) == ("", "[正文缺失]")


def test_metadata(spark):
    assert one(spark, M.doc_number(F.lit("财库 [2022] 3 号")), M.asked_doc_number(F.lit("国 办 发 〔 2 0 2 5 〕 3 4 号")), M.date(F.lit("2024年3月5日")), M.date(F.lit("2024/3/5")), M.date(F.lit("2024-03-05"))) == ("财库〔2022〕3号", "国办发202534号", "2024-03-05", "2024-03-05", "2024-03-00")
    assert one(spark, *(M.category(F.lit(t)) for t in ("中华人民共和国政府采购法", "某实施条例", "某办法", "某通知", "X"))) == ("LAW", "ADMIN_REGULATION", "MINISTERIAL_RULE", "NORMATIVE_DOC", "OTHER")
    import hashlib
    import uuid

    assert one(spark, M.path_id(F.lit("/a/b.md")))[0] == str(uuid.UUID(bytes=hashlib.md5(b"/a/b.md").digest(), version=3))
    assert one(spark, M.number_spellings(F.lit("财库20223号")))[0] == "财库20223号 财库〔2022〕3号 财库 2022 3号 文号 发文字号"
    assert one(spark, M.display_title(*lit("某法", "第一条", "", "财库〔2022〕3号")))[0] == "某法 第一条（财库〔2022〕3号）"


def test_terms(spark):
    assert one(spark, Q.gram_terms(F.lit("政府采购法"), 2, 4, 72))[0] == ["政府采购", "府采购法", "政府采", "府采购", "采购法", "政府", "府采", "采购", "购法"]
    assert one(spark, Q.gram_terms(F.lit("办法"), 2, 4, 72))[0] == []
    assert one(spark, Q.merged_intent(Q.intent(F.lit("政府采购法是什么")), F.lit('x {"intent_type": "process", "keywords": ["流程"], "target_article": "见第三条"} y')))[0]["intent_type"] == "PROCESS"
    assert one(spark, Q.merged_intent(Q.intent(F.lit("政府采购法是什么")), F.lit("no reply")))[0]["intent_type"] == "DEFINITION"


def test_chunks(spark):
    text = "[文号] x\n序言\n第一条 甲。依照第二条办理。\n第二条 乙"
    assert one(spark, C.chunks(F.lit(text)))[0] == ["第一条 甲。依照", "第二条办理。", "第二条 乙"]
    long = "字" * 790 + "。" + "字" * 900
    parts = one(spark, C.windows(F.lit(long)))[0]
    assert len(parts[0]) == 791 and long.endswith(parts[-1]) and all(len(p) <= 831 for p in parts)
    assert one(spark, C.chunks(F.lit(None).cast("string")))[0] == []


def test_scores(spark):
    vec = lambda *x: F.array(*lit(*x))
    got = one(spark, S.idf(F.lit(4), F.lit(1)), S.coverage(F.array(*lit("a", "b")), F.array(*lit(2.0, 1.0)), lambda t: t == "a"), S.length_penalty(F.lit(1520)), S.length_penalty(F.lit(9000)), S.cosine01(vec(1.0, 0.0), vec(0.0, 1.0)), S.cosine01(vec(1.0, 2.0), vec(1.0, 2.0, 3.0)), S.cosine01(vec(1.0, 0.0), vec(1.0, 0.0, 3.0), True))
    assert got == pytest.approx((math.log(5 / 1.5) + 1, 2 / 3, 0.1, 0.18, 0.5, 0.0, 1.0))
    assert one(spark, S.exact_match(F.lit("abcdefgh"), F.lit("xxcdefgyy")), S.phrase_hit(F.lit("abcde"), F.lit("zabcdz")), S.exact_match(F.lit("abcde"), F.lit("abcd"))) == pytest.approx((5 / 8, 4 / 5, 0.0))
    assert R._second("abcde", "zabcdz") == pytest.approx(one(spark, S.rerank(F.lit(0.0), F.lit("abcde"), F.lit("zabcdz")))[0])


def test_tuning(spark):
    row = {k: F.lit("") for k in ("path", "region", "law", "article", "doc_no", "snippet", "body", "doc_type", "attachment_type")} | {k: F.lit(False) for k in ("summary", "scanned", "garbled")}
    row |= {"law": F.lit("中华人民共和国政府采购法"), "article": F.lit("第二条"), "body": F.lit("采购" * 100), "region": F.lit("NATIONAL")}
    question = F.lit("政府采购法第二条规定什么")
    rules = S.tune_rules(question, Q.intent(question), F.array(F.lit("采购")), F.lit(""), row)
    got = spark.range(1).select(*(c.alias(k) for k, c in rules.items())).first().asDict()
    want = dict.fromkeys(rules, 0.0) | {"coverage": 0.14, "target_law": 0.22, "target_article": 0.32, "law_form": 0.05, "region": 0.11}
    assert got == pytest.approx(want)
    assert one(spark, S.tuned(F.lit(0.5), rules))[0] == 1.0


def test_selection(spark):
    rows = spark.createDataFrame([(1, i, 1.0 - i / 100, 0.0, law, "", "f", i == 4) for i, law in enumerate("AAABBCAD", 1)], "qid int, ord int, score double, base double, law_title string, article_no string, source_path string, seed boolean")
    got = E.per_law(E.ranked(rows), F.col("seed"), 6).orderBy("place")
    assert [r["ord"] for r in got.collect()] == [4, 1, 2, 5, 6, 8]


def test_links_and_answers(spark):
    rows = spark.createDataFrame([(1, 1, "甲办法", "", "", "http://a", "见乙条例和甲办法"), (1, 2, "乙条例", "", "", "http://b", "见乙条例和甲办法"), (2, 1, "丙", "", "", "http://c", "无")], "qid int, rank int, title string, doc_no string, article_no string, url string, answer string")
    assert [(r["qid"], r["url"]) for r in A.links(rows).orderBy("qid", "place").collect()] == [(1, "http://b"), (1, "http://a"), (2, "http://c")]
    assert A.answer_with(spark.createDataFrame([(1, "q")], "qid int, prompt string"), lambda ps: [p + "!" for p in ps]).first()["answer"] == "q!"
    got = A.embed_with(spark.createDataFrame([(1, "a"), (2, "bb")], "id int, text string").coalesce(1), lambda ts: [[float(len(t))] for t in ts][:1], batch=2).orderBy("id").collect()
    assert [r["vector"] for r in got] == [[1.0], None]


def test_codes(spark):
    codes = spark.createDataFrame([("A", True, None, None), ("B", False, None, None)], "code string, active boolean, used_by string, used_at long")
    got = {r["code"]: r for r in W.use_code(codes, "A", "u", 5).collect()}
    assert got["A"]["used_by"] == "u" and not got["A"]["active"] and got["B"]["used_by"] is None
    assert one(spark, W.split_codes(F.lit("a, b；c a")))[0] == ["a", "b", "c"]


def test_files_end_to_end(spark, tmp_path):
    d = tmp_path / "国家法规" / "a"
    d.mkdir(parents=True)
    (d / "正文办法.md").write_text("# 某采购管理办法\n第一条 " + "采购活动应当公开透明。" * 5 + "\n第二条 " + "评审应当公正。" * 9, encoding="utf-8")
    (d / "meta.json").write_text('{"文号": "财库〔2022〕3号"}', encoding="utf-8")
    walked = files.read_texts(files.walk(spark, str(tmp_path))).select("path", "text", "size")
    metas = walked.where("path like '%meta.json'").select(M.parent(F.col("path")).alias("folder"), F.col("text").alias("json"))
    docs = files.documents(files.primaries(walked), metas)
    chunks = C.chunk_documents(docs).orderBy("pos").collect()
    assert [c["article_no"] for c in chunks] == ["第一条", "第二条"] and chunks[0]["title"] == "某采购管理办法（财库〔2022〕3号）" and chunks[0]["region_level"] == "NATIONAL"
    store = str(tmp_path / "store")
    assert not stores.usable(spark, store)
    stores.write_chunks(C.chunk_documents(docs), store)
    assert stores.usable(spark, store)
    features = R.features(C.chunk_documents(docs).withColumn("ord", F.col("pos").cast("bigint")))
    top = R.retrieve(features, spark.createDataFrame([(1, "评审公正")], "qid bigint, question string"), 1).first()
    assert top["ord"] == 1


def test_office_files():
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>甲</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    assert files.office_text(raw.getvalue()) == "# 表格: sheet1\n甲 | 5" and files.office_text(b"x") == ""


def test_stores(spark, tmp_path):
    p = Path(tmp_path) / "c.json"
    p.write_text('[{"chunkId": "a#0", "content": "x"}, {"chunkId": "a#1"}]')
    assert [(r["ord"], r["chunkId"]) for r in stores.read_chunk_store(spark, str(p)).collect()] == [(0, "a#0"), (1, "a#1")]
    (Path(tmp_path) / "e.json").write_text('{"data": [{"id": 1, "question": "q1"}, {"id": "b", "question": "q2"}]}')
    assert [r["question"] for r in stores.read_eval_set(spark, f"{tmp_path}/e.json", 1).collect()] == ["q1"]
    (Path(tmp_path) / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert stores.read_jsonl(spark, f"{tmp_path}/r.jsonl", "a int").count() == 2
    stores.write_report(spark.createDataFrame([(1, ["x"])], "a int, b array<string>"), f"{tmp_path}/rep")
    assert spark.read.json(f"{tmp_path}/rep/rows.jsonl").count() == 1
    assert [r[0] for r in stores.markdown_table(spark.createDataFrame([(1, "x")], "a int, b string"), ["a"]).collect()] == ["| a | b |", "|---|---|", "| 1 | x |"]


def test_chunk_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("第一条 " + "甲" * 40 + "\n第二条 " + "乙" * 40, encoding="utf-8")
    q = ingest.write_chunks(ingest.chunk_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_profile_is_plain():
    assert P.chunk_size == 800 and len(P.stopwords) == 31
