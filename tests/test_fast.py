"""The fast path on small corpora: what its queries can't show."""

import pytest
from pyspark.sql import functions as F

from veinwork.operators import fast
from veinwork.operators.score import cosine01

CHUNK = "ord bigint, title string, doc_no string, article_no string, content string, content_type string, source_url string"
ROWS = [
    (0, "采购办法", "财库〔2022〕3号", "第一条", "采购人应当公开招标。", "structured_text", "https://a.test/1"),
    (1, "采购办法", "", "第二条", "询价采购的适用情形。", "structured_text", "https://a.test/2)"),
    (2, None, None, None, None, None, None),
    (3, "合同规定", "", "", "合同应当备案，来源 http://b.test/x 网页", "structured_text", ""),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, CHUNK)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, question string")


def evidence(spark, chunks, scores, question="公开招标"):
    ranked = spark.createDataFrame([(0, o, s, i + 1) for i, (o, s) in enumerate(scores)], "qid bigint, ord bigint, score double, rank int")
    return fast.evidence(chunks.crossJoin(asked(spark, question)), ranked)


def test_vectors_move_pairs_that_have_both(spark, chunks):
    rows = fast.candidates(chunks, asked(spark, "公开招标", "询价采购"))
    plain = {(r.qid, r.ord): r.score for r in fast.second_stage(rows).collect()}
    q = spark.createDataFrame([(0, [1.0, 0.0, 5.0])], "qid bigint, vector array<double>")
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (3, [0.0, 0.0])], "ord bigint, vector array<double>")
    got = {(r.qid, r.ord): r.score for r in fast.second_stage(rows, q, c).collect()}
    assert got.keys() == plain.keys()
    assert got[0, 0] == pytest.approx(plain[0, 0] * 0.58 + 0.42, abs=2e-6)  # the dimensions in common agree
    assert got[0, 3] == pytest.approx(plain[0, 3] * 0.58, abs=2e-6)  # a zero vector is like nothing
    assert all(got[k] == plain[k] for k in plain if k[0] == 1 or k[1] in (1, 2))


def test_cosine_over_common_dimensions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0, 7.0])], "a array<double>, b array<double>").select(cosine01(F.col("a"), F.col("b"), truncate=True), cosine01(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (1.0, 0.0)


def test_one_row_is_enough_only_with_a_lead(spark, chunks):
    places = lambda *a, **k: sorted(r.place for r in evidence(spark, chunks, *a, **k).collect())
    assert places([(0, 0.7), (1, 0.5)]) == [1]
    assert places([(0, 0.7), (1, 0.6)]) == [1, 2]
    assert places([(0, 0.5), (1, 0.1)]) == [1, 2]
    assert places([(0, 0.1)]) == [1]
    assert places([(0, 0.7), (1, 0.5)], "公开招标有哪些") == [1, 2]
    assert places([(0, 0.7), (1, 0.5)], "甲与乙和丙") == [1, 2]


def test_evidence_of_blank_fields(spark, chunks):
    got = {r.ord: r for r in evidence(spark, chunks, [(0, 0.7), (1, 0.65), (2, 0.6), (3, 0.5)]).collect()}
    assert got[0].evidence_title == "采购办法 第一条（财库〔2022〕3号）" and got[1].evidence_title == "采购办法 第二条"
    assert (got[2].evidence_title, got[2].snippet, got[2].url) == ("", "", "")
    assert got[1].url == "https://a.test/2" and got[3].url == "http://b.test/x"


def test_answers_by_a_model_that_fails(spark, chunks):
    rows = evidence(spark, chunks, [(3, 0.7), (1, 0.65), (0, 0.6)])

    def broken(prompts):
        raise OSError("network")

    down = fast.answers(rows, broken).first().answer
    assert down == fast.answers(rows).first().answer and down.startswith("当前大模型不可用，以下为快速模式证据汇总：\n\n1. 合同规定\n   合同应当备案")
    blank = fast.answers(rows, lambda prompts: ["<think>hm</think> "] * len(prompts)).first().answer
    assert blank.startswith("根据快速模式命中证据，给出摘要：\n\n1. 合同规定")
    said = fast.answers(rows, lambda prompts: ["见 财库〔2022〕3号，再见合同规定。"] * len(prompts)).first().answer
    assert said == "见 财库〔2022〕3号，再见合同规定。\n\n原文链接（官网）：\n- [采购办法](https://a.test/1)\n- [合同规定](http://b.test/x)"
    none = fast.answers(rows, lambda prompts: ["不知道"] * len(prompts)).first().answer
    assert none == "不知道\n\n原文链接（官网）：\n- [合同规定](http://b.test/x)"




def test_whole_way_with_a_model_of_embeddings(spark, chunks):
    seen = fast.ask(chunks, asked(spark, "公开招标", ""), embed=lambda texts: [[float(len(t)), 1.0] for t in texts])
    got = {r.qid: r.answer for r in seen.collect()}
    assert list(got) == [0] and "采购办法 第一条" in got[0]


def test_inputs_of_embeddings(spark):
    c = F.col
    df = spark.createDataFrame([("T", "L", "A", "b" * 3000), (None, None, None, None)], "t string, l string, a string, b string")
    got = df.select(fast.embedding_text(c("t"), c("l"), c("a"), c("b")), fast.fast_embedding_text(c("t"), c("a"), c("b"))).collect()
    assert got[0][0] == ("T\nL\nA\n" + "b" * 3000)[:1800] and got[0][1] == "ta" + "b" * 1400 + "..."
    assert tuple(got[1]) == ("", "")


def test_an_empty_corpus_and_no_questions(spark, chunks):
    assert fast.ask(chunks.limit(0), asked(spark, "公开招标")).count() == 0
    assert fast.ask(chunks, asked(spark, "x").limit(0)).count() == 0
