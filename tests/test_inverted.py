"""The inverted index gives the rows of the scan."""

import random

import pytest
from pyspark.sql import functions as F

from veinwork.operators import inverted as I, retrieve as R

WORDS = "采购 政府 预算 alpha beta gamma 合同 供应商 zeta 评审 优惠 kappa 价格 扣除 第三条 第七条 lambda mu 验收 履约".split()


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(6)
    rows = []
    for i in range(240):
        body = "".join(rng.choice(WORDS) + rng.choice(["", " ", "，", "\n"]) for _ in range(rng.choice([0, 4, 40, 150])))
        rows.append((i, rng.choice(["", "采购 办法", "Alpha beta rules"]), rng.choice([None, "政府采购法", "合同法"]), rng.choice(["", "第三条", "第七条"]), body))
    return spark.createDataFrame(rows, "ord bigint, title string, law_title string, article_no string, content string")


QUESTIONS = [(1, "政府采购合同 第三条 怎么 验收"), (2, "alphabeta gamma lambda kappa"), (3, "评审优惠价格扣除供应商履约第七条"), (4, "的"), (5, ""), (6, "unknownterm qqq"), (7, "beta"), (8, None), (9, "第三条")]


@pytest.mark.parametrize(("k", "first"), [(24, 2000), (3, 20), (300, 5)])
def test_same_as_scan(spark, chunks, k, first):
    features = R.features(chunks)
    asked = spark.createDataFrame(QUESTIONS, "qid bigint, question string")
    key = lambda r: (r["qid"], r["rank"])
    want = sorted((tuple(r) for r in R.retrieve(features, asked, k).select("qid", "rank", "ord", "score").collect()))
    got = sorted((tuple(r) for r in I.top_chunks(I.build(features, 3), asked, k, first=first).select("qid", "rank", "ord", "score").collect()))
    assert got == want and want


def test_index_holds_every_gram_with_its_fields(spark, chunks):
    features = R.features(chunks)
    index = I.build(features, 2)
    rows = {(r["gram"], r["ord"]): r["mask"] for r in index.postings.collect()}
    for r in features.limit(30).collect():
        fields = [(r["full"], 1), (r["body_compact"], 2), (r["title_compact"], 4), (r["law_compact"], 8), (r["article_compact"], 16)]
        for n in (2, 3, 4):
            for g in {r["full"][i : i + n] for i in range(len(r["full"]) - n + 1)}:
                assert rows[g, r["ord"]] == sum(bit for t, bit in fields if g in t)
    df = {r["gram"]: r["df"] for r in index.grams.collect()}
    assert sum(df.values()) == len(rows)


def test_joins_use_the_buckets(spark, chunks):
    index = I.build(R.features(chunks), 3)
    some = spark.range(500).select(F.concat(F.lit("采购"), F.col("id")).alias("gram")).repartition(7)
    plan = some.hint("merge").join(index.postings, "gram")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 1


def test_empty_tables(spark, chunks):
    asked = spark.createDataFrame(QUESTIONS, "qid bigint, question string")
    assert I.top_chunks(I.build(R.features(chunks.where("false")), 2), asked, 5).count() == 0
    assert I.top_chunks(I.build(R.features(chunks), 2), asked.where("false"), 5).count() == 0


def test_long_fragments(spark):
    from veinwork.operators.score import exact_match

    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randrange(0, 20))), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "q string, t string").select(I._fragment(F.col("q"), F.col("t")).alias("a"), exact_match(F.col("q"), F.col("t")).alias("b"))
    assert all(abs(r["a"] - r["b"]) < 1e-12 for r in got.collect())


def test_no_text_is_written_twice(spark, chunks):
    features = R.features(chunks)
    index = I.build(features, 2)
    written = spark.read.parquet(*index.features.inputFiles()).columns
    assert "body_folded" in written and not {"full", "body_compact"} & set(written)
    assert index.features.columns == features.columns and sorted(index.features.select("ord", "full").collect()) == sorted(features.select("ord", "full").collect())
