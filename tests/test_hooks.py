"""Model hooks that fail, hang or answer too little."""

from pyspark.sql import functions as F

from veinwork.operators import answer as A


def test_a_failing_batch_leaves_the_others(spark):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "qid int, prompt string").coalesce(1)

    def chat(prompts):
        if "p5" in prompts:
            raise RuntimeError("down")
        return [p.upper() for p in prompts]

    got = {r["qid"]: r["answer"] for r in A.answer_with(rows, chat, batch=4, wait=0.0).collect()}
    assert all(got[i] == (A.UNAVAILABLE if 4 <= i < 8 else f"P{i}") for i in range(12))
    states = spark.createDataFrame(list(got.items()), "qid int, answer string").where(~A.cacheable(F.col("answer"))).count()
    assert states == 4  # failures are not kept


def test_tries_and_time_limit():
    calls = []

    def third(part):
        calls.append(part)
        if len(calls) < 3:
            raise OSError
        return part

    assert A.asked(third, [1, 2], 3, 0.0, 5.0) == [1, 2] and len(calls) == 3
    calls.clear()
    assert A.asked(third, [1], 2, 0.0, 5.0) is None and len(calls) == 2

    def hang(part):
        import time

        time.sleep(30)

    assert A.asked(hang, [1], 2, 0.0, 0.1) is None


def test_vectors(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(6)], "id int, text string").coalesce(1)

    def embed(texts):
        if "xxx" in texts:
            raise ValueError
        return [[float(len(t))] if t else None for t in texts][: 1 if "xxxxx" in texts else None]

    got = {r["id"]: r["vector"] for r in A.embed_with(rows, embed, batch=2, tries=1).collect()}
    assert got == {0: None, 1: [1.0], 2: None, 3: None, 4: [4.0], 5: None}
