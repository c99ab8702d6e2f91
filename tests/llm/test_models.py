"""Search, language-model scores and the pipeline against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SF, components, documents, shingles, words
from tests.llm.test_texts import base_spans, hot_runs
from veinwork.llm import lm, pieces, topk
from veinwork.llm.scratch import stage
from veinwork.llm.words import hash_words


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(0, 400)]
    rows += [(1000, None), (1001, [1.0, None]), (1050, [float("nan")]), (1100, []), (1150, [1.0]), (1151, [float("inf")]), (50, [9.0]), (None, [1.0]), (1200, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank string, score int")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for i in {i for i, _ in q if i % 50 == 0}:
        own = min((np.float32(v).tolist() for j, v in rows if j == i and v is not None), key=lambda v: v)
        own = [math.floor(256 * x) for x in own]
        ranked = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(own, v)))), j) for j, v in q if j != i)[:5]
        want[i] = [(k, j, -s) for k, (s, j) in enumerate(ranked, 1)]
    assert got == want
    exact = [(i, [2_000_000.0, 1.0]) for i in (50, 1)] + [(2, [1_500_000.0, 1.0]), (3, [1e7, -3.0]), (4, [0.5, 0.0])]
    big = spark.createDataFrame(exact, "vec_id bigint, embedding array<double>")
    rows = topk.top_k(big, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    own = [math.floor(256 * x) for x in exact[0][1]]
    assert [(r["vec_id"], r["score"]) for r in rows] == sorted(((i, sum(a * math.floor(256 * x) for a, x in zip(own, v))) for i, v in exact[1:]), key=lambda r: -r[1])
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize(("size", "width"), [(3, 4), (1 << 28, 1024), (1 << 31, 1024), (1 << 40, 3)])
def test_accumulated_scores_are_exact(size, width):
    rng = np.random.default_rng(1)
    q, r = (np.floor(rng.uniform(-size, size, (n, width))) for n in (5, 7))
    q[0], r[0] = size, size
    q[1, ::2], r[2] = 0, np.arange(width) % 3
    want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in r] for x in q]
    assert topk.accumulate(q, r).tolist() == want


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id bigint, text string"))
    docs = docs.withColumn("held_out", lm.held_out(parts=7, part=2))
    model, rest = lm.train(docs.where("not held_out"), head=100)
    return {r["doc_id"]: r["text"] for r in docs.collect()}, model, lm.score(docs, model, rest).collect()


def test_base_scores(scored):
    texts, _, rows = scored
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    tokens = {d: [*words(t), "\0end"] for d, t in texts.items()}
    c = Counter(w for d in texts if not out[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)


def test_model_scores(scored):
    texts, model, rows = scored
    tokens = {d: [*words(t), "\0end"] for d, t in texts.items()}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    uni = Counter(w for d in train for w in tokens[d])
    held = [r for r in rows if r["held_out"]]
    per_token = lambda k: sum(r[k] for r in held) / sum(r["n_tokens"] for r in held)
    assert per_token("score") > per_token("base_score") and all(r["score"] < 0 for r in rows)
    keys = [w for w in uni if w != "\0end"]
    found = model.filter.level(hash_words(pa.array(keys, pa.large_string())))
    true = lm.level_of(np.array([uni[w] for w in keys]))
    assert (found >= true).all()  # a Bloom filter misses nothing
    assert (found > true).mean() < 0.06


def quantised(c):
    steps = sorted({1 << k for k in range(40)} | {3 << k for k in range(40)})
    level = max(i for i, s in enumerate(steps) if s <= c) if c else None
    return (steps[level], steps[level + 1] - 1) if c else (0, 0)


def test_scores_by_brute_force(spark):
    """With so many bits that no false positive comes up, the score is what plain dictionaries give, and no word's successors add up to more than 1."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id bigint, text string"))
    docs = docs.withColumn("held_out", lm.held_out(parts=7, part=2))
    model, rest = lm.train(docs.where("not held_out"), bits=60)
    uni, bi = Counter(), Counter()
    lists = {}
    for r in docs.collect():
        t = lists[r["doc_id"]] = [*words(r["text"]), "\0end"]
        if not r["held_out"]:
            uni.update(t)
            bi.update(zip(["\0end", *t], t))
    n, v = sum(uni.values()), len(uni)

    def p(before, word):
        one = (quantised(uni[word])[0] + 1) / (n + v + 1)
        most = quantised(uni[before])[1]
        return 0.5 * min(max(0, quantised(bi[before, word])[0] - 0.5), most) / most + 0.5 * one if most else one

    for r in lm.score(docs, model, rest).collect():
        t = lists[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["\0end", *t], t)), rel=1e-9)
    for before in ["\0end", "no such word", *list(uni)[:40]]:
        assert 0 < sum(p(before, w) for w in uni) + p(before, "no such word") <= 1 + 1e-9


def test_empty_training(spark):
    docs = documents(spark, [(1, "a b")]).withColumn("held_out", F.lit(True))
    model, rest = lm.train(docs.where("not held_out"))
    r = lm.score(docs, model, rest).first()
    assert r["n_tokens"] == 3 and r["n_known"] == 0 and r["base_score"] == 0.0


def test_what_occurs_once_is_known(spark):
    train = [(1, "red fox"), (3, "blue owl")] + [(10 + i, f"w{i} x{i}") for i in range(3000)]
    docs = documents(spark, train + [(-1, "red fox"), (-2, "red owl"), (-3, "grey elk")]).withColumn("held_out", F.col("doc_id") < 0)
    model, rest = lm.train(docs.where("not held_out"))
    hashed = lambda ws: hash_words(pa.array(ws, pa.large_string()))
    assert (model.filter.level(hashed([w for _, t in train for w in t.split()])) >= 0).all()
    assert (model.filter.level(hashed([f"y{i}" for i in range(1000)])) < 0).mean() > 0.94
    pairs = lm.bigrams(lm.tokens(pa.array([t for _, t in train]))[0], model.filter.key_bits)
    assert (model.filter.level(pairs) >= 0).all()
    score = {r["doc_id"]: r["score"] for r in lm.score(docs, model, rest).collect()}
    assert score[-1] > score[-2] > score[-3] and score[-1] == pytest.approx(score[1])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    tables = {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        tables[name] = docs
    rows = {name: {r["doc_id"]: r for r in t.collect()} for name, t in tables.items()}
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(tables[n].columns == columns for n in list(tables)[:-1])
    # language: all of these documents are prose
    kept = {d: r["text"] for d, r in rows["language_id"].items()}
    assert len(kept) >= 0.97 * len(before) and all(before[d] == t for d, t in kept.items())
    want = components(sorted(kept.items()), 5, 80)
    kept = {d: t for d, t in kept.items() if want[d][1] == d}
    assert rows["near_dedup"].keys() == kept.keys()
    items = [shingles(r["text"], 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {d: t for d, t in kept.items() if not any(s and len(s & shingles(t, 5)) * 100 >= 80 * len(s) for s in items)}
    assert rows["decontamination"].keys() == kept.keys()

    def masked(t):
        base, at, out = base_spans(t), 0, []
        for s, _, e, _ in sorted(base + hot_runs(t, base)):
            if s >= at:
                out += [t[at:s], "[SECRET]"]
            at = max(at, e)
        return "".join(out) + t[at:]

    kept = {d: masked(t) for d, t in kept.items()}
    assert {d: r["text"] for d, r in rows["secret_scan"].items()} == kept and all(r["n_chars"] == len(r["text"]) for r in rows["secret_scan"].values())
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r["piece_ids"] == lib.encode(kept[d]) and r["round_trip"] for d, r in rows["encoding"].items()) and rows["encoding"].keys() == kept.keys()
    assert corpus_pipeline.run(spark, SF).count() == len(kept)


def test_pipeline_of_nothing(spark):
    docs = documents(spark, [])
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), "none")
    assert docs.count() == 0 and {"component", "n", "piece_ids"} <= set(docs.columns)


def test_pipeline_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two three four five six token=abcdefghijklmnop"), (3, "one two three four five six token=abcdefghijklmnop"), (4, "one two three four five six token=abcdefghijklmnop"), (None, "seven eight nine ten eleven")]
    docs = documents(spark, rows).withColumn("base", F.lit("b"))
    for name, step in corpus_pipeline.STAGES[1:]:
        docs = stage(step(spark, docs, SF), name)
    got = sorted((r["doc_id"] or 0, r["text"], r["base"], r["component"]) for r in docs.collect() if r["text"])
    assert got == [(0, "seven eight nine ten eleven", "b", "x")] + [(3, "one two three four five six [SECRET]", "b", "x")] and docs.count() == 4
