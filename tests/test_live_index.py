"""The index that changes keep up to date equals one built anew, whatever the order of batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from veinwork.operators import inverted as I, retrieve as R
from veinwork.plans.base import chunk_table
from veinwork.streaming.index import LiveIndex

DOCS = "doc_id bigint, version bigint, deleted boolean, source string, lang string, text string"
CUT = lambda d: chunk_table(d, "version")
WORDS = "采购 政府 预算 alpha beta gamma 合同 供应商 zeta 评审".split()


def changes(seed=3):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 40, 500])))
    rows = [(i, 1, False, "s", "en", text()) for i in range(12)]
    rows += [(i, 2, None, "s", "en", text()) for i in range(0, 12, 3)] + [(i, 3, True, None, None, None) for i in (3, 5, 99)] + [(5, 2, False, "s", "en", "older than its deletion"), (None, 1, False, "s", "en", "no id"), (7, None, False, "s", "en", "no version")]
    rows += [(1, 4, False, "s", "en", None), (2, 1, False, "s", "en", "zz twice at one version")]
    rng.shuffle(rows)
    return rows


def current(rows):
    best = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            best.setdefault(r[0], []).append(r)
    top = {d: max(rs, key=lambda r: (r[1], bool(r[2]))) for d, rs in best.items()}
    return [r for r in top.values() if not r[2]]


def state(index):
    return {r["gram"]: r["df"] for r in index.grams.collect()}, sorted(map(tuple, index.postings.select("gram", "ord", "mask").collect())), index.size


def test_any_order_equals_rebuild(spark, tmp_path):
    rows = [r for r in changes() if r[5] != "zz twice at one version"]
    parts = [rows[:9], rows[9:15], rows[15:]]
    schema = spark.createDataFrame([], DOCS).schema
    fresh = I.build(R.features(CUT(spark.createDataFrame(current(rows), DOCS))), 2)
    want = state(fresh)
    for n, order in enumerate([(0, 1, 2), (2, 0, 1)]):
        live = LiveIndex(spark, str(tmp_path / f"i{n}"), schema, CUT)
        assert live.index().size == 0
        for batch, k in enumerate(order):
            live.apply(spark.createDataFrame(parts[k], DOCS), batch)
        live.apply(spark.createDataFrame(parts[order[2]], DOCS), 2)  # run again
        assert state(live.index()) == want
    asked = spark.createDataFrame([(1, "政府采购合同"), (2, "alpha beta")], "qid bigint, question string")
    ranks = lambda ix: sorted(map(tuple, I.top_chunks(ix, asked, 4).collect()))
    assert ranks(live.index()) == ranks(fresh)
    small = live.compacted(str(tmp_path / "small"))
    assert state(small.index()) == want
    small.apply(spark.createDataFrame([(5, 2, False, "s", "en", "late")], DOCS), 1)  # deleted at version 3
    assert state(small.index()) == want


def test_stream_of_changes(spark, tmp_path):
    rows = [r for r in changes(8) if r[5] != "zz twice at one version"]
    for k in range(0, len(rows), 9):
        spark.createDataFrame(rows[k : k + 9], DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = LiveIndex(spark, str(tmp_path / "live"), spark.createDataFrame([], DOCS).schema, CUT)
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.follow(stream, str(tmp_path / "check")).awaitTermination()
    assert state(live.index()) == state(I.build(R.features(CUT(spark.createDataFrame(current(rows), DOCS))), 2))


def test_a_batch_joins_no_entries(spark, tmp_path, monkeypatch):
    plans = []
    write = LiveIndex._write
    monkeypatch.setattr(LiveIndex, "_write", lambda self, df, name, batch: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), write(self, df, name, batch)))
    rows = spark.createDataFrame([(1, 1, False, "s", "en", "one text of some words"), (2, 1, False, "s", "en", "another")], DOCS)
    LiveIndex(spark, str(tmp_path / "live"), rows.schema, CUT).apply(rows, 0)
    assert {n for n, _ in plans} == {"changes", "features", "postings", "deltas"}
    assert not any("Join" in p for n, p in plans if n in ("features", "postings"))
