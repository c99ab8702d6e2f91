"""The memo of answers: batch and stream against a plain version."""

import random
from datetime import datetime, timedelta

import pytest

from veinwork.streaming import memo

COLUMNS = "instance string, id bigint, ts timestamp, key string, cacheable boolean, reload boolean"
START = datetime(2024, 1, 1)


def log(n, keys, seed, minutes=3.0):
    rng, rows, at = random.Random(seed), [], 0.0
    for i in range(n):
        at += rng.expovariate(1 / minutes)
        key = rng.choice([None, "", *(f"q{int(rng.paretovariate(0.7)) % keys}" for _ in range(20))])
        rows.append((rng.choice(["a", "a", "b", None]), i, START + timedelta(minutes=round(at, 1)), key, rng.choice([True, True, True, False, None]), rng.random() < 0.004))
    return rows


def plain(rows, ttl, capacity):
    """A list for each instance, searched and reordered by hand."""
    out, memos = [], {}
    for instance, i, ts, key, cacheable, reload in sorted(rows, key=lambda r: (r[2], r[1])):
        kept = memos.setdefault(instance, [])
        made = None
        if reload:
            kept.clear()
        elif key:
            found = [x for x in kept if x[0] == key]
            if found and ts - found[0][1] <= timedelta(seconds=ttl):
                made = found[0][1]
                kept.append(kept.pop(kept.index(found[0])))
            else:
                if found:
                    kept.remove(found[0])
                if cacheable:
                    kept.append((key, ts))
                    del kept[: max(0, len(kept) - capacity)]
        out.append((i, instance, made is not None, made))
    return sorted(out)


@pytest.mark.parametrize(("ttl", "capacity"), [(1800, 500), (36000, 7), (60, 3)])
def test_replay(spark, ttl, capacity):
    rows = log(1500, 60, 1)
    got = memo.replay(spark.createDataFrame(rows[::-1], COLUMNS), ttl, capacity).collect()
    want = plain(rows, ttl, capacity)
    assert sorted((r["id"], r["instance"], r["hit"], r["made"]) for r in got) == want
    assert 20 < sum(w[2] for w in want) < 1400


def test_eviction_at_500(spark):
    """The 501st answer puts out the one used longest ago, which is not the oldest."""
    at = lambda i: START + timedelta(seconds=i)
    rows = [("a", i, at(i), f"q{i}", True, False) for i in range(500)] + [("a", 500, at(500), "q0", True, False), ("a", 501, at(501), "new", True, False), ("a", 502, at(502), "q0", True, False), ("a", 503, at(503), "q1", True, False)]
    hit = {r["id"]: r["hit"] for r in memo.replay(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert [hit[i] for i in (499, 500, 501, 502, 503)] == [False, True, False, True, False]


def test_stream_equals_replay(spark, tmp_path):
    rows = log(300, 30, 2)
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        memo.remembered(stream, 1800, 12).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["id"], r["instance"], r["hit"], r["made"]) for r in got) == plain(rows, 1800, 12)


def test_empty(spark):
    assert memo.replay(spark.createDataFrame([], COLUMNS)).count() == 0
