"""Windows and sections against plain versions, and their time on a long text."""

import random
import re
import time

from pyspark.sql import functions as F

from veinwork.operators.retrieve import features
from veinwork.plans.base import PLACES, chunk_table
from veinwork.domain import REGULATIONS
from veinwork.operators import chunk


def plain_windows(t, size=800, overlap=120):
    out, at, n = [], 0, len(t)
    while n:
        raw = min(at + size, n)
        end = raw
        if raw < n:
            low = max(at, raw - 60)
            back = [k for k in range(low, raw + 1) if k < n and t[k] in "\n。；;"]
            ahead = [k for k in range(raw, min(n - 1, raw + 30) + 1) if t[k] in "\n。；;"]
            end = back[-1] + 1 if back else ahead[0] + 1 if ahead else raw
        out.append(t[at:end])
        if end >= n:
            break
        at = max(0, end - overlap)
    return out


def plain_sections(t):
    out, strip = [], lambda x: re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", x)
    for line in filter(None, map(strip, re.split(r"\r\n|[\n\x0b\x0c\r\x85  ]", t))):
        if not out or re.match(r"^(#{1,6}\s+.+|第[一二三四五六七八九十百千万0-9]+[章节条款].*|[0-9]+[.、].+)$", line):
            out.append("")
        out[-1] += line + "\n"
    return out or [t]


def texts(n, longest, seed):
    rng = random.Random(seed)
    parts = ["ab", "采购", "。", "\n", "; ", "𠀀", "第三章 总则\n", "\n# head\n", "1、项", " ", "\r\n", "x" * 50, "文" * 70]
    return ["", "\n", "x" * 800, "x" * 801, "。" * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_windows_and_sections(spark):
    all_ = texts(60, 900, 1)
    got = spark.createDataFrame([(t,) for t in all_], "t string").select("t", chunk.windows(F.col("t")).alias("w"), chunk.windows(F.col("t"), 200, 30).alias("v"), chunk.sections(F.col("t")).alias("s")).collect()
    for r in got:
        assert r["w"] == plain_windows(r["t"]) and r["v"] == plain_windows(r["t"], 200, 30), r["t"][:200]
        assert r["s"] == plain_sections(r["t"])
    null = spark.createDataFrame([(None,)], "t string").select(chunk.windows(F.col("t")).alias("w"), chunk.chunks(F.col("t")).alias("c")).first()
    assert null["w"] == [] and null["c"] == []


def test_long_texts_take_time_in_proportion(spark):
    for unit in ("one line of text\n", "采购合同。政府"):
        long = unit * (4_000_000 // len(unit))
        for f in (chunk.windows, chunk.sections):
            began = time.time()
            got = spark.createDataFrame([(long,)], "t string").select(f(F.col("t")).alias("x")).select(F.size("x").alias("n"), F.aggregate("x", F.lit(0), lambda s, p: s + F.length(p)).alias("all")).first()
            assert time.time() - began < 30  # some 4 s on an idle machine; minutes before
            assert got["all"] >= len(long) - 1 and (f is chunk.sections or got["n"] > 5000)
    assert REGULATIONS.chunk_size == 800


def test_titles_are_whole_and_places_differ(spark):
    title = "word " * 199
    docs = spark.createDataFrame([(1, "s", "en", f"{title}alpha\nbody"), (2, "s", "en", f"{title}omega\nbody"), (3, "s", "en", "x" * 1_000_000)], "doc_id bigint, source string, lang string, text string")
    short = chunk_table(docs.where("doc_id < 3"))
    got = {r["title_compact"][-5:] for r in features(short).select("title_compact").collect()}
    assert got == {"alpha", "omega"}
    n = chunk_table(docs).where("doc_id = 3").selectExpr("count(distinct ord) as n", "count(*) as m", "max(ord) as last").first()
    assert n["n"] == n["m"] > 1_000 and n["last"] // PLACES == 3
    assert PLACES > 2**31 // 620  # chunks of the longest text there can be
