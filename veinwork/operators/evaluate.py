"""Evaluation of answers: rates, percentiles, comparison of runs, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veinwork.functions.meta import evaluated_doc_number
from veinwork.functions.text import blank, filled, shorten, strip
from veinwork.operators.answer import MISS


def answer_status(answer: Column, ok: Column) -> Column:
    """OK, EMPTY or ERR."""
    return F.when(~ok, "ERR").when(blank(answer), "EMPTY").otherwise("OK")


def regression_status(answer: Column, ok: Column) -> Column:
    """OK, MISS or ERR."""
    return F.when(~ok, "ERR").when(F.contains(filled(answer), F.lit(MISS)), "MISS").otherwise("OK")


def anchored(anchor: Column, *texts: Column) -> Column:
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.contains(filled(t), strip(anchor))
    return ~blank(anchor) & hit


def summary(rows: DataFrame) -> DataFrame:
    """One row over (status, anchor, anchor_hit, latency_ms): counts, rates in per cent, exact percentiles of the latency."""
    many = lambda c: F.count_if(c)
    took = F.when(F.col("status").isin("OK", "EMPTY"), F.col("latency_ms"))
    share = lambda a, b: F.round(100.0 * a / F.nullif(b, F.lit(0)), 2)
    ok, total, asked, hit = many(F.col("status") == "OK"), F.count("*"), many(~blank(F.col("anchor"))), many(F.col("anchor_hit"))
    return rows.agg(
        total.alias("total"), ok.alias("ok"), many(F.col("status") == "EMPTY").alias("empty"), many(~F.col("status").isin("OK", "EMPTY")).alias("err"),
        F.coalesce(share(ok, total), F.lit(0.0)).alias("success_rate"), asked.alias("anchor_total"), hit.alias("anchor_hit"), share(hit, asked).alias("anchor_hit_rate"),
        F.percentile(took, F.lit(0.5)).cast("int").alias("p50"), F.percentile(took, F.lit(0.95)).cast("int").alias("p95"), F.round(F.avg(took), 2).alias("mean"),
    )


def regression_metrics(rows: DataFrame) -> DataFrame:
    """One row over (status, fallback, evidence_count, anchor, top_title, answer, top_score)."""
    scored = F.when(F.col("status") != "ERR", F.coalesce("top_score", F.lit(0.0)))
    one = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return rows.agg(
        F.count("*").alias("total"), one("OK"), one("MISS"), one("ERR"), F.count_if(F.col("fallback")).alias("fallback"), F.count_if(F.coalesce("evidence_count", F.lit(0)) == 0).alias("empty_evidence"),
        F.count_if(anchored(F.col("anchor"), F.col("top_title"), F.col("answer"))).alias("anchor_hit"), F.round(F.coalesce(F.avg(scored), F.lit(0.0)), 4).alias("avg_top_score"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    """(category, n, ok, miss, avg_top_score), the largest first, then by name."""
    scored = F.when(F.col("status") != "ERR", F.coalesce("top_score", F.lit(0.0)))
    named = rows.withColumn("category", F.when(filled(F.col("category")) == "", "未分类").otherwise(F.col("category")))
    got = named.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "MISS").alias("miss"), F.round(F.coalesce(F.avg(scored), F.lit(0.0)), 4).alias("avg_top_score"))
    return got.orderBy(F.desc("n"), "category")


def one_line(c: Column, most: int = 240) -> Column:
    return shorten(strip(F.translate(filled(c), "\n\r", " ")), most)


def compare_runs(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new rows (question, status, answer) with the old status and what became of it. ``old`` has ``pos``: the last of a question counts."""
    last = old.groupBy("question").agg(F.max_by(F.struct(F.col("status").alias("old_status"), F.col("answer").alias("old_answer")), "pos").alias("o")).select(F.col("question").alias("_q"), "o.*")
    got = new.join(last, F.col("question") == F.col("_q"), "left")
    was, now = F.col("old_status"), F.col("status")
    verdict = F.when(F.col("_q").isNull(), "NEW_ONLY").when((was == "MISS") & (now == "OK"), "IMPROVED").when((was == "OK") & (now == "MISS"), "REGRESSED").when(was == now, "SAME").otherwise("CHANGED")
    same = one_line(F.col("old_answer"), 120) == one_line(F.col("answer"), 120)
    note = (
        F.when(verdict == "NEW_ONLY", "旧集中无该问题").when(verdict == "IMPROVED", "由MISS提升为OK").when(verdict == "REGRESSED", "由OK回退为MISS")
        .when(verdict == "SAME", F.when(same, "状态与回答骨架基本一致").otherwise("状态相同但回答内容有变化")).otherwise(F.concat(F.lit("状态变化 "), F.coalesce(was, F.lit("")), F.lit(" -> "), F.coalesce(now, F.lit(""))))
    )
    return got.withColumn("compare", verdict).withColumn("compare_notes", note).drop("_q", "old_answer")


def stratified(rows: DataFrame, category: str, key: str, n: int) -> DataFrame:
    """``n`` rows, one of each category in turn, the largest category first; within a category by the hash of the key."""
    own = Window.partitionBy(category).orderBy(F.md5(F.col(key).cast("string")), key)
    size = rows.groupBy(F.col(category).alias("_c")).agg(F.count("*").alias("_size"))
    got = rows.withColumn("round", F.row_number().over(own)).where(F.col("round") <= n).join(size, F.col(category).eqNullSafe(F.col("_c")))
    place = Window.orderBy("round", F.desc("_size"), category)  # at most n rows a category
    return got.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n).drop("_c", "_size")


def candidates_by_path(chunks: DataFrame, least: int = 80) -> DataFrame:
    """(source_path, chunks, best_content, article_nos): per file the longest chunk, the first of equals, and its articles; the most chunks first."""
    got = chunks.groupBy("source_path").agg(
        F.count("*").alias("chunks"), F.max_by(strip(F.col("content")), F.struct(F.length(strip(F.col("content"))), -F.col("ord"))).alias("best_content"),
        F.sort_array(F.collect_set(F.when(~blank(F.col("article_no")), F.col("article_no")))).alias("article_nos"),
    )
    return got.where(F.length("best_content") >= least).orderBy(F.desc("chunks"), "source_path")


def pdf_candidates(chunks: DataFrame, least: int = 80) -> DataFrame:
    """The candidates among pdf files, with a title and a document's number: of the file's first chunk the law's title, its own, or the file's name; the number is the title's or else the path's."""
    named = chunks.where(F.endswith(F.lower("source_path"), F.lit(".pdf")))
    stem = F.regexp_extract("source_path", r"([^/]*?)\.[^./]*$", 1)
    title = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("law_title", "title")), stem)
    titles = named.groupBy(F.col("source_path").alias("_path")).agg(F.min_by(title, "ord").alias("title"))
    got = candidates_by_path(named, least).join(titles, F.col("source_path") == F.col("_path")).drop("_path")
    number = lambda c: F.nullif(evaluated_doc_number(F.col(c)), F.lit(""))
    return got.withColumn("doc_no", F.coalesce(number("title"), number("source_path"), F.lit("")))


def templated(rows: DataFrame, templates: list[str], key: str = "pos", title: str = "title") -> DataFrame:
    """(key, question): the templates in turn, by the key, with the title in place of {title}."""
    pick = F.element_at(F.array(*map(F.lit, templates)), (F.col(key) % len(templates)).cast("int") + 1)
    return rows.select(key, F.replace(pick, F.lit("{title}"), F.col(title)).alias("question"))


def random_questions(spark, dimensions: dict[str, list[str]], templates: list[str], n: int, seed: int = 7) -> DataFrame:
    """``n`` distinct questions: every template over every combination of the lists, ordered by a hash."""
    rows = spark.createDataFrame([(t,) for t in templates], "question string")
    for name, values in dimensions.items():
        rows = rows.withColumn("_v", F.explode(F.array(*map(F.lit, values)))).withColumn("question", F.replace("question", F.lit("{" + name + "}"), F.col("_v"))).drop("_v")
    return rows.distinct().orderBy(F.xxhash64("question", F.lit(seed)), "question").limit(n)


def drawn(values: list[str], key: Column, name: str, seed: int = 7) -> Column:
    """One of the values for each key, drawn by a hash of the seed, the name and the key: the same in every run and on every partition."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.lit(name), key.cast("string"))), 1, 7), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values)).cast("int") + 1)


def drawn_questions(rows: DataFrame, key: str, topic: str, dimensions: dict[str, list[str]], templates: list[str], seed: int = 7) -> DataFrame:
    """(key, question) for each row: a drawn template with a drawn value of each dimension in place of its name, and the row's own topic (null: empty) in place of {topic}. A narrow pass."""
    question = drawn(templates, F.col(key), "template", seed)
    for name, values in dimensions.items():
        question = F.replace(question, F.lit("{" + name + "}"), drawn(values, F.col(key), name, seed))
    return rows.select(key, F.replace(question, F.lit("{topic}"), filled(F.col(topic))).alias("question"))
