"""Reports of an evaluation as text: a page for each question, a printable page of all, a summary. Texts are columns; files are written by the tasks that hold the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veinwork.functions.text import filled
from veinwork.operators.evaluate import by_category, one_line, regression_metrics

METRICS = ("total", "ok", "miss", "err", "fallback", "empty_evidence", "anchor_hit", "avg_top_score")
COMPARED = ("IMPROVED", "REGRESSED", "SAME", "CHANGED")


def figure(c: Column) -> Column:
    """A number of up to four places without trailing zeros: 0.25, 1.0. Null is 0."""
    text = F.rtrim(F.coalesce(c, F.lit(0.0)).cast("decimal(30,4)").cast("string"), F.lit("0"))
    return F.when(F.endswith(text, F.lit(".")), F.concat(text, F.lit("0"))).otherwise(text)


def _text(name: str) -> Column:
    return filled(F.col(name))


def _category() -> Column:
    return F.when(_text("category") == "", "未分类").otherwise(_text("category"))


def _number() -> Column:
    n = F.col("pos").cast("string")
    return F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0"))


def _lines(*parts: Column | str | tuple) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p)) if isinstance(p, tuple) else p for p in parts))


def page(compared: bool = False) -> Column:
    """The page of a row (pos, question, category, status, evidence_count, top_score, anchor, top_title, answer), with ``compared`` also of the old run's (old_status, old_top_title, old_answer, compare, compare_notes). Nulls are empty."""
    old = ["## 旧版结果", ("- old_status: ", _text("old_status")), ("- old_top_title: ", _text("old_top_title")), ("- old_answer_snippet: ", one_line(F.col("old_answer"), 480)), ""] if compared else []
    verdict = ["## 对比结论", ("- compare: ", _text("compare")), ("- notes: ", _text("compare_notes")), ""] if compared else []
    new = [("- status: ", _text("status")), ("- evidence_count: ", F.coalesce(F.col("evidence_count"), F.lit(0)).cast("string")), ("- top_score: ", figure(F.col("top_score"))), ("- anchor: ", _text("anchor")), ""]
    return _lines(("# 第 ", _number(), " 题（", _category(), "）"), "", "## 问题", _text("question"), "", *old, "## 新版结果", *new, "## Top1 证据标题", _text("top_title"), "", *verdict, "## 回答", _text("answer"))


def escaped(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def card(compared: bool = False) -> Column:
    """A row's part of the printable page."""
    said = lambda name: escaped(_text(name))
    row = lambda *parts: F.concat(F.lit("<div>"), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("</div>"))
    old = [row("<b>旧版状态:</b> ", said("old_status")), row("<b>旧版Top1:</b> ", said("old_top_title")), row("<b>对比:</b> ", said("compare"), " / ", said("compare_notes"))] if compared else []
    return F.concat(
        F.lit("<article class='card'><h2>"), _number(), F.lit(". "), escaped(_category()), F.lit("</h2>"), row("<b>问题:</b> ", said("question")),
        row("<b>状态:</b> ", said("status"), " | <b>evidence:</b> ", F.coalesce(F.col("evidence_count"), F.lit(0)).cast("string"), " | <b>top_score:</b> ", figure(F.col("top_score"))),
        row("<b>Top1:</b> ", said("top_title")), *old, F.lit("<pre>"), said("answer"), F.lit("</pre></article>"),
    )


def _samples(rows: DataFrame, status: Column, *lines: Column, most: int = 8) -> DataFrame:
    """(n, line): the lines of the first rows of a state, in order."""
    first = rows.where(status).orderBy("pos").limit(most)
    return first.select("pos", F.posexplode(F.array(*lines)).alias("k", "line")).select((F.col("pos") * len(lines) + F.col("k")).alias("n"), "line")


def report(rows: DataFrame, title: str, compared: bool = False) -> DataFrame:
    """(part, n, line): the summary's lines in order: totals, with ``compared`` the comparison, then samples of misses and of what became worse."""
    spark = rows.sparkSession

    def fixed(part: int, *lines: str) -> DataFrame:
        return spark.range(1).select(F.lit(part).alias("part"), F.posexplode(F.array(*map(F.lit, lines))).alias("n", "line")).select("part", F.col("n").cast("bigint").alias("n"), "line")

    def counted(part: int, got: DataFrame, names: tuple[str, ...]) -> DataFrame:
        show = lambda name: figure(F.col(name)) if dict(got.dtypes)[name] == "double" else F.col(name).cast("string")
        return got.select(F.lit(part).alias("part"), F.posexplode(F.array(*(F.concat(F.lit(f"- {name.upper()}: "), show(name)) for name in names))).alias("n", "line")).select("part", F.col("n").cast("bigint").alias("n"), "line")

    def sampled(part: int, head: str, got: DataFrame) -> DataFrame:
        """Without rows there is no head either."""
        heading = got.limit(1).select(F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("line")), F.struct(F.lit(1).alias("n"), F.lit(head).alias("line")))).alias("x"))
        return heading.select(F.lit(part).alias("part"), F.col("x.n").cast("bigint").alias("n"), "x.line").union(got.select(F.lit(part + 1), F.col("n").cast("bigint"), "line"))

    of = lambda label, c: F.concat(F.lit(label), c)
    asked = of("- 问题：", _text("question"))
    out = fixed(0, f"# {title}", "", "## 总体结果").union(counted(1, regression_metrics(rows), METRICS))
    if compared:
        out = out.union(fixed(2, "", "## 新旧对比")).union(counted(3, rows.agg(*(F.count_if(F.col("compare") == name).alias(name) for name in COMPARED)), COMPARED))
    out = out.union(sampled(4, "## MISS 样本", _samples(rows, F.col("status") == "MISS", asked, of("  - top_title: ", _text("top_title")), of("  - answer_snippet: ", one_line(F.col("answer"), 380)))))
    if compared:
        worse = F.concat(F.lit("  - old_status: "), _text("old_status"), F.lit(" -> new_status: "), _text("status"))
        out = out.union(sampled(6, "## 回退样本", _samples(rows, F.col("compare") == "REGRESSED", asked, worse, of("  - notes: ", _text("compare_notes")))))
    return out


def write_bundle(rows: DataFrame, folder: str, title: str, compared: bool = False) -> None:
    """All reports of a run below a folder: result.jsonl, metrics and categories as CSV, report.md, a folder page=001 and so on for each question, and print.html in order of ``pos``."""
    rows.write.mode("overwrite").json(f"{folder}/result.jsonl")
    metrics = regression_metrics(rows)
    metrics.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in METRICS))).alias("m")).select("m.*").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/metrics.csv")
    by_category(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/categories.csv")
    report(rows, title, compared).coalesce(1).sortWithinPartitions("part", "n").select("line").write.mode("overwrite").text(f"{folder}/report.md")  # some dozens of lines
    rows.select(_number().alias("page"), page(compared).alias("text")).write.mode("overwrite").partitionBy("page").text(f"{folder}/pages")
    cards = rows.select("pos", card(compared).alias("line")).orderBy("pos").select("line")  # parts in order
    cards.write.mode("overwrite").text(f"{folder}/print.html")
