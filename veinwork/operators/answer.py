"""Prompts and answers out of selected evidence, and the hooks for models."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from veinwork.functions.meta import title_parts
from veinwork.functions.text import blank, filled, first_filled, has_any, shorten, squeeze, strip
from veinwork.ship import ship

MISS = "未找到足够依据"
UNAVAILABLE = "当前大模型不可用"


def _evidence_block(place: Column, title: Column, snippet: Column) -> Column:
    p = title_parts(title)
    text = F.when(blank(snippet), "[无可用正文摘录]").otherwise(strip(F.regexp_replace(filled(snippet), r"\n{3,}", "\n\n")))
    lines = [F.concat(F.lit("证据 "), place), F.concat(F.lit("- 法规标题："), p["law"])]
    for name, key in (("条号", "article"), ("款项", "clause"), ("文号", "doc_no")):
        lines.append(F.when(p[key] != "", F.concat(F.lit(f"- {name}："), p[key])))
    lines += [F.lit("- 证据片段："), text, F.lit("- 引用要求：以“法规标题 + 条号/款项”定位，不得输出文件路径。")]
    return F.concat_ws("\n", *lines)


def prompts(rows: DataFrame) -> DataFrame:
    """(qid, prompt, n) out of (qid, question, place, title, snippet): the numbered evidence under the question."""
    block = F.struct("place", _evidence_block(F.col("place").cast("string"), F.col("title"), F.col("snippet")).alias("text"))
    got = rows.groupBy("qid").agg(F.first("question").alias("question"), F.sort_array(F.collect_list(block)).alias("parts"))  # at most a selection's few rows
    return got.select("qid", F.concat(F.lit("用户问题：\n"), "question", F.lit("\n\n可用依据（按相关度排序）：\n"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")).alias("prompt"), F.size("parts").alias("n"))


def fallback_answers(rows: DataFrame, keep: int = 3) -> DataFrame:
    """(qid, answer): the digest of the first rows that stands in when no model answers."""
    line = F.concat(F.col("place").cast("string"), F.lit(". "), "title", F.lit("\n   摘要："), shorten(F.col("snippet"), 180))
    got = rows.where(F.col("place") <= keep).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    head = F.lit("当前大模型不可用，先基于检索证据给出参考结论。\n结论：已命中多条相关依据，请按以下优先顺序核对。\n依据列表：\n")
    return got.select("qid", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("answer"))


def missed(answer: Column) -> Column:
    return blank(answer) | F.contains(filled(answer), F.lit(MISS))


def unavailable(answer: Column, errors: tuple[str, ...] = ("模型不可用", "network", "timeout")) -> Column:
    return answer.isNull() | has_any(squeeze(answer), errors)


def cacheable(answer: Column) -> Column:
    return ~blank(answer) & ~F.startswith(filled(answer), F.lit(UNAVAILABLE)) & ~unavailable(answer)


def mention_place(answer: Column, title: Column, doc_no: Column, article: Column) -> Column:
    """Where an answer mentions a chunk (from 0), by number, title or article; -1 if nowhere."""
    a, t = squeeze(answer), squeeze(title)
    find = lambda x: F.when((x != "") & (F.instr(a, x) > 0), F.instr(a, x) - 1)
    return F.coalesce(find(squeeze(doc_no)), find(t), find(F.when(F.length(t) > 12, F.substring(t, 1, 12)).otherwise(t)), find(squeeze(article)), F.lit(-1))


def links(rows: DataFrame, most: int = 4, label: Column | None = None) -> DataFrame:
    """(qid, label, url, place): links to the sources that an answer mentions, by place of mention, one for a label; else the first that has one."""
    at = mention_place(F.col("answer"), F.col("title"), F.col("doc_no"), F.col("article_no"))
    got = rows.where(F.col("url") != "").withColumn("at", at).withColumn("label", first_filled(F.col("doc_no"), F.col("title")) if label is None else label)
    any_ = F.max(F.col("at") >= 0).over(Window.partitionBy("qid"))
    order = [F.when(F.col("at") < 0, F.lit(2147483647)).otherwise(F.col("at")), F.col("rank")]
    got = got.withColumn("_any", any_).withColumn("_n", F.row_number().over(Window.partitionBy("qid", "label").orderBy(*order))).where("_n = 1")
    got = got.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return got.where((F.col("_any") & (F.col("at") >= 0) & (F.col("place") <= most)) | (~F.col("_any") & (F.col("place") == 1))).select("qid", "label", "url", "place")


def asked(call: Callable[[list], list], part: list, tries: int, wait: float, limit: float | None) -> list | None:
    """A model's results for one batch; None if it fails ``tries`` times, each after a longer wait, or takes more than ``limit`` seconds. A call that hangs is left behind on a thread of its own."""
    for k in range(tries):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        got: list = []

        def once(got: list = got) -> None:
            try:
                got.append(list(call(part)))
            except Exception:
                return  # counted as a failed try

        thread = threading.Thread(target=once, daemon=True)
        thread.start()
        thread.join(limit)
        if got:
            return got[0]
    return None


def _in_batches(rows: DataFrame, source: str, name: str, kind: T.DataType, arrow: pa.DataType, call: Callable[[list], list], failed, batch: int, tries: int, wait: float, limit: float | None) -> DataFrame:
    """``rows`` with a column ``name`` of what ``call`` gives for ``source``, a batch at a time; a batch that fails, and what it leaves out, has ``failed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given, out = b.column(source).to_pylist(), []
            for i in range(0, len(given), batch):
                part = given[i : i + batch]
                got = asked(call, part, tries, wait, limit) or []
                out += [*got, *[failed] * len(part)][: len(part)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([failed if x is None else x for x in out], arrow)], names=[*b.schema.names, name])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


def answer_with(prompts_: DataFrame, chat: Callable[[list[str]], list[str]], batch: int = 32, tries: int = 3, wait: float = 0.5, limit: float | None = 120.0) -> DataFrame:
    """The (qid, prompt) rows with ``answer`` by a model: ``chat`` gets a batch's prompts. It runs on the executors. Batches that fail have the text of an unavailable model, those of others stay."""
    return _in_batches(prompts_, "prompt", "answer", T.StringType(), pa.string(), chat, UNAVAILABLE, batch, tries, wait, limit)


def embed_with(texts: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], batch: int = 32, tries: int = 3, wait: float = 0.5, limit: float | None = 120.0) -> DataFrame:
    """The (id, text) rows with ``vector`` by a model, in batches; what fails has none."""
    return _in_batches(texts, "text", "vector", T.ArrayType(T.FloatType()), pa.list_(pa.float32()), embed, None, batch, tries, wait, limit)


def export_lines(text: Column, width: int = 95) -> Column:
    """Lines of at most ``width`` characters, hard wrapped."""
    cut = lambda t: F.when(t == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.length(t), F.lit(width)), lambda i: F.substring(t, i, F.lit(width))))
    return F.flatten(F.transform(F.split(filled(text), "\n"), cut))
