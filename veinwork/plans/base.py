"""Registration of queries with the SQL that gives the same rows, and the views of the test tables as corpus and questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veinwork.functions.text import dense, fold
from veinwork.operators.chunk import windows
from veinwork.operators.retrieve import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Places of chunks within a document: a text has at most 2^31 bytes and a window moves on by 620 characters at least, which makes fewer than 2^22 chunks.
PLACES = 1 << 22


def _number():
    return F.concat(F.lit("财库〔2022〕"), F.col("doc_id") % 97 + 1, F.lit("号"))


def corpus(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """``documents`` cut into chunks (the windows of ``operators.chunk``): the document's first line is the title, its source the law, and the chunk's number an article's.
    With ``found`` (ord) only the documents that have one of these chunks are cut."""
    docs = spread(table(spark, sf_dir, "documents"))
    return chunk_table(docs if found is None else _holding(docs, found, corpus.places))


def _holding(docs: DataFrame, found: DataFrame, places: int) -> DataFrame:
    return docs.join(found.select(document(F.col("ord"), places).alias("doc_id")).distinct(), "doc_id", "left_semi")


def document(ord_: Column, places: int) -> Column:
    """The document that a chunk is of; each has ``places`` places, a power of two."""
    return F.shiftright(ord_, places.bit_length() - 1)


def chunk_table(docs: DataFrame, *more: str) -> DataFrame:
    """The same of any table of documents, with ``more`` of its columns."""
    docs = docs.select("doc_id", "source", "lang", *more, F.coalesce("text", F.lit("")).alias("text")).withColumn("title", F.substring_index("text", "\n", 1))
    docs = docs.withColumn("title_compact", dense(fold(F.col("title"))))  # once a document, not once a chunk
    cut = docs.select("doc_id", "source", "lang", *more, "title", "title_compact", F.posexplode(windows(F.col("text"))).alias("pos", "content"))
    return cut.select(
        (F.col("doc_id") * PLACES + F.col("pos")).alias("ord"), "title", "title_compact", F.coalesce("source", F.lit("")).alias("law_title"), F.concat(F.lit("第"), F.col("pos") + 1, F.lit("条")).alias("article_no"),
        "content", F.coalesce("source", F.lit("")).alias("source_path"), F.coalesce("lang", F.lit("")).alias("region_level"), "doc_id", _number().alias("doc_no"), *more,
    )


def documents_whole(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """``documents`` as chunks of their own, whatever their length."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if found is None else _holding(docs, found, documents_whole.places)
    return docs.select(
        F.col("doc_id").alias("ord"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), F.coalesce("source", F.lit("")).alias("law_title"),
        F.lit("").alias("article_no"), F.coalesce("text", F.lit("")).alias("content"), F.coalesce("source", F.lit("")).alias("source_path"), F.coalesce("lang", F.lit("")).alias("region_level"), "doc_id", _number().alias("doc_no"),
    )


corpus.places, documents_whole.places = PLACES, 1


def doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc_no): the numbers that both corpora give the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", _number().alias("doc_no"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as questions, each of which names an article and a document's number besides."""
    asked = F.concat(F.col("text"), F.lit(" 第"), F.col("item_id") % 9 + 1, F.lit("条 财库〔2022〕"), F.col("item_id") % 97 + 1, F.lit("号"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), asked.alias("question"))


def pick(phrases: list[str], key: Column) -> Column:
    """One of the phrases by a row's number."""
    return F.element_at(F.array(*map(F.lit, phrases)), (key % len(phrases) + 1).cast("int"))


def phrased(spark: SparkSession, sf_dir: str, phrases: list[str], name: str = "documents", last: bool = False) -> DataFrame:
    """(id, t): every whole text of ``documents`` or ``benchmark`` with one of the phrases before it (behind it with ``last``), since the tables hold none of what these rules look for."""
    key = F.col(_KEYS[name])
    parts = [pick(phrases, key), F.lit("\n" if name == "documents" else " "), F.coalesce("text", F.lit(""))]
    return table(spark, sf_dir, name).select(key.alias("id"), F.concat(*(parts[::-1] if last else parts)).alias("t"))


_KEYS = {"documents": "doc_id", "benchmark": "item_id"}


def pick_sql(phrases: list[str], key: str) -> str:
    return "[" + ", ".join(map(quoted, phrases)) + f"][{key} % {len(phrases)} + 1]"


def phrased_sql(phrases: list[str], name: str = "documents", last: bool = False) -> str:
    """The same as a SQL relation."""
    parts = [pick_sql(phrases, _KEYS[name]), "chr(10)" if name == "documents" else "' '", "coalesce(text, '')"]
    return f"(select {_KEYS[name]} as id, {' || '.join(parts[::-1] if last else parts)} as t from {name}) f"


def quoted(t: str) -> str:
    """A SQL string; line feeds by chr(10)."""
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in t.split("\n")) + ")"


# Fragments of SQL.


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{Han}}\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def dense_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '\\s+', '', 'g')"


def squeeze_sql(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '\\s+', '', 'g')"


def strip_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return strip_sql(f"regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')")


def grams_sql(x: str, n: int | str) -> str:
    return f"list_transform(range(1, greatest(1, length({x}) - {n} + 2)), lambda i: substr({x}, i, {n}))"


def distinct_sql(x: str) -> str:
    """Distinct elements in the order of their first place."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def any_sql(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, '{w.lower()}')" for w in words) + ")"


def list_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def windows_sql(source: str) -> str:
    """The windows of a relation's texts (id, t): (id, pos, piece)."""
    return f"""(with recursive d as (select id, t, length(t) as n from {source}),
    w as (select id, 0 as i, 0 as s, 0 as e, false as over from d where n > 0
      union all select w.id, i + 1, s2, e2, e2 >= n from (select w.*, d.n, d.t, case when i = 0 then 0 else greatest(0, e - 120) end as s2 from w join d using (id) where not over) w,
      lateral (select least(s2 + 800, n) as raw), lateral (select greatest(s2, raw - 60) as low), lateral (select length(regexp_extract(substr(t, low + 1, raw - low + 1), '(?s)^(.*[\\n。；;])', 1)) as behind, length(regexp_extract(substr(t, raw + 1, least(n - 1, raw + 30) - raw + 1), '(?s)^([^\\n。；;]*[\\n。；;])', 1)) as ahead),
      lateral (select case when raw >= n then n when behind > 0 then low + behind when ahead > 0 then raw + ahead else raw end as e2))
    select id, (i - 1)::bigint as pos, substr(t, s + 1, e - s) as piece from w join d using (id) where i > 0)"""


#: The windows of all documents: (doc_id, pos, piece).
WINDOWS_SQL = f"(select id as doc_id, pos, piece from {windows_sql("(select doc_id as id, coalesce(text, '') as t from documents)")})"
#: ``documents`` as in ``corpus``, as chunks of their own, and ``benchmark`` as in ``questions``.
CORPUS_SQL = f"""select doc_id * {PLACES} + pos as ord, split_part(coalesce(text, ''), chr(10), 1) as title, coalesce(source, '') as law_title, '第' || (pos + 1) || '条' as article_no, piece as content, coalesce(source, '') as source_path, coalesce(lang, '') as region_level, doc_id, '财库〔2022〕' || (doc_id % 97 + 1) || '号' as doc_no
    from {WINDOWS_SQL} join documents using (doc_id)"""
WHOLE_SQL = "select doc_id as ord, split_part(coalesce(text, ''), chr(10), 1) as title, coalesce(source, '') as law_title, '' as article_no, coalesce(text, '') as content, coalesce(source, '') as source_path, coalesce(lang, '') as region_level, doc_id, '财库〔2022〕' || (doc_id % 97 + 1) || '号' as doc_no from documents"
QUESTIONS_SQL = "select item_id as qid, text || ' 第' || (item_id % 9 + 1) || '条 财库〔2022〕' || (item_id % 97 + 1) || '号' as question from benchmark"
