"""Corpora of files: the walk, what is a main document, what is attached to it, and the readers."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from veinwork.functions.meta import date, doc_number, doc_number_or_self, effective_date, extension, file_name, header_lines, issuer, meta_json, parent, path_id, plain_title, publish_date, region, stem, title
from veinwork.functions.text import blank, dense, filled, first_filled, garbled, html_to_text, shrink_summary, strip, unbracket
from veinwork.domain import REGULATIONS, Profile
from veinwork.ship import ship

# Fixed values.
PRIMARY = ("md", "txt", "html", "htm", "pdf", "doc", "docx", "xls", "xlsx", "csv", "ppt", "pptx")
ATTACHMENT = ("pdf", "doc", "docx", "xls", "xlsx", "txt", "md", "html", "htm")
IGNORED = ("list.txt", "list_new.txt", "list_sorted.txt", "links.txt", "url.txt", "urls.txt")
CONTENT = ("content.md", "content.html")
WEIGHTS = (("pdf", 120), ("doc", 110), ("docx", 110), ("md", 90), ("txt", 90), ("html", 75), ("htm", 75), ("xls", 60), ("xlsx", 60))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size) of all files below the root that hold a byte."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return got.select(F.regexp_replace("path", "^file:", "").alias("path"), "content", F.col("length").alias("size"))


def file_kinds(files: DataFrame, profile: Profile = REGULATIONS) -> DataFrame:
    """Files with folder, name and what they may be."""
    name = F.lower(file_name(F.col("path")))
    ignored = name.isin(*IGNORED)
    reference = name.rlike(profile.reference_file) & ~name.rlike(profile.legal_file)
    return files.withColumns({"folder": parent(F.col("path")), "name": name, "is_primary": extension(F.col("path")).isin(*PRIMARY) & ~ignored, "is_attachment": extension(F.col("path")).isin(*ATTACHMENT) & ~ignored, "is_content": name.isin(*CONTENT), "is_reference": reference})


def magic_kind(content: Column) -> Column:
    """pdf, zip, ole or html by a file's first bytes; else empty."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    return F.when(F.startswith(head, F.lit("25504446")), "pdf").when(F.startswith(head, F.lit("504B0304")), "zip").when(F.startswith(head, F.lit("D0CF11E0A1B11AE1")), "ole").when(start.rlike("<!doctype html|<html|<body|<head"), "html").otherwise("")


def sibling_score(name: Column, size: Column, profile: Profile = REGULATIONS) -> Column:
    weight = None
    for ext, w in WEIGHTS:
        hit = F.endswith(name, F.lit(f".{ext}"))
        weight = F.when(hit, w) if weight is None else weight.when(hit, w)
    return weight.otherwise(0) + F.when(name.rlike(profile.legal_file), 35).otherwise(0) - F.when(name.rlike(profile.reference_file), 35).otherwise(0) + F.floor(F.least(F.lit(30.0), F.log10(F.greatest(F.lit(1), size)) * 6)).cast("int")


def portal_summary(text: Column, longest_sibling: Column, profile: Profile = REGULATIONS) -> Column:
    """A content page that only introduces what lies beside it."""
    t = filled(text)
    n, articles = F.length(dense(t)), F.regexp_count(t, F.lit(profile.article))
    hints = t.rlike(profile.summary_hint_ingest).cast("int") + (n <= 2400).cast("int") + (F.contains(t, F.lit(".pdf")) | F.contains(t, F.lit("附件"))).cast("int")
    weak = (n <= 2400) & (articles <= 1)
    longest = F.coalesce(longest_sibling, F.lit(0))
    return blank(t) | (weak & ((hints >= 2) | ((longest > 0) & (longest >= F.greatest(F.lit(1200.0), n * 1.6)))))


def primaries(files: DataFrame, profile: Profile = REGULATIONS) -> DataFrame:
    """The main documents out of (path, text, size): per folder its content page, or the best file beside it where that page is a mere summary;
    without such a page all files that are no reference material, or else all. Adds ``reason``."""
    got = file_kinds(files, profile).where("is_primary")
    w = Window.partitionBy("folder")
    other = ~F.col("is_content") & ~F.col("is_reference")
    page = F.min(F.when(F.col("is_content"), F.col("path"))).over(w)
    got = got.withColumn("_page", page).withColumn("_longest", F.max(F.when((F.col("path") != F.col("_page")) & ~F.col("is_reference"), F.length(dense(F.col("text"))))).over(w))
    got = got.withColumn("_summary", F.max(F.when(F.col("path") == F.col("_page"), portal_summary(F.col("text"), F.col("_longest"), profile))).over(w))
    rated = F.when((F.col("path") != F.col("_page")) & ~F.col("is_reference"), F.struct(sibling_score(F.col("name"), F.col("size"), profile).alias("s"), F.col("path").alias("p")))
    got = got.withColumn("_best", F.max(rated).over(w)["p"]).withColumn("_plain", F.max(other).over(w))
    switched = F.col("_summary") & F.col("_best").isNotNull()
    keep = F.when(F.col("_page").isNotNull(), F.col("path") == F.when(switched, F.col("_best")).otherwise(F.col("_page"))).otherwise(~F.col("_plain") | ~F.col("is_reference"))
    reason = F.when(F.col("_page").isNotNull(), F.when(switched, "content.* 疑似摘要，自动切换为正文文件").otherwise("命中 content.*")).otherwise(F.when(F.col("_plain"), "目录无 content.*，过滤明显参考类文件后入库").otherwise("目录无 content.*，全部文件按独立主文入库"))
    return got.where(keep).withColumn("reason", reason).drop("_page", "_longest", "_summary", "_best", "_plain")


def attachments(files: DataFrame, main: DataFrame, profile: Profile = REGULATIONS) -> DataFrame:
    """(primary, path): files in the folder 附件 below a main document, and files beside it where its folder has a content page or one main document at most."""
    kinds = file_kinds(files, profile)
    folder = kinds.groupBy("folder").agg(F.max("is_content").alias("_page"), F.count_if(F.col("is_primary")).alias("_n"))
    own = main.select(F.col("path").alias("primary"), parent(F.col("path")).alias("folder"))
    there = kinds.where("is_attachment")
    below = there.where(F.contains(F.col("path"), F.lit("/附件/"))).withColumn("folder", F.regexp_extract("path", "^(.*?)/附件/", 1))
    beside = there.where(~F.col("name").isin(*CONTENT)).join(folder.where("_page or _n <= 1").select("folder"), "folder")
    pairs = own.join(below.select("folder", "path"), "folder").union(own.join(beside.select("folder", "path"), "folder"))
    return pairs.where("primary <> path").select("primary", "path").distinct()


def attachment_kind(name: Column, text: Column, profile: Profile = REGULATIONS) -> Column:
    n = F.lower(filled(name))
    legal = n.rlike(profile.legal_attachment) | (F.length(dense(text)) > 1200) | dense(text).rlike(profile.article_any)
    return F.when(n.rlike(r"\.(xls|xlsx|csv)$") | n.rlike(profile.reference_attachment) | garbled(text) | ~legal, "参考型附件").otherwise("正文型附件")


def summary_page(text: Column, name: Column, profile: Profile = REGULATIONS) -> Column:
    t = filled(text)
    hints = t.rlike(profile.summary_hint_ingest).cast("int") + (F.length(dense(t)) <= 2400).cast("int") + ((F.contains(t, F.lit("附件")) | F.contains(t, F.lit(".pdf"))) & (F.regexp_count(t, F.lit(profile.article)) <= 1)).cast("int")
    return blank(t) | (F.lower(name).isin(*CONTENT) & (hints >= 2))


def read_texts(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Files with ``text``: markdown, plain text and HTML by Spark; office tables and documents by their XML; other kinds by ``extractors`` (by extension), which
    run on the executors. What can't be read is empty."""
    plain = F.decode(F.col("content"), "UTF-8")
    ext = extension(F.col("path"))
    given = dict(extractors or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                how = given.get(path.rpartition(".")[2].lower()) or office_text
                try:
                    out.append(how(raw or b""))
                except Exception:  # a broken file is one without text
                    out.append("")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "text"])

    by_spark = files.where(ext.isin("md", "txt", "html", "htm", "csv", "json")).withColumn("text", F.when(ext.isin("html", "htm"), html_to_text(plain)).otherwise(plain))
    ship(files.sparkSession)
    by_code = files.where(~ext.isin("md", "txt", "html", "htm", "csv", "json")).mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("text", T.StringType())]))
    return by_spark.unionByName(by_code)


def office_text(raw: bytes) -> str:
    """The text of a docx, pptx or xlsx file (tables as rows joined by bars); else empty."""
    if raw[:4] != b"PK\x03\x04":
        return ""
    z = zipfile.ZipFile(BytesIO(raw))
    names = sorted(z.namelist())
    local = lambda e: e.tag.rpartition("}")[2]
    if "word/document.xml" in names:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter() if local(t) == "t") for p in root.iter() if local(p) == "p")
    if any(n.startswith("ppt/slides/slide") for n in names):
        return "\n".join(" ".join(t.text or "" for t in ElementTree.fromstring(z.read(n)).iter() if local(t) == "t") for n in names if n.startswith("ppt/slides/slide"))
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(s) == "si"]
    out = []
    for n in [x for x in names if x.startswith("xl/worksheets/sheet")]:
        rows = []
        for row in ElementTree.fromstring(z.read(n)).iter():
            if local(row) == "row":
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c.iter() if local(x) in ("v", "t")), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if any(x.strip() for x in cells):
                    rows.append(" | ".join(cells))
        out.append("\n".join([f"# 表格: {n.rpartition('/')[2].removesuffix('.xml')}", *(rows or ["[空表]"])]))
    return "\n".join(out)


def longer(*texts: Column) -> Column:
    """The longest of several readings of one file, the first of equals."""
    rated = F.array(*(F.struct(F.length(dense(t)).alias("n"), F.lit(-i).alias("i"), filled(t).alias("t")) for i, t in enumerate(texts)))
    return F.array_max(rated)["t"]


def documents(main: DataFrame, metas: DataFrame, profile: Profile = REGULATIONS) -> DataFrame:
    """The document table (id, title, region_level, source_path, text) of main documents (path, text, reason), with a header of marked lines. ``metas``: (folder, json) of meta.json files."""
    got = main.withColumn("folder", parent(F.col("path"))).join(metas.select("folder", "json"), "folder", "left").withColumn("m", meta_json(F.col("json"), profile))
    got = got.withColumn("text", strip(F.col("text"))).withColumn("found", title(F.col("text"), F.col("path"), profile))
    got = got.withColumn("whole", unbracket(F.concat_ws(" ", "path", "found", "text"))).withColumn("name", plain_title(first_filled(F.col("m.title"), F.col("found"))))
    whole, text, name, number = (F.col(c) for c in ("whole", "text", "name", "number"))
    got = got.withColumn("number", doc_number_or_self(first_filled(F.col("m.doc_no"), doc_number(whole, profile)), profile)).withColumn("issuer", first_filled(F.col("m.issuer"), issuer(whole, profile)))
    got = got.withColumn("published", first_filled(date(F.col("m.publish_date"), profile), publish_date(whole, profile))).withColumn("effective", first_filled(date(F.col("m.effective_date"), profile), effective_date(whole, profile)))
    got = got.withColumn("summary", summary_page(text, file_name(F.col("path")), profile)).withColumn("bad", garbled(text)).withColumn("scanned", blank(text))
    extras = F.array_join(F.transform(F.map_entries("m.extras"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    fields = [("文号", number), ("发文机关", F.col("issuer")), ("发布日期", F.col("published")), ("施行日期", F.col("effective")), ("来源链接", F.col("m.source_url")), ("元数据", extras)]
    said = lambda c: F.when(F.col(c), "true").otherwise("false")
    hint = F.when(F.col("scanned"), "主文疑似扫描稿或可读文本为空。").when(F.col("bad"), "主文文本疑似乱码，检索将自动降权，建议补充高质量来源。").when(F.col("summary"), "当前页面疑似摘要/导航页，正文以同目录附件或兄弟正文文件为准。")
    header = header_lines([("文档类型", F.lit("主文")), ("主文判定", F.col("reason")), ("来源文件", F.col("path")), *fields, ("抽取策略", F.lit("text")), ("疑似扫描", said("scanned")), ("疑似乱码", said("bad")), ("疑似摘要页", said("summary")), ("提示", hint)])
    body = F.when(F.col("summary"), shrink_summary(text)).otherwise(text)
    full_title = F.when((number != "") & ~F.contains(name, number), F.concat(name, F.lit("（"), number, F.lit("）"))).otherwise(name)
    return got.select(path_id(F.col("path")).alias("id"), full_title.alias("title"), region(F.col("path"), profile).alias("region_level"), F.col("path").alias("source_path"), strip(F.concat_ws("\n\n", header, F.when(~blank(body), body))).alias("text"))


def raw_attachment_rows(files: DataFrame) -> DataFrame:
    """Rows that stand for attachments by their names only."""
    from veinwork.functions.meta import fast_doc_number

    name = file_name(F.col("path"))
    pseudo = strip(F.concat_ws(" ", F.lit("附件原文"), stem(name), file_name(parent(F.col("path"))), name))
    return files.select(stem(name).alias("title"), fast_doc_number(pseudo).alias("doc_no"), F.lit("").alias("article_no"), pseudo.alias("content"), F.col("path").alias("source_path"), F.lit("raw_attachment").alias("content_type"))
