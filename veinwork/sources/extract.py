"""Reading files by what they are: dispatch by name and first bytes, cascades of readers, the longer text.

Text and HTML are read by Spark's own functions. Other kinds need code: a file goes through the readers of its kind in turn, as long as its text is too short to be that of a readable file, and the longest text stays. A
file that is called pdf but is none is read as what its first bytes say. Readers run on the executors, a file at a time; one that fails on a file counts as one that found nothing.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator, Sequence
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veinwork.functions.meta import extension
from veinwork.functions.text import html_to_text
from veinwork.ship import ship
from veinwork.sources.files import magic_kind, office_text

#: Fixed value: a pdf with fewer characters, white space left out, is taken for scanned.
SCANNED = 260

Readers = Sequence[tuple[str, Callable[[bytes], str]]]
_OFFICE = {"xl/": "xlsx", "word/": "docx", "ppt/": "pptx"}


def office_kind(raw: bytes) -> str:
    """xlsx, docx or pptx by a zip file's folders; else empty."""
    try:
        names = zipfile.ZipFile(BytesIO(raw)).namelist()
    except zipfile.BadZipFile:
        return ""
    return next((kind for folder, kind in _OFFICE.items() if any(n.startswith(folder) for n in names)), "")


def _read(how: Callable[[bytes], str], raw: bytes) -> str:
    try:
        return how(raw) or ""
    except Exception:  # a broken file is one without text
        return ""


def _size(text: str) -> int:
    return len("".join(text.split()))


def cascade(raw: bytes, readers: Readers, enough: int) -> tuple[str, str]:
    """The longest text of the readers that are needed, and its reader's name; a later one must find more."""
    best, by = "", readers[0][0] if readers else ""
    for name, how in readers:
        text = _read(how, raw)
        if _size(text) > _size(best):
            best, by = text, name
        if _size(best) >= enough:
            break
    return best, by


def by_code(ext: str, magic: str, raw: bytes, pdf: Readers, general: Readers) -> tuple[str, bool, str]:
    """(text, maybe scanned, strategy) of a file that Spark's functions can't read."""
    office = ("office", office_text)
    if ext == "pdf" and magic == "pdf":
        text, by = cascade(raw, pdf, SCANNED)
        return text, _size(text) < SCANNED, f"pdf-{by}" if by else "pdf"
    if ext == "pdf":  # called so, but is something else
        kind = office_kind(raw) if magic == "zip" else magic
        if not kind:
            return "", False, "unsupported"
        text, by = cascade(raw, [office, *general] if magic == "zip" else general, 1)
        return text, False, f"{by or 'none'}-mime-{kind}"
    text, by = cascade(raw, [office, *general], 1)
    return text, False, by


def read_by_content(files: DataFrame, pdf: Readers = (), general: Readers = ()) -> DataFrame:
    """Files (path, content, ...) with text, scanned and strategy. ``pdf``: named readers of pdf files, the cheapest first (text layer, then hidden text, then recognition); ``general``: of other kinds, old office files among them.

    Null contents are empty files. Kinds that nothing reads have an empty text and the strategy unsupported, or that of the last readers tried.
    """
    ext, pdf, general = extension(F.col("path")), list(pdf), list(general)
    known = files.withColumn("content", F.coalesce("content", F.lit(b""))).withColumns({"_ext": ext, "_magic": magic_kind(F.coalesce("content", F.lit(b"")))})
    text = F.decode(F.col("content"), "UTF-8")
    is_text, is_html = F.col("_ext").isin("md", "txt"), F.col("_ext").isin("html", "htm")
    mime_html = (F.col("_ext") == "pdf") & (F.col("_magic") == "html")
    coded = F.col("_ext").isin("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv") & ~mime_html
    answer = lambda t, how: F.struct(t.alias("text"), F.lit(False).alias("scanned"), how.alias("strategy"))

    def plain(c: Column) -> DataFrame:
        how = F.when(is_text, answer(text, F.lit("plain"))).when(is_html, answer(html_to_text(text), F.lit("html"))).when(mime_html, answer(html_to_text(text), F.lit("html-mime")))
        return known.where(c).withColumn("_a", how.otherwise(answer(F.lit(""), F.lit("unsupported")))).select(*files.columns, "_a.*")

    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time: contents are large
                row = batch.slice(k, 1)
                got = by_code(row.column("_ext")[0].as_py() or "", row.column("_magic")[0].as_py() or "", row.column("content")[0].as_py(), pdf, general)
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in names), *(pa.array([v], t) for v, t in zip(got, (pa.string(), pa.bool_(), pa.string())))], names=[*names, "text", "scanned", "strategy"])

    ship(files.sparkSession)
    schema = T.StructType([*files.schema.fields, T.StructField("text", T.StringType()), T.StructField("scanned", T.BooleanType()), T.StructField("strategy", T.StringType())])
    return plain(~F.coalesce(coded, F.lit(False))).unionByName(known.where(coded).mapInArrow(run, schema))
