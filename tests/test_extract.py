"""Files are read as what they are, not as what they are called."""

import io
import zipfile

from veinwork.sources import extract, files


def zipped(**parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return raw.getvalue()


SHEET = zipped(xl__worksheets__sheet1_xml="<worksheet><sheetData><row><c><v>5</v></c></row></sheetData></worksheet>")
WORD = zipped(word__document_xml="<d><p><t>第一条 正文</t></p></d>")
SLIDES = zipped(ppt__slides__slide1_xml="<s><t>title</t></s>")
PDF, OLE, HTML = b"%PDF-1.7 body", bytes.fromhex("D0CF11E0A1B11AE1") + b"old", "<!DOCTYPE html><html><body><p>正文 &amp; more</p></body></html>".encode()
CASES = {
    "a.md": ("文".encode(), ("文", False, "plain")),
    "a.html": (HTML, ("正文 & more", False, "html")),
    "good.pdf": (PDF + b"x" * 300, ("x" * 300, False, "pdf-layer")),
    "scan.pdf": (PDF + b"short", ("recognised", True, "pdf-ocr")),
    "blank.pdf": (PDF, ("", True, "pdf-layer")),
    "html.pdf": (HTML, ("正文 & more", False, "html-mime")),
    "sheet.pdf": (SHEET, ("# 表格: sheet1\n5", False, "office-mime-xlsx")),
    "word.PDF": (WORD, ("第一条 正文", False, "office-mime-docx")),
    "slides.pdf": (SLIDES, ("title", False, "office-mime-pptx")),
    "ole.pdf": (OLE, ("old text", False, "old-mime-ole")),
    "text.pdf": (b"neither", ("", False, "unsupported")),
    "zip.pdf": (b"PK\x03\x04 broken", ("", False, "unsupported")),
    "w.docx": (WORD, ("第一条 正文", False, "office")),
    "x.xls": (OLE, ("old text", False, "old")),
    "broken.xlsx": (b"PK\x03\x04", ("", False, "office")),
    "none.txt": (None, ("", False, "plain")),
    "a.exe": (b"MZ", ("", False, "unsupported")),
    "noext": (b"MZ", ("", False, "unsupported")),
}


def readers():
    """Made here, so that they go to the workers by value."""

    def layer(raw):
        return raw[13:].decode()

    def hidden(raw):
        raise ValueError("broken reader")

    def ocr(raw):
        return "recognised" if raw[13:] else ""

    def old(raw):
        return "old text" if raw.startswith(bytes.fromhex("D0CF11E0A1B11AE1")) else ""

    return dict(pdf=[("layer", layer), ("hidden", hidden), ("ocr", ocr)], general=[("old", old)])


def test_every_kind(spark, tmp_path):
    rows = [(f"/c/{name}", raw, 1) for name, (raw, _) in CASES.items()]
    table = spark.createDataFrame(rows, "path string, content binary, size int")
    got = extract.read_by_content(table, **readers()).collect()
    assert {r["path"][3:]: (r["text"], r["scanned"], r["strategy"]) for r in got} == {k: v for k, (_, v) in CASES.items()} and len(got) == len(rows)
    for name, (raw, _) in CASES.items():
        (tmp_path / name).write_bytes(raw or b"")
    walked = extract.read_by_content(files.walk(spark, str(tmp_path)), **readers())
    assert {r["path"].rpartition("/")[2]: r["strategy"] for r in walked.collect()} == {k: v[2] for k, (raw, v) in CASES.items() if raw}  # the walk leaves out files without a byte


def test_longest_reading_stays():
    readers = [("a", lambda r: "x x x"), ("b", lambda r: "yy"), ("c", lambda r: "zzzz"), ("d", lambda r: "wwww")]
    assert extract.cascade(b"", readers, 10) == ("zzzz", "c") and extract.cascade(b"", readers, 3) == ("x x x", "a") and extract.cascade(b"", [], 3) == ("", "")
