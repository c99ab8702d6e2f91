"""Document metadata out of texts, titles and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from veinwork.functions.text import bind, blank, collapse, dash_value, dense, filled, first_filled, has_any, meta_map, poor_title, shorten, strip, unbracket
from veinwork.domain import REGULATIONS, Profile


def file_name(path: Column) -> Column:
    return F.regexp_extract(filled(path), r"([^/\\]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(filled(path), r"/[^/]*$", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(filled(name), r"\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def article_no(c: Column, profile: Profile = REGULATIONS) -> Column:
    return F.regexp_extract(filled(c), profile.article, 0)


def clause_no(c: Column, profile: Profile = REGULATIONS) -> Column:
    return first_filled(F.regexp_extract(filled(c), profile.clause, 0), F.regexp_extract(filled(c), profile.clause_item, 0))


def _numbered(c: Column, pattern: str) -> Column:
    g = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(g(0) != "", F.concat(g(1), F.lit("〔"), g(2), F.lit("〕"), g(3), F.lit("号"))).otherwise("")


def doc_number(c: Column, profile: Profile = REGULATIONS) -> Column:
    """The first number of a document as agency〔year〕n号, or as an order's number; empty if there is none."""
    t = unbracket(c)
    order = lambda i: F.regexp_extract(t, profile.doc_no_order, i)
    return first_filled(_numbered(t, profile.doc_no), F.when(order(0) != "", F.concat(order(1), F.lit("第"), order(2), F.lit("号"))))


def doc_number_or_self(c: Column, profile: Profile = REGULATIONS) -> Column:
    return first_filled(doc_number(c, profile), c)


def asked_doc_number(question: Column, profile: Profile = REGULATIONS) -> Column:
    """The number that a question names, bare: without brackets; numbers written with spaces are found too."""
    found = first_filled(_numbered(filled(question), profile.doc_no_asked), _numbered(dense(question), profile.doc_no_asked))
    return bare_number(found)


def text_doc_number(c: Column, profile: Profile = REGULATIONS) -> Column:
    return first_filled(_numbered(filled(c), profile.doc_no_asked), _numbered(dense(c), profile.doc_no_asked))


def fast_doc_number(c: Column, profile: Profile = REGULATIONS) -> Column:
    return dense(F.regexp_extract(filled(c), profile.doc_no_fast, 0))


def evaluated_doc_number(c: Column, profile: Profile = REGULATIONS) -> Column:
    """The number of a document in an evaluation's titles and paths: with brackets first, else by year; empty if there is none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(filled(c), p, 1), F.lit("")) for p in profile.doc_no_evaluated), F.lit(""))


def bare_number(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(filled(c)), r"\s+", ""), "（）〔〕()[]", "")


def number_spellings(c: Column) -> Column:
    """A bare number in its spellings, for a search; others stay as they are."""
    pattern = r"(财库|财办库|国办发|苏财购|扬财购|财税|财综|财金|财行)(20\d{2})(\d{1,4})号"
    g = lambda i: F.regexp_extract(filled(c), pattern, i)
    return F.when(g(0) == "", filled(c)).otherwise(
        F.concat_ws(" ", F.concat(g(1), g(2), g(3), F.lit("号")), F.concat(g(1), F.lit("〔"), g(2), F.lit("〕"), g(3), F.lit("号")), F.concat_ws(" ", g(1), g(2), F.concat(g(3), F.lit("号"))), F.lit("文号"), F.lit("发文字号"))
    )


def _dated(c: Column, pattern: str) -> Column:
    g = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(g(0) != "", F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0")))


def date(c: Column, profile: Profile = REGULATIONS) -> Column:
    """yyyy-MM-dd of the first date; what is no date comes back stripped. A day's leading zero is not understood: 03-05 reads 03-00."""
    t = F.translate(dense(c), "／－—.", "/---")
    return F.coalesce(_dated(t, profile.date_cn), _dated(t, profile.date_iso), strip(c))


def all_dates(c: Column, profile: Profile = REGULATIONS) -> Column:
    """Dates in words first, then those in figures, each in the order of the text."""
    found = F.concat(F.regexp_extract_all(filled(c), F.lit(profile.date_cn), F.lit(0)), F.regexp_extract_all(filled(c), F.lit(profile.date_iso), F.lit(0)))
    return F.transform(found, lambda d: date(d, profile))


def publish_date(c: Column, profile: Profile = REGULATIONS) -> Column:
    dates = all_dates(c, profile)
    return F.when(F.size(dates) > 0, F.element_at(dates, -1)).otherwise("")


def effective_date(c: Column, profile: Profile = REGULATIONS) -> Column:
    found = F.regexp_extract(filled(c), profile.date_effective, 1)
    return F.when(found != "", date(found, profile)).otherwise("")


def issuer(c: Column, profile: Profile = REGULATIONS) -> Column:
    """The first known issuer that the text names, in the order of the list; else what looks like one."""
    t = unbracket(c)
    known = F.coalesce(*(F.when(F.contains(t, F.lit(i)), F.lit(i)) for i in profile.issuers))
    return F.coalesce(known, F.regexp_extract(t, profile.issuer_fuzzy, 1))


def law_title(c: Column, profile: Profile = REGULATIONS) -> Column:
    return F.when(blank(c), "未知法规").otherwise(strip(F.regexp_replace(filled(c), profile.attachment_suffix, "")))


def category(title: Column, profile: Profile = REGULATIONS) -> Column:
    t = F.lower(filled(title))
    out = F.when(F.contains(t, F.lit("中华人民共和国")) & F.endswith(t, F.lit("法")), "LAW")
    for words, name in profile.categories:
        out = out.when(has_any(t, words), name)
    return out.otherwise("OTHER")


def region(path: Column, profile: Profile = REGULATIONS) -> Column:
    out = None
    for word, name in profile.regions:
        hit = F.contains(filled(path), F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("UNKNOWN")


def path_id(path: Column) -> Column:
    """The name-based UUID (version 3) of a path."""
    h = F.md5(filled(path))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def plain_title(c: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(filled(c), r"^\d+[_\-\. ]*", ""), "_+", " "))


def title(text: Column, path: Column, profile: Profile = REGULATIONS) -> Column:
    """The first line that can be a title; else the file's or the folder's name."""
    names = F.struct(plain_title(file_name(parent(path))).alias("folder"), plain_title(stem(file_name(path))).alias("name"), file_name(parent(path)).alias("raw_folder"), stem(file_name(path)).alias("raw_name"))
    return F.coalesce(F.get(_title_lines(text, profile), 0)["text"], bind(names, lambda n: _title_of_names(n["folder"], n["name"], n["raw_folder"], n["raw_name"], profile)))


def _title_lines(text: Column, profile: Profile) -> Column:
    lines = F.transform(F.split(filled(text), r"\R"), strip)
    header = F.transform(lines, lambda t: F.struct(F.startswith(t, F.lit("#")).alias("marked"), F.regexp_replace(t, r"^#+\s*", "").alias("text")))
    good = F.filter(header, lambda h: ~poor_title(h["text"], profile) & (h["marked"] | (F.length(h["text"]) > 6)))
    return F.filter(F.slice(good, 1, 1), lambda h: h.isNotNull())


def _title_of_names(folder: Column, name: Column, raw_folder: Column, raw_name: Column, profile: Profile) -> Column:
    generic = F.lower(folder).isin("", "corpus", "data", "tmp", "temp", "附件", "attachment")
    legal = name.rlike(profile.legal_file) | (_numbered(dense(name), profile.doc_no) != "") | dense(name).rlike(profile.doc_no_order)
    return (
        F.when(~poor_title(name, profile) & (legal | poor_title(folder, profile) | generic), name)
        .when(~poor_title(folder, profile) & ~generic, folder)
        .when(~poor_title(name, profile), name)
        .otherwise(F.when(blank(raw_folder), raw_name).otherwise(raw_folder))
    )


def repaired_title(current: Column, path: Column, profile: Profile = REGULATIONS) -> Column:
    """The title, or where it says little the nearest part of the path that names a document."""
    t = strip(current)
    weak = (F.length(t) < 6) | F.contains(t, F.lit("办公打文件")) | ~t.rlike(profile.law_title_cue)
    parts = F.transform(F.reverse(F.split(filled(path), "/")), lambda p: strip(F.regexp_replace(stem(p), "^[0-9]+[-_.、 ]*", "")))
    named = F.filter(parts, lambda p: (F.length(p) >= 6) & p.rlike(profile.law_title_cue))
    return F.when(weak & (F.size(named) > 0), F.element_at(named, 1)).otherwise(t)


def title_parts(c: Column) -> Column:
    """struct<law, article, clause, doc_no> of a displayed title."""
    t = collapse(c)
    pattern = "^(.*?)(第[一二三四五六七八九十百千万0-9]+条)?(\\s*第[一二三四五六七八九十百千万0-9]+款)?(?:（(.+?)）)?$"
    g = lambda i: strip(F.regexp_extract(t, pattern, i))
    law = F.when(t == "", "未知法规").when(g(1) == "", t).otherwise(g(1))
    return F.struct(law.alias("law"), g(2).alias("article"), g(3).alias("clause"), g(4).alias("doc_no"))


def display_title(law: Column, article: Column, clause: Column, number: Column) -> Column:
    base = F.concat_ws(" ", F.when(blank(law), "未知法规").otherwise(law), F.when(~blank(article), article), F.when(~blank(clause), clause))
    return F.when(~blank(number) & ~F.contains(base, filled(number)), F.concat(base, F.lit("（"), number, F.lit("）"))).otherwise(base)


def header_lines(fields: list[tuple[str, Column]]) -> Column:
    """Lines ``[key] value`` of the fields that are not blank."""
    return F.concat_ws("\n", *(F.when(~blank(v), F.concat(F.lit(f"[{k}] "), v)) for k, v in fields))


def enriched(chunk: Column, law: Column, kind: Column, article: Column, clause: Column) -> Column:
    return strip(F.concat_ws("\n", header_lines([("法规标题", law), ("法规类别", kind), ("条号", article), ("款项", clause)]), strip(chunk)))


def meta_json(c: Column, profile: Profile = REGULATIONS, most: int = 18, longest: int = 200) -> Column:
    """struct of the fields of a meta.json by their first filled alias, and ``extras``: the other scalar fields in order."""
    known = [a for _, names in profile.meta_aliases for a in names]

    def fields(m: Column) -> Column:
        own = F.filter(F.map_entries(m), lambda e: ~e["key"].isin(known) & ~blank(e["value"]) & ~e["value"].rlike(r"^\s*[\[{]"))
        extras = F.map_from_entries(F.transform(F.slice(own, 1, most), lambda e: F.struct(e["key"], shorten(collapse(e["value"]), longest))))
        return F.struct(*(first_filled(*(m[a] for a in names)).alias(k) for k, names in profile.meta_aliases), F.coalesce(extras, F.create_map().cast("map<string,string>")).alias("extras"))

    return bind(F.from_json(c, T.MapType(T.StringType(), T.StringType())), fields)


def front_matter(c: Column) -> Column:
    """struct<fields map, body> of a markdown text with a block of ``key: value`` lines between two rules."""
    block = F.regexp_extract(filled(c), r"(?s)^---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda t: F.instr(t, F.lit(":")) > 1)
    cut = lambda t: F.regexp_replace(strip(F.regexp_extract(t, "(?s)^[^:]*:(.*)$", 1)), '^"|"$', "")
    pairs = F.transform(lines, lambda t: F.struct(strip(F.regexp_extract(t, "^([^:]*):", 1)).alias("k"), cut(t).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"]))
    return F.struct(F.map_from_entries(last).alias("fields"), F.regexp_replace(filled(c), r"(?s)^---\n.*?\n---\n", "").alias("body"))


def official_url(declared: Column, content: Column) -> Column:
    url = r"(?i)https?://[^\s)]+"
    return first_filled(F.regexp_extract(first_filled(declared, dash_value(content, "来源链接")), url, 0), F.regexp_extract(filled(content), url, 0))


def flags(c: Column) -> Column:
    """struct<scanned, garbled, summary_like> as the marked lines say."""
    m = meta_map(c)
    said = lambda k: F.coalesce(F.lower(m[k]) == "true", F.lit(False))
    return F.struct(said("疑似扫描").alias("scanned"), said("疑似乱码").alias("garbled"), said("疑似摘要页").alias("summary_like"))
