"""Chunking: articles, sections, windows, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from veinwork.functions.meta import article_no, category, clause_no, enriched, law_title
from veinwork.functions.text import bind, blank, dense, filled, strip
from veinwork.domain import REGULATIONS, Profile


def unique_stripped(parts: Column) -> Column:
    """Stripped, without blanks, the first of equals."""
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda p: ~blank(p)))


def at_line_starts(c: Column, profile: Profile = REGULATIONS) -> Column:
    """Every article's number begins a line."""
    return F.regexp_replace(filled(c), rf"(?<!\n)({profile.article})", "\n$1")


def article_blocks(c: Column, profile: Profile = REGULATIONS) -> Column:
    """From each line that begins with an article's number up to the next; what comes before the first is left out."""
    parts = F.split(filled(c), rf"(?m)(?=^\s*{profile.article})")
    return F.filter(F.transform(parts, strip), lambda p: p.rlike(rf"^\s*{profile.article}"))


def sections(c: Column, profile: Profile = REGULATIONS) -> Column:
    """Lines gathered from heading to heading; each line ends in a line feed."""
    lines = F.filter(F.transform(F.split(filled(c), r"\R"), strip), lambda t: ~blank(t))

    def between(x: Column) -> Column:
        starts, lines = x["starts"], x["lines"]
        end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(lines))
        return F.transform(starts, lambda s, i: F.concat(F.array_join(F.slice(lines, s + 1, end(i) - s), "\n"), F.lit("\n")))

    def cut(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda t, i: F.when((i == 0) | t.rlike(profile.heading), i)), lambda i: i.isNotNull())
        return F.when(F.size(lines) == 0, F.array(filled(c))).otherwise(bind(F.struct(starts.alias("starts"), lines.alias("lines")), between))

    return bind(lines, cut)


def windows(c: Column, size: int = REGULATIONS.chunk_size, overlap: int = REGULATIONS.chunk_overlap) -> Column:
    """Overlapping windows that end behind a line feed, full stop or semicolon near the size: up to 60 characters back, else up to 30 on.

    The text is cut once into pieces a little longer than a window, so that a window is read from three of them at most, wherever it stands; the steps keep the windows' ends only. Time grows with the text's length.
    """
    long = size + 64

    def of(x: Column) -> Column:
        n, pieces = x["n"], x["pieces"]
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("ends"))

        def part(at: Column, length: Column) -> Column:
            k = F.floor(at / long).cast("int")
            return F.substring(F.concat_ws("", F.get(pieces, k), F.get(pieces, k + 1), F.get(pieces, k + 2)), at - k * long + 1, length)

        def ahead(raw: Column) -> Column:
            on = part(raw, F.least(n - 1, raw + 30) - raw + 1)
            return bind(F.length(F.regexp_extract(on, "(?s)^([^\\n。；;]*[\\n。；;])", 1)), lambda k: F.when(k > 0, raw + k).otherwise(raw))

        def end_of(at: Column, raw: Column) -> Column:
            low = F.greatest(at, raw - 60)
            back = part(low, raw - low + 1)  # the characters low .. raw
            return bind(F.length(F.regexp_extract(back, "(?s)^(.*[\\n。；;])", 1)), lambda k: F.when(k > 0, low + k).otherwise(ahead(raw)))

        def step(acc: Column, _: Column) -> Column:
            def cut(end: Column) -> Column:
                return F.struct(F.greatest(F.lit(0), end - overlap).alias("at"), (end >= n).alias("over"), F.concat(acc["ends"], F.array(end)).alias("ends"))

            fresh = bind(F.least(acc["at"] + size, n), lambda raw: bind(F.when(raw >= n, n).otherwise(end_of(acc["at"], raw)), cut))
            return F.when(acc["over"], acc).otherwise(fresh)

        def read(ends: Column) -> Column:
            first = lambda i: F.when(i == 0, 0).otherwise(F.greatest(F.lit(0), F.get(ends, i - 1) - overlap))
            return F.transform(ends, lambda end, i: part(first(i), end - first(i)))

        steps = F.sequence(F.lit(0), F.ceil(n / F.lit(max(1, size - overlap - 60))).cast("int"))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(bind(F.aggregate(steps, start, step, lambda acc: acc["ends"]), read))

    t = filled(c)
    return bind(F.struct(F.length(t).alias("n"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{long}}}"), F.lit(0)).alias("pieces")), of)


def chunks(c: Column, profile: Profile = REGULATIONS) -> Column:
    """The chunks of a text: its articles if it has more than one; else its sections, long ones in windows."""
    t = at_line_starts(c, profile)
    articles = article_blocks(t, profile)
    others = F.flatten(F.transform(sections(t, profile), lambda s: F.when(F.length(s) <= profile.chunk_size, F.array(s)).otherwise(windows(s, profile.chunk_size, profile.chunk_overlap))))
    return F.when(blank(c), F.array().cast("array<string>")).otherwise(unique_stripped(F.when(F.size(articles) > 1, articles).otherwise(others)))


def substantive(chunk: Column, profile: Profile = REGULATIONS, least: int = 36) -> Column:
    """Has a body, or an article, or stands for a main document that could not be read."""
    unread = F.contains(chunk, F.lit("[文档类型] 主文")) & (F.contains(chunk, F.lit("[疑似扫描] true")) | F.contains(chunk, F.lit("[提示] 主文抽取失败")) | F.contains(chunk, F.lit("[提示] 主文疑似扫描稿或可读文本为空")))
    body = F.regexp_replace(filled(chunk), r"(?m)^\[[^\]]+\].*$", "")
    return ~blank(chunk) & (unread | (F.length(dense(body)) >= least) | (~blank(body) & body.rlike(profile.article)))


def attachment_document(title: Column, path: Column, text: Column, profile: Profile = REGULATIONS) -> Column:
    return filled(title).rlike(profile.attachment_suffix) | F.contains(filled(path), F.lit("/附件/")) | F.contains(filled(text), F.lit("[文档类型] 附件"))


def chunk_documents(docs: DataFrame, profile: Profile = REGULATIONS, seen: tuple[Observation, Observation] | None = None) -> DataFrame:
    """(id, title, region_level, source_path, text) into the chunk table. A chunk's number counts the chunks that are left out as well.

    ``seen``: two observations that get the numbers of ``documents``, and of ``chunks`` and ``skipped`` ones, when the result is written."""
    if seen:
        docs = docs.observe(seen[0], F.count(F.lit(1)).alias("documents"))
    law = law_title(F.col("title"), profile)
    cut = docs.withColumn("law_title", law).withColumn("doc_category", category(law, profile)).select("*", F.posexplode(chunks(F.col("text"), profile)).alias("pos", "raw"))
    keep = attachment_document(F.col("title"), F.col("source_path"), F.col("text"), profile) | substantive(F.col("raw"), profile)
    if seen:
        cut = cut.withColumn("_keep", F.coalesce(keep, F.lit(False))).observe(seen[1], F.count_if("_keep").alias("chunks"), F.count_if(~F.col("_keep")).alias("skipped"))
    kept = cut.where(F.col("_keep") if seen else keep)
    article, clause = article_no(F.col("raw"), profile), clause_no(F.col("raw"), profile)
    return kept.select(
        F.concat_ws("#", "id", "pos").alias("chunk_id"), F.col("id").alias("document_id"), "title", "region_level", "source_path",
        enriched(F.col("raw"), F.col("law_title"), F.col("doc_category"), article, clause).alias("content"), "law_title", article.alias("article_no"), "doc_category", "pos",
    )


def headed_articles(body: Column, profile: Profile = REGULATIONS, least: int = 30) -> Column:
    """array<struct<heading, content>> of the markdown headings that name an article; short ones are left out."""
    headings = F.regexp_extract_all(filled(body), F.lit(rf"(?m)^{profile.article_heading}$"), F.lit(1))
    texts = F.slice(F.split(filled(body), rf"(?m)^{profile.article_heading}$"), 2, F.size(headings) + 1)
    both = F.transform(F.arrays_zip(headings.alias("h"), texts.alias("t")), lambda x: F.struct(strip(x["h"]).alias("heading"), strip(x["t"]).alias("content")))
    return F.filter(both, lambda x: F.length(x["content"]) >= least)


def paragraphs(body: Column, least: int = 120) -> Column:
    return F.filter(F.transform(F.split(filled(body), r"\n\s*\n"), strip), lambda p: F.length(p) >= least)


def fast_chunks(docs: DataFrame, profile: Profile = REGULATIONS) -> DataFrame:
    """Markdown texts (path, text) with front matter into headed articles, or paragraphs where there is no such heading."""
    from veinwork.functions.meta import fast_doc_number, file_name, front_matter, stem
    from veinwork.functions.text import dash_value, first_filled

    fm = docs.withColumn("fm", front_matter(F.col("text"))).withColumn("body", F.col("fm.body"))
    front = lambda k: F.col("fm.fields")[k]
    body = F.col("body")
    url = first_filled(front("source_url"), front("url"), front("source_link"), dash_value(body, "source_url"), dash_value(body, "url"), dash_value(body, "source_link"), dash_value(body, "来源链接"))
    headed = body.rlike(rf"(?m)^{profile.article_heading}$")
    plain = F.transform(paragraphs(body), lambda p: F.struct(F.lit("").alias("heading"), p.alias("content")))
    parts = F.when(headed, headed_articles(body, profile)).otherwise(plain)
    return fm.select(
        stem(file_name(F.col("path"))).alias("title"), first_filled(front("doc_no"), fast_doc_number(body, profile)).alias("doc_no"), F.coalesce(front("issuer"), F.lit("")).alias("issuer"),
        dash_value(body, "law_level").alias("law_level"), "path", F.coalesce(front("content_type"), F.lit("structured_text")).alias("content_type"), url.alias("source_url"), F.posexplode(parts).alias("pos", "part"),
    ).select("title", "doc_no", "issuer", "law_level", F.col("part.heading").alias("article_no"), F.col("part.content").alias("content"), F.col("path").alias("source_path"), "content_type", "source_url", "pos")


