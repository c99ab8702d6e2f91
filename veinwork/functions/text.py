"""Scalar functions on texts: Column in, Column out. Null counts as empty throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veinwork.domain import REGULATIONS, Profile


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fold(c: Column) -> Column:
    """Lower case; whatever is neither letter nor number becomes one space."""
    return F.trim(F.regexp_replace(F.lower(filled(c)), r"[^a-z0-9\p{L}\p{N}\p{IsHan}]+", " "))


def squeeze(c: Column) -> Column:
    """Lower case without white space; punctuation stays."""
    return F.regexp_replace(F.lower(filled(c)), r"\s+", "")


def dense(c: Column) -> Column:
    """Without white space."""
    out = filled(c)
    for white in " \t\n\x0b\f\r":  # what \s stands for; plain replacements cost less than a pattern
        out = F.replace(out, F.lit(white))
    return out


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(filled(c), r"\s+", " "))


def strip(c: Column) -> Column:
    """Without control characters and spaces at both ends."""
    return F.regexp_replace(filled(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def unbracket(c: Column) -> Column:
    """Without white space and brackets."""
    return F.translate(dense(c), "（）()【】[]", "")


def blank(c: Column) -> Column:
    return dense(c) == ""


def shorten(c: Column, most: int, tail: str = "...") -> Column:
    return F.when(F.length(filled(c)) > most, F.concat(F.substring(filled(c), 1, most), F.lit(tail))).otherwise(filled(c))


def excerpt(c: Column, most: int) -> Column:
    """Collapsed, and cut with an ellipsis."""
    return shorten(collapse(c), most, " ...")


def first_filled(*cols: Column) -> Column:
    """The first that is not blank, stripped; else empty."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in cols), F.lit(""))


def bind(c: Column, f) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w.lower()))
    return out


def drop_meta(c: Column, profile: Profile = REGULATIONS) -> Column:
    """Without lines that begin with one of the known keys in brackets."""
    return strip(F.regexp_replace(filled(c), rf"(?m)^\[({'|'.join(profile.meta_keys)})\].*$", ""))


def drop_marked(c: Column) -> Column:
    """Without lines that begin with anything in brackets."""
    return strip(F.regexp_replace(filled(c), r"(?m)^\[[^\]]+\].*$", ""))


def meta_value(c: Column, key: str) -> Column:
    """The value of the first line ``[key] value``."""
    return strip(F.regexp_extract(filled(c), rf"(?m)^\[{key}\]\s*(.+)$", 1))


def meta_map(c: Column) -> Column:
    """All lines ``[key] value`` as a map; the last of a key wins."""
    keys = F.transform(F.regexp_extract_all(filled(c), F.lit(r"(?m)^\[(.+?)\]\s*(.*)$"), F.lit(1)), strip)
    values = F.transform(F.regexp_extract_all(filled(c), F.lit(r"(?m)^\[(.+?)\]\s*(.*)$"), F.lit(2)), strip)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(keys, i + 2, F.size(keys) + 1), lambda k: k == p["k"]))
    return F.map_from_entries(last)


def dash_value(c: Column, key: str) -> Column:
    """The value of the first line ``- key: value``, whatever the key's case."""
    return strip(F.regexp_extract(filled(c), rf"(?im)^-\s*{key}:\s*(.*)$", 1))


def ratios(c: Column) -> tuple[Column, Column, Column]:
    """The text's length without white space, the shares of ideographs and of Latin letters."""
    return _ratios(dense(c))


def _ratios(d: Column) -> tuple[Column, Column, Column]:
    n = F.length(d)
    cjk = F.length(F.regexp_replace(d, r"[^一-鿿㐀-䶿\x{20000}-\x{2a6df}]+", ""))
    return n, cjk / n, F.length(F.regexp_replace(d, "[^A-Za-z]+", "")) / n


def garbled(c: Column, if_blank: bool = False) -> Column:
    """Long enough, hardly an ideograph, and many Latin letters."""

    def of(d: Column) -> Column:
        n, cjk, latin = _ratios(d)
        return F.when(n == 0, F.lit(if_blank)).otherwise((n >= 120) & (latin > 0.45) & (cjk < 0.12))

    return bind(dense(c), of)


def weak_title(c: Column, profile: Profile = REGULATIONS) -> Column:
    t = collapse(c)
    cue = has_any(t, profile.legal_cues)
    return (F.length(t) < 4) | ((t.rlike(profile.serial) | F.startswith(t, F.lit("1."))) & ~cue)


def summary_body(c: Column, profile: Profile = REGULATIONS) -> Column:
    """Reads like a portal's summary page: short, with two of three hints."""

    def of(d: Column) -> Column:
        hints = filled(c).rlike(profile.summary_hint).cast("int") + (F.contains(d, F.lit("附件")) & F.contains(d, F.lit(".pdf"))).cast("int") + (~filled(c).rlike(profile.article)).cast("int")
        return (d == "") | ((F.length(d) <= 2600) & (hints >= 2))

    return bind(dense(c), of)


def poor_title(c: Column, profile: Profile = REGULATIONS) -> Column:
    t = collapse(c)
    n = F.length(t)
    han = F.length(F.regexp_replace(t, r"[^一-鿿㐀-䶿]", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{Nd}]|[一-鿿㐀-䶿]", ""))
    return (n < 4) | (n > 140) | t.rlike(profile.page_title) | t.rlike(profile.generic_title) | (t.rlike(profile.serial) & (n > 18) & ~t.rlike(profile.legal_file)) | ((han == 0) & (letters < 4))


def mostly_digits(t: Column) -> Column:
    """All characters but one at most are digits, two at least."""
    return F.length(F.regexp_replace(t, r"[^\p{Nd}]", "")) >= F.greatest(F.lit(2), F.length(t) - 1)


def has_token(haystack: Column, token: Column) -> Column:
    """Whether the text holds the token, without its spaces, of two characters or more."""
    t = dense(token)
    return (F.length(t) >= 2) & (F.contains(haystack, t) | F.contains(dense(haystack), t))


def window(body: Column, keywords: Column, most: int = REGULATIONS.snippet_chars) -> Column:
    """A snippet around the first keyword. The place is found in the folded text but cut from the text itself."""
    t = collapse(body)
    folded = fold(t)
    places = F.filter(F.transform(F.filter(keywords, lambda k: F.length(k) >= 2), lambda k: F.instr(folded, fold(k))), lambda p: p > 0)
    start = F.greatest(F.lit(1), F.array_min(places) - 140)
    cut = F.substring(t, start, F.lit(most))
    around = F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(start - 1 + most < F.length(t), "...").otherwise(""))
    return F.when(t == "", "[正文缺失]").when(F.size(places) == 0, shorten(t, most)).otherwise(around)


def clean_answer(c: Column, profile: Profile = REGULATIONS) -> Column:
    """Without thoughts, path lines and paths; blank lines collapsed; cut."""
    t = strip(F.regexp_replace(filled(c), r"(?is)<think>.*?</think>", ""))
    t = strip(F.regexp_replace(t, r"(?is)<think>.*$", ""))
    t = F.regexp_replace(t, r"(?im)^\s*(\*\*)?(目录|文件绝对路径|文件路径|来源路径|绝对路径)(\*\*)?\s*[:：].*$", "")
    t = F.regexp_replace(t, r"(?i)(/users/\S+|/home/\S+|/opt/\S+|/tmp/\S+|/var/\S+|[a-z]:\\\\\S+)", "[已隐藏路径]")
    return shorten(strip(F.regexp_replace(t, r"\n{3,}", "\n\n")), profile.answer_chars)


def shrink_summary(c: Column, most: int = 700) -> Column:
    t = F.regexp_replace(filled(c), r"(?m)^\s*(发稿时间|访问量|当前位置|上一篇|下一篇|打印本页|关闭窗口).*$", "")
    return shorten(strip(F.regexp_replace(t, r"\n{3,}", "\n\n")), most)


def html_to_text(c: Column) -> Column:
    """The text of an HTML page: scripts, styles and tags out, the common references decoded, white space collapsed."""
    t = F.regexp_replace(filled(c), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return collapse(t)
