"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veinwork.functions.meta import bare_number
from veinwork.functions.text import bind, blank, dense, filled, fold, has_any, has_token
from veinwork.operators.terms import char_bigrams, compare_pair, grams, kinds
from veinwork.domain import REGULATIONS, Profile


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1.0) / (df + 0.5)) + 1.0


def coverage(terms: Column, weights: Column, hit) -> Column:
    """The share of the terms' weight that ``hit`` holds for; 0 without terms. Terms without a weight count 1."""
    both = F.arrays_zip(terms.alias("t"), weights.alias("w"))
    weight = lambda x: F.coalesce(x["w"], F.lit(1.0))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + weight(x))
    got = F.aggregate(both, F.lit(0.0), lambda s, x: s + F.when(hit(x["t"]), weight(x)).otherwise(0.0))
    return F.when(F.size(terms) == 0, 0.0).otherwise(got / total)


def longest_shared(query: Column, text: Column, low: int = 4, high: int = 12) -> Column:
    """The length of the query's longest substring of ``low`` to ``high`` characters that the text holds; 0 if none."""
    out = None
    for n in range(high, low - 1, -1):
        hit = F.exists(grams(query, n), lambda g: F.contains(text, g))
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(0)


def exact_match(query: Column, text: Column) -> Column:
    """1 if the text holds the whole query of four characters or more; for six or more, the share of the longest fragment."""
    n = F.length(query)
    return F.when((n >= 4) & F.contains(text, query), 1.0).when(n >= 6, longest_shared(query, text) / F.least(F.lit(12), n)).otherwise(0.0)


def phrase_hit(query: Column, text: Column) -> Column:
    """The same, but fragments count from four characters on."""
    def of(q: Column) -> Column:
        n = F.length(q)
        return F.when((n >= 4) & F.contains(text, q), 1.0).when(n <= 3, 0.0).otherwise(longest_shared(q, text) / F.least(F.lit(12), n))

    return bind(dense(query), of)


def article_boost(asked: Column, article: Column, body: Column) -> Column:
    return F.when(asked == "", 0.0).when(article == asked, 0.25).when(F.contains(body, asked), 0.10).otherwise(0.0)


def length_penalty(n: Column) -> Column:
    return F.when(n <= 1000, 0.0).otherwise(F.least(F.lit(0.18), (n - 1000) / 5200.0))


def structure_bonus(article: Column, law: Column, summary: Column, garbled: Column) -> Column:
    return F.when(article != "", 0.03).otherwise(0.0) + F.when(F.length(law) >= 4, 0.03).otherwise(0.0) + F.when(~summary & ~garbled, 0.02).otherwise(0.0)


def quality_terms(body_length: Column, article: Column, law: Column, summary: Column, scanned: Column, garbled: Column, weak: Column) -> Column:
    """All that a chunk gets or loses whatever the question."""
    short = F.when(body_length < 40, 0.36).when(body_length < 120, 0.12).otherwise(0.0)
    lost = F.when(summary, 0.14).otherwise(0.0) + F.when(scanned, 0.06).otherwise(0.0) + F.when(garbled, 0.16).otherwise(0.0) + F.when(weak, 0.08).otherwise(0.0)
    return structure_bonus(article, law, summary, garbled) - length_penalty(body_length) - lost - short


def cosine01(a: Column, b: Column, truncate: bool = False) -> Column:
    """(cosine + 1) / 2; 0 for missing and zero vectors. Where the lengths differ: 0, or with ``truncate`` the common part."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, 1, F.greatest(n, F.lit(1))), lambda e: e.cast("double")) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot, p, q = total(F.zip_with(x, y, lambda i, j: i * j)), total(F.transform(x, lambda i: i * i)), total(F.transform(y, lambda i: i * i))
    usable = a.isNotNull() & b.isNotNull() & (n > 0) & (F.lit(True) if truncate else F.size(a) == F.size(b))
    return F.when(usable & (p > 0) & (q > 0), (dot / (F.sqrt(p) * F.sqrt(q)) + 1) * 0.5).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    def of(x: Column) -> Column:
        a, b, same = x["a"], x["b"], F.size(F.array_intersect(x["a"], x["b"]))
        return _jaccard(a, b, same)

    return bind(F.struct(a.alias("a"), b.alias("b")), of)


def _jaccard(a: Column, b: Column, same: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - same))


def rerank(first: Column, query: Column, text: Column, semantic: Column | None = None) -> Column:
    """The second stage: the first stage's score, pairs of characters in common, the longest fragment; with vectors their cosine."""
    lexical = first * 0.62 + jaccard(char_bigrams(query), char_bigrams(text)) * 0.28 + phrase_hit(query, text) * 0.10
    return lexical if semantic is None else F.when(semantic.isNotNull(), lexical * 0.58 + semantic * 0.42).otherwise(lexical)


def keyword_coverage(merged: Column, words: Column, profile: Profile = REGULATIONS) -> Column:
    stop = F.array(*map(F.lit, profile.question_stopwords))
    counted = F.filter(F.transform(words, fold), lambda k: (F.length(k) >= 2) & ~F.array_contains(stop, k))
    return F.when((F.size(counted) == 0) | blank(merged), 0.0).otherwise(F.size(F.filter(counted, lambda k: F.contains(merged, k))) / F.size(counted))


def strong_title(question: Column, title: Column) -> Column:
    """The title holds the question, or ten characters of it in a row."""
    q, t = dense(fold(question)), dense(fold(title))
    return (F.length(q) >= 8) & (F.length(t) >= 8) & (F.contains(t, q) | F.exists(grams(q, 10), lambda g: F.contains(t, g)))


def law_form(merged: Column, doc_type: Column, attachment_type: Column, profile: Profile = REGULATIONS) -> Column:
    return (
        F.when(has_any(merged, profile.form_words), 0.05).otherwise(0.0) - F.when(has_any(merged, profile.annex_words), 0.05).otherwise(0.0)
        - F.when(has_any(fold(doc_type), ("attachment", "附件")), 0.03).otherwise(0.0) - F.when(has_any(fold(attachment_type), ("reference", "参考")), 0.04).otherwise(0.0)
    )


def ratio_cue(folded: Column, profile: Profile = REGULATIONS) -> Column:
    return folded.rlike(profile.ratio_cue)


def manifest_path(path: Column) -> Column:
    return F.lower(filled(path)).rlike(r"(list|list_new|list_sorted)\.txt$")


def tune_rules(question: Column, intent: Column, words: Column, number: Column, row: dict[str, Column], profile: Profile = REGULATIONS) -> dict[str, Column]:
    """Each rule of the re-scoring as a column of its own. ``row``: path, region, law, article, doc_no, snippet, body, doc_type, attachment_type, summary, scanned, garbled."""
    on = lambda test, plus, minus=0.0: F.when(test, F.lit(plus)).otherwise(F.lit(minus))
    merged = fold(F.concat_ws(" ", row["law"], row["snippet"], row["body"]))
    asked, kind, pair = fold(question), kinds(question, profile), compare_pair(question, profile)
    cov = keyword_coverage(merged, words, profile)
    has = lambda *w: has_any(merged, w)
    law = fold(row["law"])
    target_law, target_article = fold(intent["target_law"]), fold(intent["target_article"])
    named = bare_number(F.concat_ws(" ", row["doc_no"], row["snippet"], row["law"]))
    left, right = has_token(merged, fold(pair["left"])), has_token(merged, fold(pair["right"]))
    place = fold(F.concat_ws(" ", row["region"], row["law"], row["snippet"]))
    national, local = has_any(place, profile.national_words), has_any(place, profile.local_words)
    cue = F.lit(0.0)
    for name, cues, plus in profile.intent_cues:
        cue = cue + on((intent["intent_type"] == name) & has_any(merged, cues), plus)
    length = F.length(dense(row["body"]))
    return {
        "title_match": on(kind["title_style"] & strong_title(question, row["law"]), 0.34),
        "coverage": F.least(F.lit(0.14), cov * 0.16) - on(cov < 0.16, 0.07),
        "domestic": F.when(~F.contains(asked, F.lit("本国产品")), 0.0).when(has("本国产品"), 0.18 + on(has("价格扣除", "评审优惠", "优惠"), 0.06)).when(has("中小企业"), -0.22).otherwise(-0.18),
        "ratio": F.when(kind["ratio"], on(ratio_cue(merged, profile), 0.22, -0.14) - on(has("争议处理", "监督检查", "投诉处理", "附件"), 0.08)).otherwise(0.0),
        "method": F.when(kind["method"], on(has("采购方式", "采用以下方式", "方式包括"), 0.16) + on(has_any(merged, profile.methods), 0.24) + on(F.contains(law, F.lit("政府采购法")), 0.28) - on(has("ppp", "社会资本合作", "政府和社会资本合作项目"), 0.10)).otherwise(0.0),
        "intent": cue,
        "target_law": on((target_law != "") & F.contains(law, F.replace(target_law, F.lit("中华人民共和国"), F.lit(""))), 0.22),
        "target_article": F.when(target_article == "", 0.0).when(~blank(row["article"]) & (fold(row["article"]) == target_article), 0.32).when(F.contains(merged, target_article), 0.10).otherwise(-0.12),
        "doc_number": F.when(number == "", 0.0).otherwise(on((named != "") & F.contains(named, number), 0.42, -0.16)),
        "compare": F.when(pair.isNull(), 0.0).otherwise(F.when(left & right, 0.13).when(left | right, -0.08).otherwise(-0.14) - on(has_any(asked, ("适用边界", "适用范围", "适用情形")) & ~has("适用", "情形", "条件", "范围"), 0.08)),
        "law_form": law_form(fold(F.concat_ws(" ", row["law"], row["snippet"])), row["doc_type"], row["attachment_type"], profile),
        "region": F.when(kind["regional"], on(local, 0.10, -0.03)).otherwise(on(national, 0.11) - on(local, 0.08)),
        "flags": -(on(row["summary"], 0.18) + on(row["scanned"], 0.06) + on(row["garbled"], 0.12)),
        "length": -(F.when(length < 40, 0.42).when(length < 120, 0.14).otherwise(0.0) + F.when(length > 1500, F.least(F.lit(0.18), (length - 1500) / 4200.0)).otherwise(0.0)),
        "manifest": -on(manifest_path(row["path"]), 0.55),
    }


def tuned(base: Column, rules: dict[str, Column]) -> Column:
    total = base
    for c in rules.values():
        total = total + c
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
