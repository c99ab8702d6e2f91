"""Questions: terms, phrases, keywords, intent."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veinwork.functions.meta import article_no
from veinwork.functions.text import bind, blank, dense, filled, fold, has_any, mostly_digits, squeeze, strip
from veinwork.domain import REGULATIONS, Profile


def grams(c: Column, n: Column | int) -> Column:
    """All substrings of length ``n`` in order, repeats too."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def char_bigrams(c: Column) -> Column:
    """The distinct pairs of characters without white space; a text of one character is its own."""
    return bind(dense(c), lambda t: F.when(F.length(t) < 2, F.array(t)).otherwise(F.array_distinct(grams(t, 2))))


def word_terms(folded: Column, profile: Profile = REGULATIONS) -> Column:
    stop = F.array(*map(F.lit, profile.stopwords))
    words = F.filter(F.split(folded, " "), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    return F.slice(F.array_distinct(words), 1, profile.max_terms)


def gram_terms(compact: Column, low: int, high: int, most: int, profile: Profile = REGULATIONS) -> Column:
    """Substrings, the long ones first, without stop-words and figures."""
    stop = F.array(*map(F.lit, profile.stopwords))
    every = F.concat(*(grams(compact, n) for n in range(high, low - 1, -1)))
    return F.slice(F.array_distinct(F.filter(every, lambda g: ~F.array_contains(stop, g) & ~mostly_digits(g))), 1, most)


def profile_of(question: Column, profile: Profile = REGULATIONS) -> Column:
    """struct<folded, compact, terms, phrases, article> of a question."""

    def with_terms(folded: Column, compact: Column, terms: Column) -> Column:
        long = F.slice(F.filter(terms, lambda t: F.length(t) >= 4), 1, profile.max_phrases)
        phrases = F.when(F.size(long) > 0, long).otherwise(gram_terms(compact, 4, 6, profile.max_phrases, profile))
        return F.struct(folded.alias("folded"), compact.alias("compact"), F.slice(terms, 1, profile.max_terms).alias("terms"), phrases.alias("phrases"), article_no(folded, profile).alias("article"))

    def terms_of(folded: Column, compact: Column) -> Column:
        return F.array_distinct(F.concat(word_terms(folded, profile), gram_terms(compact, 2, 4, profile.max_terms, profile)))

    return bind(fold(question), lambda f: bind(dense(f), lambda c: bind(terms_of(f, c), lambda t: with_terms(f, c, t))))


def fast_terms(question: Column, profile: Profile = REGULATIONS) -> Column:
    """Words, then substrings, the short ones first."""

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, "[^\\p{IsHan}A-Za-z0-9]+"), lambda w: F.length(w) >= 2)
        return F.slice(F.array_distinct(F.concat(words, *(grams(t, n) for n in (2, 3, 4)))), 1, profile.max_fast_terms)

    return bind(squeeze(question), of)


def intent(question: Column, profile: Profile = REGULATIONS) -> Column:
    """struct<normalized, intent_type, target_law, target_article, keywords, retrieval> by rules."""
    q = strip(question)
    for slang in ("啥是", "啥叫"):
        q = F.replace(q, F.lit(slang), F.lit("什么是"))
    q = F.replace(q, F.lit("啥意思"), F.lit("什么意思"))
    low = F.lower(q)
    kind = None
    for name, words in profile.intents:
        kind = F.when(has_any(low, words), name) if kind is None else kind.when(has_any(low, words), name)
    law = F.when(F.contains(low, F.lit("政府采购法")), "中华人民共和国政府采购法").when(F.contains(low, F.lit("实施条例")), "中华人民共和国政府采购法实施条例").otherwise("")
    words = F.slice(F.array_distinct(F.filter(F.split(low, "[\\s，。！？、,.!?;；:：]+"), lambda w: F.length(w) >= 2)), 1, 12)
    retrieval = F.when(q == "", filled(question)).otherwise(strip(F.concat_ws(" ", q, F.array_join(F.slice(words, 1, 6), " "))))
    return F.struct(q.alias("normalized"), kind.otherwise("OTHER").alias("intent_type"), law.alias("target_law"), article_no(low, profile).alias("target_article"), words.alias("keywords"), retrieval.alias("retrieval"))


def merged_intent(rules: Column, reply: Column, profile: Profile = REGULATIONS) -> Column:
    """The intent by rules, overridden field by field by a model's JSON reply, if that can be read."""
    raw = F.regexp_extract(filled(reply), r"(?s)(\{.*\})", 1)
    j = F.from_json(raw, "intent_type string, normalized_question string, target_law string, target_article string, keywords array<string>")
    kind = F.upper(strip(j["intent_type"]))
    first = lambda a, b: F.when(~blank(a), strip(a)).otherwise(b)
    words = F.slice(F.array_distinct(F.filter(F.concat(rules["keywords"], F.coalesce(F.transform(j["keywords"], strip), F.array().cast("array<string>"))), lambda k: ~blank(k))), 1, 16)
    better = F.struct(
        first(j["normalized_question"], rules["normalized"]).alias("normalized"), F.when(j["intent_type"].isNull() | ~kind.isin("DEFINITION", "PROCESS", "CONDITION", "PENALTY", "OTHER"), F.lit("OTHER")).otherwise(kind).alias("intent_type"),
        first(j["target_law"], rules["target_law"]).alias("target_law"), first(article_no(j["target_article"], profile), rules["target_article"]).alias("target_article"), words.alias("keywords"),
        strip(F.concat_ws(" ", first(j["normalized_question"], rules["normalized"]), F.array_join(F.slice(words, 1, 6), " "))).alias("retrieval"),
    )
    return F.when(j.isNull() | (raw == ""), rules).otherwise(better)


def method_question(folded: Column) -> Column:
    return F.contains(folded, F.lit("采购")) & has_any(folded, ("几种", "多少种", "方式"))


def keywords(question: Column, own: Column, profile: Profile = REGULATIONS) -> Column:
    """The intent's keywords, the question's words and what the field says otherwise; substrings if there are none."""
    folded = fold(question)
    stop = F.array(*map(F.lit, profile.question_stopwords))
    words = F.filter(F.split(folded, " "), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    given = F.filter(F.transform(own, fold), lambda k: F.length(k) >= 2)
    extra = lambda test, *w: F.when(test, F.array(*map(F.lit, w))).otherwise(F.array().cast("array<string>"))
    more = F.concat(
        extra(F.contains(folded, F.lit("减免")), "扣除", "优惠", "价格扣除", "评审优惠"),
        extra(F.contains(folded, F.lit("本国产品")), "本国产品标准", "声明函", "组件成本"),
        extra(has_any(folded, ("20", "二十")), "20%", "20％", "百分之二十"),
        extra(method_question(folded), "采购方式", *profile.methods, "政府采购法", "第二十六条"),
    )
    every = F.array_distinct(F.concat(given, words, more))
    t = dense(folded)
    return F.slice(F.when(F.size(every) > 0, every).otherwise(F.array_distinct(F.concat(*(grams(t, n) for n in (4, 3, 2))))), 1, 20)


def enriched_query(query: Column, question: Column, profile: Profile = REGULATIONS) -> Column:
    folded = fold(question)
    return strip(
        F.concat(
            filled(query), F.when(F.contains(folded, F.lit("减免")), " 价格扣除 评审优惠 优惠").otherwise(""), F.when(F.contains(folded, F.lit("本国产品")), " 本国产品标准 声明函 组件成本").otherwise(""),
            F.when(has_any(folded, ("20", "二十")), " 20% 20％ 百分之二十").otherwise(""), F.when(method_question(folded), F.lit(" 政府采购法 第二十六条 采购方式 " + " ".join(profile.methods))).otherwise(""),
        )
    )


def compare_pair(question: Column, profile: Profile = REGULATIONS) -> Column:
    """struct<left, right> of a question that compares two things; null if it doesn't."""
    t = dense(question)

    def term(i: int) -> Column:
        x = strip(F.regexp_extract(t, profile.compare, i))
        x = F.regexp_replace(x, "^(请解释|解释|说明|请按法规依据说明|请按依据说明|请按法规说明)", "")
        return strip(F.regexp_replace(F.regexp_replace(x, "^(在[\\u4e00-\\u9fa5]{1,8}，)", ""), "(的|之)$", ""))

    return F.when((F.length(term(1)) >= 2) & (F.length(term(3)) >= 2), F.struct(term(1).alias("left"), term(3).alias("right")))


def kinds(question: Column, profile: Profile = REGULATIONS) -> Column:
    """struct of what a question is: broad, compare, ratio, definition, method, title_style, regional."""
    n = fold(question)
    title = has_any(n, ("关于", "印发", "转发")) & has_any(n, profile.title_words)
    ratio = has_any(n, profile.ratio_words) | (F.contains(n, F.lit("20")) & F.contains(n, F.lit("价格")))
    return F.struct(
        has_any(n, profile.broad).alias("broad"), (F.contains(n, F.lit("与")) & has_any(n, ("适用边界", "区别", "差异", "关系", "比较"))).alias("compare"), ratio.alias("ratio"),
        has_any(n, ("什么是", "是什么", "是指", "定义", "概念", "含义")).alias("definition"), method_question(n).alias("method"), title.alias("title_style"), has_any(n, profile.region_words).alias("regional"),
    )
