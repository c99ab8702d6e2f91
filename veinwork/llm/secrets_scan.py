"""Secret scans, in DataFrame functions only.

Three fixed patterns give the base spans: assignments to a secret's name, access keys and hex strings. Besides, every run of token
characters is a candidate for a secret of unknown form: a window slides over it, and the Shannon entropy of the window is kept
up to date from incremental counts (the entering character raises one count, the leaving one lowers another). A
candidate is a secret if some window reaches the threshold of its character class (hexadecimal, mixed case with digits, lower or upper case with
digits) and no entry of the allow-list suppresses it. Runs of letters alone, or of digits alone, are never candidates. The allow-list never touches base spans.

Entropy is held as the integer sum of ``round(10^6 * c * log2 c)`` over the window's counts c, so that adding and taking
away is exact and the result does not depend on the order.

Defined results: null and empty texts have no spans. Positions are code points, the end exclusive. Each row is judged alone: repeated rows and ids stay,
a null doc_id is kept, and columns other than the id and the text are ignored. A long text costs time in proportion
to its length and its matches: running sums over n matches go block by block, not by copying a growing list, and a long candidate is scanned in segments that overlap by a window.
Among spans of one start, the order is that of the kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veinwork.llm.scratch import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Kind, pattern, group that is measured, its least length.
BASE = [("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16)]

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes in the order in which they are tried: name, pattern of the whole candidate, least entropy in bits.
CLASSES = [
    ("hex", r"^(?:[0-9a-f]*[0-9][0-9a-f]*|[0-9A-F]*[0-9][0-9A-F]*)$", 3.0),
    ("mixed", r"^.*[0-9].*$", 3.6),
    ("single", r"^.*[0-9].*$", 3.9),
]
#: Candidates in which one of these occurs are no secrets.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i:example|placeholder|changeme|dummy|sample|xxxx)",
    r"^[0-9+/_=-]+$",
    r"^(?:https?|www)",
]
_UNIT = 1_000_000
#: Values of one block of a running sum, characters of one segment of a candidate, characters of one piece of a text that is cut.
_BLOCK, _SEGMENT, _PIECE = 64, 256, 1024
GAIN = [0, *(round(_UNIT * c * math.log2(c)) for c in range(1, WINDOW + 1))]


def most(bits: float) -> int:
    """The largest sum over a window whose entropy is at least ``bits``."""
    return round(_UNIT * WINDOW * (math.log2(WINDOW) - bits))


def once(x: Column, f) -> Column:
    """f(x), with x worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def before(values: Column, op) -> Column:
    """array<bigint>: for each value what the associative ``op`` makes of all before it, 0 at first. Blocks are summed up, then block starts, then values within their block: a state
    that grew with the list would be copied at every step, and so would a slice of the list."""
    fold = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), op)
    first = lambda x, n: F.slice(x, F.lit(1), n)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(_BLOCK)), lambda b: F.transform(F.sequence(b, F.least(b + _BLOCK, F.size(v)) - 1), lambda i: F.get(v, i)))
    within = lambda blocks, at: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x, i: op(F.get(at, k), fold(first(b, i))))))
    starts = lambda blocks: once(F.transform(blocks, fold), lambda t: F.transform(t, lambda x, k: fold(first(t, k))))
    every = lambda v: once(cut(v), lambda blocks: once(starts(blocks), lambda at: within(blocks, at)))
    return once(values, lambda v: F.when(F.size(v) > 0, every(v)).otherwise(F.array().cast("array<bigint>")))


def _spans(text: Column, pattern: str, kind: str, order: int, group: int, least: int) -> Column:
    """array<struct<start, ord, end, kind, word>> of the leftmost matches whose group is long enough."""
    item = "struct<start:bigint,ord:int,end:bigint,kind:string,word:string>"
    columns = [F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole")]
    if group:
        columns.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("word"))
    each = F.transform(F.arrays_zip(*columns), lambda x: F.struct(F.length(x["before"]).cast("bigint").alias("skip"), F.length(x["whole"]).cast("bigint").alias("size"), x["word" if group else "whole"].alias("word")))
    each = F.filter(each, lambda x: x["size"].isNotNull())  # what follows the last match
    span = lambda at, x: F.struct((at + x["skip"]).alias("start"), F.lit(order).alias("ord"), (at + x["skip"] + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["word"].alias("word"))
    placed = once(each, lambda e: once(before(F.transform(e, lambda x: x["skip"] + x["size"]), lambda a, b: a + b), lambda at: F.transform(e, lambda x, i: span(F.get(at, i), x))))
    return F.when(text.rlike(pattern), F.filter(placed, lambda x: F.length(x["word"]) >= least)).otherwise(F.array().cast(f"array<{item}>"))


def least_sum(word: Column) -> Column:
    """The least sum over all windows of the candidate: the window of the highest entropy.

    The window's counts are the characters of a string, one place for each of the alphabet; a step replaces two of them."""
    up, down = ([F.lit(v) for v in x] for x in ([b - a for a, b in zip(GAIN, GAIN[1:])], [0, *(a - b for a, b in zip(GAIN, GAIN[1:]))]))
    up, down = F.array(*up), F.array(*down)
    count = lambda counts, place: F.ascii(F.substring(counts, place, F.lit(1))) - 65
    put = lambda counts, place, n: F.overlay(counts, F.char(n + 65), place, F.lit(1))
    start = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("best"))

    def slide(acc: Column, x: Column) -> Column:
        counts, same = acc["counts"], x["enters"] == x["leaves"]
        c, d = count(counts, x["enters"]), count(counts, x["leaves"])
        total = acc["sum"] + F.when(same, 0).otherwise(F.get(up, c) + F.when(x["leaves"] > 0, F.get(down, d)).otherwise(0))
        entered = F.when(same, counts).otherwise(put(F.when(x["leaves"] > 0, put(counts, x["leaves"], d - 1)).otherwise(counts), x["enters"], c + 1))
        return once(total.cast("bigint"), lambda t: F.struct(entered.alias("counts"), t.alias("sum"), F.when(x["full"], F.least(acc["best"], t)).otherwise(acc["best"]).alias("best")))

    def of(segment: Column) -> Column:
        places = F.transform(F.split(segment, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        moves = once(places, lambda p: F.transform(p, lambda e, i: F.struct(e.alias("enters"), F.when(i >= WINDOW, F.get(p, i - WINDOW)).otherwise(0).alias("leaves"), (i >= WINDOW - 1).alias("full"))))
        return F.aggregate(moves, start, slide, lambda acc: acc["best"])

    segments = F.regexp_extract_all(word, F.lit(f"(?=(.{{1,{_SEGMENT}}})).{{1,{_SEGMENT - WINDOW + 1}}}"), F.lit(1))
    return F.array_min(F.transform(segments, of))


def limit_of(word: Column) -> Column:
    """The largest sum that the candidate's class allows; null if it is in none."""
    mixed = word.rlike("[a-z]") & word.rlike("[A-Z]")
    tests = [(word.rlike("^[0-9a-f]+$") | word.rlike("^[0-9A-F]+$")) & word.rlike("[0-9]") & word.rlike("[a-fA-F]"), mixed & word.rlike("[0-9]"), word.rlike("[a-zA-Z]") & word.rlike("[0-9]")]
    out = F.when(tests[0], most(CLASSES[0][2]))
    for test, (_, _, bits) in zip(tests[1:], CLASSES[1:]):
        out = out.when(test, most(bits))
    return out


def _outside(runs: Column, assigned: Column) -> Column:
    """The runs that no base span holds. A run has all token characters around it, so an access key or hex string holds it only if it is the run itself; assignments are
    passed in order, of which the last that began decides, since they don't overlap."""
    own = F.filter(runs, lambda x: ~x["word"].rlike(f"^{HEX}$") & ~x["word"].rlike(f"^{ACCESS[:-1]}{{14,}}$"))
    both = F.array_sort(F.concat(assigned, own))
    ended = lambda x: F.when(x["ord"] == 0, x["end"]).otherwise(0).cast("bigint")
    return once(both, lambda all_: once(before(F.transform(all_, ended), lambda a, b: F.greatest(a, b)), lambda at: F.filter(all_, lambda x, i: (x["ord"] != 0) & (F.get(at, i) < x["end"]))))


def find_secrets(docs: DataFrame, *, text: str = "text", allow: list[str] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``base`` and ``secrets``: the base spans and all spans, ordered by start and kind, as
    array<struct<start, ord, end, kind, word>>."""
    allowed = "|".join(ALLOW if allow is None else allow) or "^$"
    whole = F.coalesce(F.col(text), F.lit(""))
    got = docs.select(*keep, whole.alias("_text"))
    for order, (kind, pattern, group, least) in enumerate(BASE):
        got = got.withColumn(f"_{kind}", _spans(F.col("_text"), pattern, kind, order, group, least))
    runs = F.filter(_spans(F.col("_text"), CANDIDATE, "entropy", len(BASE), 0, WINDOW), lambda x: limit_of(x["word"]).isNotNull() & ~x["word"].rlike(allowed))
    got = got.withColumn("base", F.array_sort(F.concat(*(F.col(f"_{k}") for k, *_ in BASE)))).withColumn("_runs", runs)
    hot = F.filter(_outside(F.col("_runs"), F.col("_assign")), lambda x: least_sum(x["word"]) <= limit_of(x["word"]))
    return got.withColumn("_hot", F.when(F.size("_runs") > 0, hot).otherwise(F.col("_runs"))).select(*keep, F.col("_text"), "base", F.array_sort(F.concat("base", "_hot")).alias("secrets"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, marker: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by the marker (spans that overlap by one), ``n_chars`` counted anew where
    there is such a column. Texts without a secret, null texts among them, stay as they are."""
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")  # whatever its columns are called
    found = find_secrets(docs.select(row, "text"), keep=("_row",))

    def joined(pieces: Column) -> Column:
        def part(a: Column, z: Column) -> Column:
            first, last = F.floor(a / _PIECE).cast("int"), F.floor((z - 1) / _PIECE).cast("int")
            return F.when(z > a, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (a - first * _PIECE + 1).cast("int"), (z - a).cast("int"))).otherwise("")

        piece = lambda at, x: F.when(x["start"] >= at, F.concat(part(at, x["start"]), F.lit(marker))).otherwise("")
        kept = once(before(F.transform("secrets", lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda at: F.transform("secrets", lambda x, i: piece(F.get(at, i), x)))
        return F.concat(F.array_join(kept, ""), part(F.array_max(F.transform("secrets", lambda x: x["end"])), F.length(F.col("_text")).cast("bigint")))

    parts = once(F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), joined)
    hit = F.size("secrets") > 0
    own = {c: F.col("_row").getField(c) for c in names}
    text = F.when(hit, parts).otherwise(own["text"])
    made = {"text": text}
    if "n_chars" in names:
        made["n_chars"] = F.when(hit, F.length(text)).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(made.get(c, own[c]).alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def _sql_base(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""select r, '{kind}' as kind, {order} as ord, s as start, s + length(whole) as end_, word, {least} as least from (
    select *, sum(length(piece)) over w + coalesce(sum(length(whole)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0) as s
    from (select r, unnest(regexp_split_to_array(t, '{p}')) as piece, unnest(regexp_extract_all(t, '{p}', 0)) as whole, unnest(regexp_extract_all(t, '{p}', {group})) as word, unnest(range(1, 1 + length(regexp_split_to_array(t, '{p}')))) as i from docs where regexp_matches(t, '{p}'))
    window w as (partition by r order by i)) where length(word) >= {least}"""


_ANYCASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_SQL_ALLOW = "|".join(ALLOW).replace("(?i:example|placeholder|changeme|dummy|sample|xxxx)", "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "example|placeholder|changeme|dummy|sample|xxxx") + ")")
ORACLE = f"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
base as ({" union all ".join(_sql_base(k, i, p.replace("(?i:password|passwd|secret|token|api_?key)", _ANYCASE), g, n) for i, (k, p, g, n) in enumerate(BASE))}),
runs as ({_sql_base("entropy", len(BASE), CANDIDATE, 0, WINDOW)}),
classed as (select *, case when regexp_matches(word, '{CLASSES[0][1]}') and regexp_matches(word, '[a-fA-F]') then {most(CLASSES[0][2])}
    when regexp_matches(word, '[a-z]') and regexp_matches(word, '[A-Z]') and regexp_matches(word, '[0-9]') then {most(CLASSES[1][2])}
    when regexp_matches(word, '[a-zA-Z]') and regexp_matches(word, '[0-9]') then {most(CLASSES[2][2])} end as most from runs where not regexp_matches(word, '{_SQL_ALLOW}')),
cand as (select * from classed where most is not null and not exists (select 1 from base b where b.r = classed.r and b.start <= classed.start and b.end_ >= classed.end_)),
win as (select r, start, unnest(range(1, length(word) - {WINDOW} + 2)) as i, word from cand),
chars as (select r, start, i, unnest(string_split(substr(word, i, {WINDOW}), '')) as c from win),
sums as (select r, start, i, sum(g) as s from (select r, start, i, c, count(*) as n from chars group by all) join (values {", ".join(f"({c}, {g})" for c, g in enumerate(GAIN))}) v(n, g) using (n) group by all),
hot as (select cand.r, kind, ord, start, end_, word, least from cand join (select r, start, min(s) as s from sums group by all) using (r, start) where s <= most),
every as (select * from base union all select r, kind, ord, start, end_, word, least from hot),
joined as (select r, string_agg(kind || ':' || start || ':' || end_, ',' order by start, ord) filter (where kind <> 'entropy') as b,
    string_agg(kind || ':' || start || ':' || end_, ',' order by start, ord) as a, count(*) filter (where kind = 'assign') as n_assign,
    count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex from every group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
from docs left join joined using (r)"""
