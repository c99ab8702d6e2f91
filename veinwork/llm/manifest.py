"""Merkle manifest of a dataset: a tree over each source's documents, a tree over the sources' roots, and a proof for every document.

Each document becomes a leaf digest. Leaves get their place in their source from a range partitioning and running counts of partitions, so that a source
of any size is dealt to many tasks. The digits of the place in base 16 are then grouped away one after the other, the lowest first: the 16 nodes that
differ in one digit only become an array of structs, its digest the parent's, and the parent a struct that holds its children. This goes on for ``DIGITS`` digits, so a row (a block)
never holds more than 16 ** DIGITS leaves, whatever the source's size; a block's root is a node of the next round, until each source has one. The sources' roots go through the same rounds.

Proofs come from the nested rows: level by level, ``transform`` gives each child its siblings to the left and to the right, ``explode`` makes the children rows, and the path grows by one
step. No leaf is joined with anything; only a block (one row for 256 leaves) is joined with the path above it, since a source in one row would be unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veinwork.llm.scratch import drop, stage, table

FAN, DIGITS = 16, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """``-`` for null, else the value with its number of UTF-8 bytes before it."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _level_size(size: Column, levels: int) -> Column:
    """Nodes of a tree of ``size`` leaves, so many levels up."""
    return F.ceil(size / F.lit(FAN**levels))


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with pos, the place (from 0) in the row's group ``g`` by ``order``, and size, the group's rows. Rows that are equal in all of these are interchangeable."""
    keys = [F.asc_nulls_first(c) for c in ("g", *order, "_tie")]
    sorted_ = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    at = stage(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "placed")
    runs = at.groupBy("g", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))  # a partition's rows of one group stand together
    own = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "_part", (before - F.col("first")).alias("_move"), F.sum("n").over(own).alias("size"))
    out = at.join(runs, ["g", "_part"]).withColumn("pos", F.col("_at") + F.col("_move")).drop("_at", "_move", "_part")
    out._rests_on = at
    return out


def _rolled_up(nodes: DataFrame, *own: str) -> DataFrame:
    """The blocks (g, size, pos, h, kids) of nodes (g, size, pos, h and the columns ``own``): ``kids`` nests all nodes of a block, ``h`` is its root."""
    digit = lambda d: F.pmod(F.floor(F.col("pos") / FAN**d), F.lit(FAN)).cast("int")
    upper = [f"d{d}" for d in range(1, DIGITS)]
    got = nodes.select("g", "size", F.floor(F.col("pos") / FAN**DIGITS).alias("block"), *(digit(d).alias(f"d{d}") for d in range(1, DIGITS)), F.struct(digit(0).alias("d"), "h", *own).alias("kid"))
    got = got.repartition("g", "block")  # one shuffle: all further keys hold these two
    for d in range(DIGITS):
        got = got.groupBy("g", "size", "block", *upper[d:]).agg(F.sort_array(F.collect_list("kid")).alias("kids"))
        alone = _level_size(F.col("size"), d) == 1
        h = F.when(alone, F.col("kids")[0]["h"]).otherwise(F.sha2(F.array_join(F.col("kids.h"), ""), 256))
        if d < DIGITS - 1:
            got = got.select("g", "size", "block", *upper[d + 1 :], F.struct(F.col(upper[d]).alias("d"), h.alias("h"), "kids").alias("kid"))
    return got.select("g", "size", F.col("block").alias("pos"), h.alias("h"), "kids")


def _rounds(nodes: DataFrame, *own: str) -> list[DataFrame]:
    """Blocks of blocks, each round a table, until every group has one; the first is over the nodes themselves."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    out = [stage(_rolled_up(nodes, *own), "blocks")]
    while (most := -(-most // FAN**DIGITS)) > 1:
        up = out[-1].select("g", _level_size(F.col("size"), DIGITS).alias("size"), "pos", "h")
        out.append(stage(_rolled_up(up), "blocks"))
    return out


def _unrolled(blocks: DataFrame, above: DataFrame, *own: str) -> DataFrame:
    """The nodes of ``blocks`` with their path: ``above`` (g, pos, path, and what else goes to all below) of the blocks, then a step for each level."""
    rest = [c for c in above.columns if c not in ("g", "pos", "path")]
    got = blocks.select("g", "pos", "size", "kids").join(above, ["g", "pos"])
    for d in reversed(range(DIGITS)):
        run = lambda hs, a, n: F.array_join(F.slice(hs, a, n), "")
        sided = F.transform("kids", lambda k, i: F.struct(k.alias("kid"), F.struct(run(F.col("kids.h"), F.lit(1), i).alias("l"), run(F.col("kids.h"), i + 2, F.lit(FAN)).alias("r")).alias("step")))
        got = got.select("g", "size", "pos", "path", *rest, F.explode(sided).alias("x"))
        path = F.when(_level_size(F.col("size"), d) == 1, F.col("path")).otherwise(F.concat(F.array("x.step"), F.col("path")))
        kids = ["x.kid.kids"] if d else ["x.kid.h", *(f"x.kid.{c}" for c in own)]
        got = got.select("g", "size", (F.col("pos") * FAN + F.col("x.kid.d")).alias("pos"), path.alias("path"), *rest, *kids)
    return got


def _all_down(rounds: list[DataFrame], above: DataFrame, *own: str) -> DataFrame:
    for k in reversed(range(len(rounds))):
        above = _unrolled(rounds[k], above, *(own if k == 0 else ()))
        if k:
            above = above.drop("size", "h")
    return above


def manifest(docs: DataFrame, tampered: Column, tamper: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``verified`` says whether the leaf and its proof lead to the root; where ``tampered`` holds, the leaf is worked out with ``tamper`` in place of the text.

    Defined results: null and empty values have leaves of their own (``-`` and ``0:``); texts of any length are hashed whole. Rows without a doc_id come first in their source,
    rows with equal ids go by their leaf; equal rows have the same leaf, each a place of its own. A source of one row has that leaf as its root. Columns
    other than the five are ignored, whatever their names; an empty table gives an empty result.
    """
    parts = lambda text: digest(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text))
    source = F.col("source").cast("string")
    rows = docs.select(
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("g"), "doc_id", parts(F.col("text")).alias("h"), F.when(tampered, parts(tamper)).alias("changed"),
    )
    leaves = _placed(rows, "doc_id", "h")
    trees = _rounds(leaves, "doc_id", "changed")
    drop(leaves._rests_on)
    tops = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "h")
    sources = _placed(tops, "source")
    top = _rounds(sources, "source")
    drop(sources._rests_on)

    path = F.array().cast("array<struct<l:string,r:string>>")
    of_sources = _all_down(top, top[-1].select("g", "pos", path.alias("path"), F.col("h").alias("root")), "source")
    above = of_sources.select(F.col("source").alias("g"), F.lit(0).cast("bigint").alias("pos"), "path", "root", F.col("h").alias("subroot"))
    out = _all_down(trees, above, "doc_id", "changed")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("changed", "h"), lambda h, s: digest(s["l"], h, s["r"]))
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; every fifth one, by its id's checksum, with its letters A-Z in lower case."""
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return manifest(table(spark, sf_dir, "documents"), fifth, F.translate("text", UPPER, LOWER))


_FIELD = "coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x=c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
#: Trees over (g, pos, n, h): all nodes by level. A group's nodes go up while it has more than one.
_TREE = """select 0 as level, g, pos, n, h from {leaves} union all
    select level + 1, g, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from {me} where n > 1 group by level, g, pos // 16, n"""
_STEPS = "select level, g, pos, coalesce(string_agg(h, '' order by pos) over (w rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '' order by pos) over (w rows between 1 following and unbounded following), '') as r from {nodes} where n > 1 window w as (partition by level, g, pos // 16 order by pos)"
ORACLE = f"""with recursive d as (select doc_id, coalesce('=' || source, '') as g, {_LEAF.format(x='text')} as leaf, case when {_CRC} % 5 = 0 then {_LEAF.format(x=f"translate(text, '{UPPER}', '{LOWER}')")} end as changed from documents),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from d),
a as ({_TREE.format(leaves="(select g, pos, n, leaf as h from p)", me='a')}),
s as (select '' as t, g, h, row_number() over (order by g) - 1 as pos, count(*) over () as n from a where n = 1),
b as ({_TREE.format(leaves="(select t as g, pos, n, h from s)", me='b')}),
sa as ({_STEPS.format(nodes='a')}), sb as ({_STEPS.format(nodes='b')}),
ua as (select row_number() over () as id, doc_id, g, pos, leaf, changed from p),
fa as (select id, 0 as level, pos, coalesce(changed, leaf) as f, '' as proof from ua union all select fa.id, fa.level + 1, fa.pos // 16, sha256(l || f || r), proof || l || r from fa join ua using (id) join sa on sa.g = ua.g and sa.level = fa.level and sa.pos = fa.pos),
ta as (select id, arg_max(f, level) as f, arg_max(proof, level) as proof from fa group by id),
ub as (select ua.*, s.pos as spos, s.h as subroot, ta.f, ta.proof from ua join s using (g) join ta using (id)),
fb as (select id, 0 as level, spos as pos, f, proof from ub union all select id, fb.level + 1, fb.pos // 16, sha256(l || f || r), proof || l || r from fb join sb on sb.level = fb.level and sb.pos = fb.pos),
tb as (select id, arg_max(f, level) as f, arg_max(proof, level) as proof from fb group by id)
select doc_id, leaf, subroot, root, sha256(tb.proof) as proof_sha256, tb.f as folded_root, tb.f = root as verified from ub join tb using (id), (select h as root from b where n = 1)"""
