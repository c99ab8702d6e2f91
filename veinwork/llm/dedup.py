"""MinHash near-duplicate detection.

One pass over the texts gives each row its number of distinct shingles, a 128-bit fingerprint of the set, and a SuperMinHash signature. Equal sets
form a class at once, whatever the rows' ids; the rest works on classes, by numbers of their own. Bands of the signature deal the classes into buckets. In
each bucket every member is paired with one hub, the member that meets most others over all its buckets (of near copies of one text
that is as a rule the text itself), so a bucket of n gives n pairs. Pairs are confirmed on the full sets, and union-find
(star contraction, distributed) joins what is linked. What lies outside the largest component of its hub's group is then compared with the whole group
on the full sets where their sizes allow a link, block by block, a block small enough for one task; only rows that link components leave the task. Joins on a group's key are salted, so that a large group is
dealt to many tasks. Last, members of a bucket that are neither of one component
nor of one hub are compared by signature; of each, the nearest partners are confirmed, and
rounds follow until nobody has partners left. So no link between documents that share a band is lost, and no group is ever expanded
into all its pairs of rows.

What can be missed: with 200 ranks in 40 bands of 5, a pair at similarity 0.85 shares no band with probability 7e-11, at 0.8 with 1e-7. In the last step a pair whose
signatures agree ``SIGMAS`` standard deviations less than the threshold demands is not looked at: 4e-11 of the pairs at the threshold, none that the steps before find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veinwork.llm.components import components
from veinwork.llm.scratch import drop, map_arrow, stage, table
from veinwork.llm.words import mix, shingle_hashes, slices

BANDS, ROWS = 40, 5
#: Members of a bucket that one block has, and partners that a row sends on in the first round.
BLOCK, PARTNERS = 256, 8
#: Parts that the rows of one group are dealt to in a join on the group's key.
SALT = 32
#: Agreeing ranks are so many standard deviations below the threshold before a pair is left out unverified.
SIGMAS = 6.5

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 48) - 1)


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit hashes: ``m`` values of 64 bits.

    Element by element, a random permutation of the m places is drawn (Fisher-Yates) and its j-th place gets the
    value j + u with u in [0, 1); a place keeps the least value offered. One element's ranks are thus a permutation, not independent,
    which lowers the variance. All elements are advanced together, a rank j at a time, and it stops early at the
    first j that no place can still profit from. Values are fixed point: j in the upper 16 bits, u in the lower 48.
    """
    sig = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    n = len(elements)
    if not n:
        return sig
    places, row, state = None, None, elements
    for j in range(m):
        state = state + _STEP
        draw = mix(state)
        k = j + ((draw >> np.uint64(48)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        if j == 0:
            at = first = k
        else:
            if places is None:
                row = np.arange(n)
                places = np.empty((n, m), np.int16)
                places[:] = np.arange(m, dtype=np.int16)
                places[row, first] = 0
                places[:, 0] = first
            at = places[row, k]
            places[row, k] = places[:, j]
            places[:, j] = at
        np.minimum.at(sig, at, (np.uint64(j) << np.uint64(48)) | (draw & _LOW))
        if int(sig.max()) >> 48 <= j:
            break
    return sig


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    acc = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for r in range(rows):
        acc = mix(acc ^ sig[r : bands * rows : rows]) + np.uint64(r)
    return acc.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    types = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, f1, f2, keys, sigs = [], [], [], [], []
            known: dict[tuple, tuple] = {}  # copies in one slice are sketched once
            for s in shingle_hashes(batch.column("text"), width):
                n.append(len(s))
                a, b = int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ _STEP).sum(dtype=np.uint64))
                if (len(s), a, b) not in known:
                    sig = superminhash(s, bands * rows)
                    known[len(s), a, b] = (bands_of(sig, bands, rows), mix(sig).astype(np.uint8).tobytes())
                f1.append(a)
                f2.append(b)
                k, g = known[len(s), a, b]
                keys.append(k)
                sigs.append(g)
            flat = np.concatenate(keys)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), lists, pa.array(sigs, pa.binary())], schema=types)

    return run, "doc_id bigint, text_key bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, sig binary"


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = list(shingle_hashes(batch.column("text"), width))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "hashes"])

    return run, "id bigint, hashes array<bigint>"


def _fits(n: Column, o: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n, o) * 100 >= F.greatest(n, o) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked for."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    same = F.size(F.array_intersect("ha", "hb"))
    return both.where(same * 100 >= (F.size("ha") + F.size("hb") - same) * percent).select("a", "b")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys``, one at a time, from a stream that is sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        codes = [held.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
        ends = [0, *cut.tolist()]
        for x, y in zip(ends, ends[1:]):
            yield held.slice(x, y - x)
        held = held.slice(ends[-1])
    if held is not None and held.num_rows:
        yield held


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = group.column("side").to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _likely(percent: int, places: int, partners: int):
    """For each row on the one side of a block pair, the rows on the other, of another component and group, whose signatures agree enough: the nearest ``partners``."""
    t = percent / 100
    least = places * t - SIGMAS * (places * t * (1 - t)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, bool]] = []
        for g in groups(batches, ["key", "i", "j"]):
            x, y = _sides(g)
            if not len(x) or not len(y):
                continue
            id_, n, component, hub = (g.column(k).to_numpy() for k in ("id", "n", "component", "hub"))
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(-1, places)
            for i in x.tolist():
                o = y[(component[y] != component[i]) & (hub[y] != hub[i]) & (np.minimum(n[y], n[i]) * 100 >= np.maximum(n[y], n[i]) * percent)]
                if len(o):
                    agree = (sig[o] == sig[i]).sum(axis=1)
                    o, agree = o[agree >= least], agree[agree >= least]
                    keep = o if len(o) <= partners else o[np.argsort(-agree, kind="stable")[:partners]]
                    found += [(int(id_[i]), int(id_[j]), len(o) > partners) for j in keep.tolist()]
            if len(found) > 10_000:
                yield _rows(found)
                found = []
        yield _rows(found)

    return run, "a bigint, b bigint, more boolean"


def _rows(found: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.bool_())], names=["a", "b", "more"])


def _exact(percent: int):
    """For each row on the one side of a block pair, one row of each other component on the other side that it is linked to, by the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, bool]] = []
        for g in groups(batches, ["hub", "i", "j"]):
            x, y = _sides(g)
            if not len(x) or not len(y):
                continue
            id_, component = g.column("id").to_numpy(), g.column("component").to_numpy()
            lists = g.column("hashes").combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            ends = lists.offsets.to_numpy()
            flat, size = lists.values.to_numpy(), np.diff(ends)
            theirs = np.concatenate([flat[ends[j] : ends[j + 1]] for j in y.tolist()])
            owner = np.repeat(np.arange(len(y)), size[y])
            order = np.argsort(theirs, kind="stable")
            theirs, owner = theirs[order], owner[order]
            for i in x.tolist():
                fits = np.minimum(size[y], size[i]) * 100 >= np.maximum(size[y], size[i]) * percent
                if not (fits & (component[y] != component[i])).any():
                    continue
                mine = flat[ends[i] : ends[i + 1]]
                lo, hi = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine, "right")
                many = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                same = np.bincount(owner[at], minlength=len(y))
                linked = np.flatnonzero((same * 100 >= (size[i] + size[y] - same) * percent) & (component[y] != component[i]))
                _, first = np.unique(component[y[linked]], return_index=True)
                found += [(int(id_[i]), int(id_[y[j]]), False) for j in linked[first].tolist()]
            if len(found) > 10_000:
                yield _rows(found)
                found = []
        yield _rows(found)

    return run, "a bigint, b bigint, more boolean"


def _block_pairs(rows: DataFrame, key: str, block: int) -> DataFrame:
    """In each ``key`` with more than one component, the members outside its largest component (side 0) against all its members (side 1), in blocks
    of about ``block``: rows with the block numbers i, j and the side. A member is repeated once for each block of the other side."""
    parts = rows.groupBy(key, "component").agg(F.count("*").alias("own"))
    main = parts.groupBy(key).agg(F.sum("own").alias("all"), F.max(F.struct("own", (-F.col("component")).alias("main"))).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    main = main.select(key, (-F.col("top.main")).alias("main"), F.ceil(F.col("all") / block).cast("int").alias("nj"), F.ceil((F.col("all") - F.col("top.own")) / block).cast("int").alias("ni"))
    got = _salted(rows, main, key)
    spread = F.xxhash64("id")
    them = got.withColumn("side", F.lit(1)).withColumn("j", F.pmod(spread, F.col("nj")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)))
    some = got.where("component <> main").withColumn("side", F.lit(0)).withColumn("i", F.pmod(spread, F.col("ni")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)))
    return them.unionByName(some).drop("main", "ni", "nj")


def _salted(rows: DataFrame, groups_: DataFrame, key: str) -> DataFrame:
    """The rows joined with the one row of ``groups_`` for their ``key``; the rows of one key go to ``SALT`` parts, to each of which its row is copied."""
    many = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    one = groups_.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.join(one, [key, "_salt"]).drop("_salt")


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
    block: int = BLOCK, partners: int = PARTNERS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document: the set's size, the smallest doc_id that it
    reaches over links of similarity ``percent`` / 100 or more, and whether that is itself.

    Defined results: documents without words (null, empty, white space) have 0 shingles and are linked with nothing;
    texts under ``width`` words are one shingle. Rows with one doc_id twice count as two documents of that id, with the same or with different texts. A row with a null
    doc_id is linked like others: its component is the smallest id that it reaches, or null; where its group has no id at all, one of its rows is kept, else none of those without.
    Columns other than doc_id and text are ignored; an empty table gives an empty result.
    """
    return _labelled(docs, width, percent, bands, rows, block, partners).select("doc_id", "n_shingles", "component_id", "kept")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key that equal ids and texts share."""
    return docs.withColumn("_text_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))


def _labelled(docs: DataFrame, width: int, percent: int, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, partners: int = PARTNERS) -> DataFrame:
    """As ``near_duplicates``, with ``text_key`` and ``first``: whether the row is the one that stands for its group."""
    docs = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).withColumnRenamed("_text_key", "text_key")
    run, schema = _sketch(width, bands, rows)
    sketch = stage(map_arrow(docs, run, schema).withColumn("row", F.monotonically_increasing_id()), "sketch")

    # Classes of equal sets, numbered; the first row stands for each: that with the smallest id, those without an id last.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_key")
    classes = stage(sketch.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(order).alias("first")).withColumn("id", F.monotonically_increasing_id()), "classes")
    banded = sketch.select("row", "bands").join(classes.select(F.col("first.row").alias("row"), "id", "n"), "row").select("id", "n", F.explode("bands").alias("key"))
    busy = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = stage(banded.join(busy, "key"), "buckets")
    degree = members.groupBy("id").agg(F.sum("c").alias("degree"))
    ranked = members.join(degree, "id")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), F.col("n").alias("hub_n"))).alias("hub"))
    met = members.join(hubs, "key").select("id", "n", "hub")
    star = met.select("id", "n", (-F.col("hub.minus")).alias("hub"), "hub.hub_n").where(F.col("id") != F.col("hub"))
    pairs = stage(star.where(_fits(F.col("n"), F.col("hub_n"), percent)).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    main_hub = stage(met.groupBy("id").agg(F.max("hub").alias("hub"), F.first("n").alias("n")).select("id", "n", (-F.col("hub.minus")).alias("hub")), "hubs")

    # The sets of the classes that share a bucket, from the texts of their first rows; texts that come again with the same id are read once.
    run, schema = _sets(width)
    read = classes.join(main_hub, "id", "left_semi").select(F.col("first.text_key").alias("text_key"), "id")
    sets = stage(map_arrow(docs.join(read, "text_key").dropDuplicates(["text_key", "id"]).select("id", "text"), run, schema), "sets")
    found = stage(_confirmed(pairs, sets, percent), "links")
    links, linked = found, components(found)

    # Members of one hub that are not of one component yet: compared on the full sets.
    grouped = main_hub.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")).select("hub", "id", "component")
    run, schema = _exact(percent)
    dealt = _block_pairs(grouped, "hub", block).join(sets, "id")
    near = map_arrow(dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j"), run, schema)
    more = stage(near.select("a", "b").distinct(), "links")
    if not more.isEmpty():
        links = links.union(more)
        linked = components(links)

    # Members of one bucket that are neither of one component nor of one hub: likely pairs by signature, then confirmed.
    sigs = sketch.select("row", "sig").join(classes.select(F.col("first.row").alias("row"), "id"), "row").select("id", "sig")
    owned = members.select("key", "id").join(main_hub, "id")
    while True:
        named = owned.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
        run, schema = _likely(percent, bands * rows, partners)
        dealt = _block_pairs(named, "key", block).join(sigs, "id")
        near = stage(map_arrow(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, schema), "near")
        count = near.agg(F.count("*").alias("n"), F.max("more").alias("more")).first()
        if not count["n"]:
            break
        more = stage(_confirmed(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent), "links")
        if not more.isEmpty():
            links = links.union(more)
            linked = components(links)
        drop(near)
        if not count["more"]:
            break
        partners *= 8

    # Each group's first row, over its classes.
    of_class = classes.join(linked, "id", "left").withColumn("group", F.coalesce("component", "id"))
    firsts = of_class.groupBy("group").agg(F.min("first").alias("of_group"))
    named = stage(of_class.join(firsts, "group").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("gn"), F.col("of_group.doc_id").alias("component_id"), F.col("of_group.row").alias("first_row")), "named")
    drop(members, pairs, main_hub, sets)
    out = sketch.select("doc_id", "text_key", "row", "n", "f1", "f2").join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("gn")), "left")
    alone = F.col("first_row").isNull()  # no words
    first = alone | (F.col("row") == F.col("first_row"))
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, first & F.col("doc_id").isNull() & component.isNull()).alias("kept"), "text_key", first.alias("first"), (~alone).alias("words"))


def deduplicate(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, of rows with equal ids one, rows without an id only where no other has one.
    Documents without words all stay. Of rows with the same id and text, any one stays (they may differ in other columns only)."""
    marks = _labelled(docs, width, percent).where("words").groupBy("text_key").agg(F.max("first").alias("stays"), F.count("*").alias("times"))
    marks = stage(marks.where("not stays or times > 1").select(F.col("text_key").alias("_text_key"), F.col("stays").alias("_stays")), "copies")
    names = docs.columns
    left = _keyed(docs).join(marks, "_text_key", "left").where("coalesce(_stays, true)")
    again = marks.where("_stays").select("_text_key")
    if again.isEmpty():
        return left.select(*names)
    single = left.where("_stays").dropDuplicates(["_text_key"]).select(*names)
    return left.where("_stays is null").select(*names).union(single)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by three-word shingles at a similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


ORACLE = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) as g from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as here from documents union select r.id, e.b from r join e on r.here = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from documents d left join n on n.doc_id = d.doc_id join (select id, min(here) as c from r group by id) m on m.id = d.doc_id"""
