"""Exact Jaccard join of documents on word shingles by T-occurrence search.

Two sets of at least ``percent`` / 100 similarity share an element among the first n - ceil(n percent / 100) + 1 of each, in any common order of all elements (prefix filter). The order here is by
frequency class and hash; frequencies come from a sketch of fixed size over all texts, so errors in them change only the order, never a result. Documents of equal sets are one class. Classes
that share a prefix element form a cluster (union-find over one edge a class and element), so every link lies inside a cluster; within it T-occurrence search finds all links. The members of an element
that is frequent by the sketch are dealt to several tasks first. Elements of few classes give their pairs instead, of which those go that can't be links: sets hold a parity bit for each hash cell, and no fewer elements
differ than bits do. So long texts that happen to share a passage do not run together.

A cluster is cut into cells of bounded size by size band and hash, and only cells whose sizes allow a link meet, each pair of cells in one group of its own; a set is copied to as many groups as its
cell has partners, and no pairs are emitted. In a group the sets of one side are indexed as inverted lists, and each set of the other side looks for those that occur in at least T of its lists (DivideSkip): the L longest
lists are put aside, the short ones merged, what occurs there fewer than T - L times is dropped, and the rest is probed in the long lists by binary search. Out come, for each set, the number of documents it is linked
with and the smallest set of its connected part of the group; union-find over those gives the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veinwork.llm.components import components
from veinwork.llm.dedup import _keyed, groups
from veinwork.llm.scratch import drop, map_arrow, stage, table
from veinwork.llm.words import mix, shingle_hashes, slices

#: Cells of the frequency sketch, parts that they are added up in, and partial sums of each part.
CELLS, PARTS, PARTIAL = 1 << 22, 64, 16
#: Members of an element that one task has, about: more frequent ones are dealt to several.
MEMBERS = 1024
#: An element of so many classes of like size gives all their pairs, to be looked at one by one.
FEW = 8
#: Rows and elements that a cell of a cluster has, about.
CELL_ROWS, CELL_ELEMENTS = 512, 1 << 19
#: Bits of the filter by which a text pass leaves out the sets that no group needs.
WANTED_BITS = 1 << 24
#: Growth of sizes from band to band: a little more than any link at 80 per cent allows, so that linked sets are at most one band apart.
BAND = 1.26
#: The share of a list's logarithm that a probe costs, as in DivideSkip's choice of the number of long lists.
MU = 0.0085

_STEP = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """What a set of ``n`` must share with any set that it is linked to."""
    return -(-n * percent // 100)


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(64 - int(cells).bit_length() + 1)).astype(np.int64)


def _counted(width: int, cells: int):
    """Each task's counts of shingles by cell, in parts; a task's count of a cell ends at 65,535."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in slices(batches, "text"):
            found = [_cell(s, cells) for s in shingle_hashes(batch.column("text"), width)]
            total += np.bincount(np.concatenate(found), minlength=cells) if found else 0
        if total.any():
            own = np.minimum(total, 65535).astype(np.uint16).reshape(PARTS, -1)
            salt = np.random.default_rng(int(total.sum())).integers(PARTIAL)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, salt, np.int32)), pa.array([p.tobytes() for p in own], pa.binary())], names=["part", "salt", "counts"])

    return run, "part int, salt int, counts binary"


def _summed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["part", "salt"]):
            total = sum((np.frombuffer(c, kind).astype(np.int64) for c in g.column("counts").to_pylist()), np.zeros(1, np.int64))
            yield pa.RecordBatch.from_arrays([g.column("part").combine_chunks().slice(0, 1), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "salt", "counts"])

    return run, "part int, salt int, counts binary"


def frequency_classes(docs: DataFrame, width: int, cells: int = CELLS) -> np.ndarray:
    """A byte for each cell of the sketch: the binary logarithm of the number of (document, shingle) pairs in it. ``cells`` bytes, whatever the corpus."""
    run, schema = _counted(width, cells)
    got = map_arrow(docs.select("text"), run, schema)
    for kind in ("uint16", "int64"):
        run, schema = _summed(kind)
        got = map_arrow(got.repartition("part", "salt").sortWithinPartitions("part", "salt"), run, schema)
    out = np.zeros((PARTS, cells // PARTS), np.uint8)
    for r in got.collect():  # PARTS rows
        out[r["part"]] = np.log2(np.maximum(1, np.frombuffer(r["counts"], np.int64)))
    return out.reshape(-1)


def prefix(elements: np.ndarray, frequency: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first elements of a set (sorted hashes) in the order of frequency class and hash, as many as a link can't do without one of, and their classes."""
    own = frequency[_cell(elements, len(frequency))]
    order = np.argsort(own, kind="stable")[: len(elements) - least_overlap(len(elements), percent) + 1]
    return elements[order], own[order]


def _sketched(width: int, percent: int, members: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, mean = shared.value
        alone = math.log2(max(members, 4 * mean))  # classes up to this one go to one task
        for batch in slices(batches, "text"):
            sets = list(shingle_hashes(batch.column("text"), width))
            first = [prefix(s, frequency, percent) if len(s) else (s, np.zeros(0, np.uint8)) for s in sets]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in first])]).astype(np.int32))
            spread = np.maximum(0, np.concatenate([c for _, c in first]).astype(np.int32) + 1 - math.ceil(alone))
            sums = [pa.array([int(mix(s ^ x).sum(dtype=np.uint64)) for s in sets], pa.uint64()).view(pa.int64()) for x in (np.uint64(0), _STEP)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), *sums, pa.array([parity(s) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p for p, _ in first]).view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(spread))],
                names=["doc_id", "text_key", "n", "f1", "f2", "bits", "prefix", "spread"])

    return run, "doc_id bigint, text_key bigint, n bigint, f1 bigint, f2 bigint, bits binary, prefix array<bigint>, spread array<int>"


def parity(elements: np.ndarray) -> bytes:
    """For each of 2 ** k cells, half as many as elements or more, whether an odd number of elements falls there."""
    cells = 1 << max(6, (len(elements) // 2).bit_length())
    return np.packbits(np.bincount((mix(elements) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The number of elements in one set but not in the other is this much at least. Of unequal bitmaps the longer is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _possible(percent: int):
    """The pairs whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).tolist()
            differ = [differing(x, y) for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())]
            keep = pa.array([(100 + percent) * d <= (100 - percent) * t for d, t in zip(differ, total)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run, "a bigint, b bigint"


def _band(n: np.ndarray) -> np.ndarray:
    return (np.log(n) / math.log(BAND)).astype(np.int64)


def _starred(percent: int):
    """Of rows sorted by (key, salt, n), cut where a size is too large to be linked with the one before: an edge (a, b) from each row to the first of its run, ``sure``; of a run of few rows all pairs, not ``sure``.
    Where a key has several parts, a row for the first of each size band of a run as well, with keys (and no b) that parts with members of the same band or the next have in common."""
    names = ["a", "b", "key", "sure"]

    def edges(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), sure))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, n, id_, spread = (batch.column(c).to_numpy() for c in ("key", "salt", "n", "id", "spread"))
            before = last or (key[0], salt[0], 0)
            k0, s0, n0 = (np.concatenate([[before[c]], x[:-1]]) for c, x in enumerate((key, salt, n)))
            new = (key != k0) | (salt != s0) | (n * percent > n0 * 100)
            of = np.cumsum(new)  # the run's number; 0 goes on from the batch before, the last may go on in the next
            size = np.bincount(of)
            few = (size[of] <= FEW) & (of > 0) & (of < of[-1]) & (spread == 0)
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(start >= 0, id_[start], low)
            last, low = (int(key[-1]), int(salt[-1]), int(n[-1])), int(first[-1])
            edge = (~new) & (id_ != first) & ~few
            yield edges(id_[edge], first[edge], True)
            for d in range(1, FEW):
                i = np.flatnonzero(few[d:] & (of[d:] == of[:-d]))
                yield edges(np.maximum(id_[i], id_[i + d]), np.minimum(id_[i], id_[i + d]), False)
            band = _band(n)
            head = np.flatnonzero((spread > 0) & (new | (band != _band(np.maximum(n0, 1)))))
            for up in (0, 1):
                keys = mix(key[head].view(np.uint64) ^ mix((band[head] + up).view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(id_[head]), pa.nulls(len(head), pa.int64()), pa.array(keys), pa.array(np.full(len(head), True))], names=names)

    return run, "a bigint, b bigint, key bigint, sure boolean"


def _edges(members: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) over which all classes of a key that may be linked reach each other: members (id, n, key, spread) go to 2 ** spread parts of a key, and the parts' first ones are joined after. ``bits``: (id, n, bits)."""
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.pow(F.lit(2), F.col("spread")).cast("int")).cast("int"))
    run, schema = _starred(percent)
    star = stage(map_arrow(dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "n"), run, schema).distinct(), "star")
    heads = star.where("key is not null")
    low = heads.groupBy("key").agg(F.min("a").alias("b"))
    side = lambda c: bits.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    run, schema = _possible(percent)
    pairs = map_arrow(star.where("not sure").select("a", "b").join(side("a"), "a").join(side("b"), "b"), run, schema)
    return star.where("sure and key is null").select("a", "b").union(heads.select("key", "a").join(low, "key").where("a <> b").select("a", "b")).union(pairs)


def _sets(width: int, shared):
    """The sets of the texts whose key the filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            cell = (mix(batch.column("text_key").to_numpy().view(np.uint64)) & np.uint64(WANTED_BITS - 1)).astype(np.int64)
            for part in slices(iter([batch.filter(pa.array((known[cell >> 3] >> (cell & 7) & 1).astype(bool)))]), "text"):
                yield pa.RecordBatch.from_arrays([part.column("text_key"), pa.array([s.tobytes() for s in shingle_hashes(part.column("text"), width)], pa.binary())], names=["text_key", "elements"])

    return run, "text_key bigint, elements binary"


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key's bit, as the number of a byte and a value."""
    for batch in batches:
        cell = np.unique(mix(batch.column("text_key").to_numpy().view(np.uint64)) & np.uint64(WANTED_BITS - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell >> 6), pa.array(np.left_shift(np.uint64(1), (cell & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])


def _wanted(keys: DataFrame) -> np.ndarray:
    """A bitmap of the keys' hashes, of ``WANTED_BITS`` bits however many keys there are: false positives only."""
    words = map_arrow(keys.select("text_key"), _filter_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(WANTED_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


class Index:
    """Inverted lists over sets: which sets (by place) hold an element."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")  # places ascend within a list
        self.elements, self.starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(self.starts, len(flat))
        self.places = np.repeat(np.arange(len(sets)), self.sizes)[order]
        lists = np.repeat(np.arange(len(self.elements)), np.diff(self.starts))
        self.codes = lists * max(1, len(sets)) + self.places  # all lists in one sorted array, to probe any of them

    def occurrences(self, query: np.ndarray, percent: int) -> np.ndarray:
        """The places of the sets that are linked with ``query``."""
        q, n = len(query), len(self.sizes)
        at = np.minimum(np.searchsorted(self.elements, query), max(0, len(self.elements) - 1))
        lists = at[self.elements[at] == query] if len(self.elements) else at[:0]
        t = least_overlap(q, percent)
        if len(lists) < t or not t:
            return lists[:0]
        length = self.starts[lists + 1] - self.starts[lists]
        order = np.argsort(length, kind="stable")
        lists, length = lists[order], length[order]
        long = min(t - 1, int(t / (MU * math.log2(max(2, int(length[-1]))) + 1)))
        short = len(lists) - long
        # Merge of the short lists: their places sorted together, runs counted.
        n_short = length[:short]
        pos = np.repeat(self.starts[lists[:short]] - np.concatenate([[0], np.cumsum(n_short)[:-1]]), n_short) + np.arange(n_short.sum())
        merged = np.sort(self.places[pos], kind="stable")
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]])) if len(merged) else np.zeros(0, np.int64)
        found, count = merged[first], np.diff(np.append(first, len(merged)))
        need = -(-percent * (q + self.sizes[found]) // (100 + percent))  # each one's own T
        fits = (np.minimum(q, self.sizes[found]) * 100 >= np.maximum(q, self.sizes[found]) * percent) & (count >= need - long)
        found, count, need = found[fits], count[fits], need[fits]
        if long and len(found):  # binary probes of the long lists
            wanted = lists[short:, None] * n + found[None, :]
            hit = np.searchsorted(self.codes, wanted)
            count = count + (self.codes[np.minimum(hit, len(self.codes) - 1)] == wanted).sum(axis=0)
        return found[count >= need]


def _joined(percent: int):
    """For each set of a group: the smallest id of its connected part of the group, and the documents it is linked with on the other side (on its own side, where a cell meets itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for g in groups(batches, ["cluster", "i", "j"]):
            ids, copies, side = (g.column(c).to_numpy() for c in ("id", "copies", "side"))
            sets = [np.frombuffer(b, np.uint64) for b in g.column("elements").to_pylist()]
            itself = not g.column("meets")[0].as_py()  # a cell with itself
            x = np.arange(len(ids)) if itself else np.flatnonzero(side == 0)
            y = x if itself else np.flatnonzero(side == 1)
            if not len(x) or not len(y):
                continue
            index = Index([sets[k] for k in y])
            links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for k in x.tolist():
                met = y[index.occurrences(sets[k], percent)]
                met = met[met != k]
                links[k] += copies[met].sum()
                if not itself:
                    links[met] += copies[k]
                top = find(k)
                for m in np.unique(root[met]).tolist():
                    a = find(m)
                    if a != top:
                        a, top = (a, top) if ids[top] < ids[a] else (top, a)
                        root[a] = top
            linked = np.flatnonzero(links)
            if len(linked):
                out.append((ids[linked], ids[[find(k) for k in linked.tolist()]], links[linked]))
            if sum(len(o[0]) for o in out) > 50_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return run, "id bigint, root bigint, links bigint"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "root", "links"])


_PLACES = "array<struct<cluster:bigint,i:bigint,j:bigint,side:int,meets:boolean>>"


def _placed(rows: DataFrame, cell_rows: int, cell_elements: int) -> DataFrame:
    """Rows (id, cluster, n, ...) with ``places``, the groups (cluster, i, j) and the side there that each goes to: small clusters are one group, others are cut into cells; ``meets`` says that the group is of two cells."""
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int"))
    many = F.ceil(F.greatest(F.sum("rows") / cell_rows, F.sum("all") / cell_elements)).cast("int")
    bands = rows.groupBy("cluster", "band").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    large = bands.groupBy("cluster").agg(many.alias("parts")).where("parts > 1").select("cluster")
    of_band = stage(bands.join(large, "cluster").groupBy("cluster", "band").agg(many.alias("cells")), "cells")
    near = lambda by, name: of_band.select("cluster", (F.col("band") + by).alias("band"), F.col("cells").alias(name))
    sizes = of_band.join(near(-1, "above"), ["cluster", "band"], "left").join(near(1, "below"), ["cluster", "band"], "left").fillna(0, ["above", "below"])
    got = rows.join(sizes, ["cluster", "band"], "left")
    own = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
    code = lambda b, c: b.cast("bigint") * (1 << 32) + c  # noqa: E731  a cell's number: band and part
    pair = lambda a, b, s, m: F.struct("cluster", a.alias("i"), b.alias("j"), F.lit(s).alias("side"), F.lit(m).alias("meets"))
    me = code(F.col("band"), own)
    seq = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    later = F.transform(seq(own + 1, F.col("cells") - 1), lambda c: pair(me, code(F.col("band"), c), 0, True))
    former = F.transform(seq(F.lit(0), own - 1), lambda c: pair(code(F.col("band"), c), me, 1, True))
    up = F.transform(seq(F.lit(0), F.col("above") - 1), lambda c: pair(me, code(F.col("band") + 1, c), 0, True))
    down = F.transform(seq(F.lit(0), F.col("below") - 1), lambda c: pair(code(F.col("band") - 1, c), me, 1, True))
    zero = F.lit(0).cast("bigint")
    places = F.when(F.col("cells").isNull(), F.array(pair(zero, zero, 0, False))).otherwise(F.concat(F.array(pair(me, me, 0, False)), later, former, up, down))
    return got.withColumn("places", places.cast(_PLACES)).drop("band", "cells", "above", "below")


def jaccard_join(docs: DataFrame, *, width: int = 5, percent: int = 80, cells: int = CELLS, members: int = MEMBERS, cell_rows: int = CELL_ROWS, cell_elements: int = CELL_ELEMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every document: the set's size, the smallest doc_id that it reaches over links of similarity ``percent`` / 100 or more (80 at least), and how many other documents it is
    itself linked with, copies counted.

    Defined results: documents without words (null, empty, white space) have 0 shingles and are linked with nothing; texts under ``width`` words are one shingle; long texts are taken whole.
    Rows with one doc_id twice count as two documents of that id. A row with a null doc_id is linked like others: its component is the smallest id that it reaches, or null. Similarities of just
    ``percent`` / 100 are links. Columns other than doc_id and text are ignored, whatever their names; an empty table gives an empty result.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100: size bands are made for it")
    spark = docs.sparkSession
    docs = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).withColumnRenamed("_text_key", "text_key")
    frequency = frequency_classes(docs, width, cells)
    run, schema = _sketched(width, percent, members, spark.sparkContext.broadcast((frequency, float(np.exp2(frequency).mean()))))
    sketch = stage(map_arrow(docs, run, schema).withColumn("row", F.monotonically_increasing_id()), "sketch")

    # Classes of equal sets; one of its rows stands for each.
    first = F.min(F.struct("row", "text_key")).alias("first")
    classes = stage(sketch.where("n > 0").groupBy("f1", "f2", "n").agg(first, F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()), "classes")
    named = classes.select(F.col("first.row").alias("row"), "id")
    own = sketch.select("row", "n", F.arrays_zip("prefix", "spread").alias("p")).join(named, "row").select("id", "n", F.explode("p").alias("p"))
    own = own.select("id", "n", F.col("p.prefix").alias("key"), F.col("p.spread").alias("spread"))
    bits = sketch.select("row", "n", "bits").join(named, "row").select("id", "n", "bits")
    clusters = components(_edges(own, bits, percent)).select("id", F.col("component").alias("cluster"))

    # The sets of those classes, each from the text of one row, straight to their groups.
    wanted = classes.join(clusters, "id").select("id", "cluster", "n", "copies", F.col("first.text_key").alias("text_key"))
    read = stage(_placed(wanted, cell_rows, cell_elements).select("text_key", "id", "copies", "places"), "places")
    run, schema = _sets(width, spark.sparkContext.broadcast(_wanted(read)))
    sets = map_arrow(docs.select("text_key", "text"), run, schema)
    if not sketch.join(read, "text_key", "left_semi").groupBy("text_key").count().where("count > 1").isEmpty():  # rows of equal id and text: one is taken
        sets = sets.groupBy("text_key").agg(F.first("elements").alias("elements"))
    dealt = sets.join(read, "text_key").select("id", "copies", "elements", F.inline("places"))
    run, schema = _joined(percent)
    links = stage(map_arrow(dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), run, schema), "links")
    drop(read)
    linked = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))

    # Classes with their component's smallest id and their links, then all rows.
    count = links.groupBy("id").agg(F.sum("links").alias("links"))
    full = classes.join(linked, "id", "left").join(count, "id", "left").withColumn("group", F.coalesce("component", "id"))
    low = full.groupBy("group").agg(F.min("least").alias("component_id"))
    full = stage(full.join(low, "group").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("gn"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    drop(links)
    out = sketch.select("doc_id", "n", "f1", "f2").join(full, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("gn")), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by five-word shingles at a similarity of 0.8 or more."""
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as materialized (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as here from documents union select r.id, e.b from r join e on r.here = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, coalesce(k.n_links, 0) as n_links
from documents d left join n on n.doc_id = d.doc_id join (select id, min(here) as c from r group by id) m on m.id = d.doc_id left join (select a, count(*) as n_links from e group by a) k on k.a = d.doc_id"""
