"""Language-model scoring with a log-frequency Bloom filter.

Unigrams and bigrams of the training texts are counted exactly, in shards by hash. A count is quantised to a level on a logarithmic scale (1, 2, 3, 4, 6, 8, 12, 16 and so on), and a filter holds
each n-gram once for every level up to its own, 0 among them: what occurs once is known too. A reader probes level after level until one is absent: the last
present one gives the count's bounds. The smoothed probability of a word is ``WEIGHT`` times the bigram's share of its history, less a discount, plus the rest times the unigram's add-one estimate; a word after
an unknown history has the unigram's alone. Counts enter by their lower bound above the line and by their upper bound below it, so that over all words the probabilities never add up to more than 1
(but for false positives); what quantising leaves over belongs to nothing.

Each shard has a filter of its own, of ``BITS`` bits for each n-gram and level, and shards come from about equal parts of the corpus, so the filter as a whole grows with
the n-grams and no task holds more than a shard's part. It is never in one place: a slice of texts sends its distinct n-grams to their shards and gets the levels back.
A shard is a range of hashes and its filter consists of blocks of ``BLOCK`` bits, one for each smaller range, so n-grams sorted once are in the order of shards and of blocks: all probes of one block come together, and each distinct n-gram is probed once in a shard.
The false-positive rate is about 2 per cent at 8 bits. Bigrams are known by hashes of 16 bits more than the number of characters has, so that one in 65,000 shares its hash at any size; sorted, they are sent as differences.

Beside the model's score there is an exact one, add-one unigrams. The counts of frequent words (at most ``HEAD``, by a threshold on the count)
are broadcast; for other words, each text sends its distinct words to the counts: no vocabulary of unbounded size is ever in one place.
Words are known by 64-bit hashes; among 10^8 words, two share one with probability 3 in 10,000.

Defined results: a null text counts as empty and has one token, its end. Each row is scored alone, rows with the same id too; a null doc_id counts as
not held out. Without training texts all counts are 0 and the base score is 0. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from veinwork.llm.language import held_out
from veinwork.llm.scratch import map_arrow, stage, table
from veinwork.llm.words import hash_words, mix, slices, split_words
from veinwork.ship import ship

BITS, HEAD = 8, 1 << 20
#: Bits of one block of a filter, and n-grams that are probed at once.
BLOCK, PROBED = 1 << 15, 1 << 17
#: Characters of training text that one shard's n-grams come from, and n-grams that a task gathers before it sends them on.
SHARD_CHARS, FLUSH = 32 << 20, 2 << 20
#: The bigrams' weight beside the unigrams where the history is known, and what a bigram's count is discounted by.
WEIGHT, DISCOUNT = 0.5, 0.5
#: The least count of each level.
STEPS = np.unique(np.concatenate([1 << np.arange(62), 3 << np.arange(60)]))

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE, _NEXT = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95)
#: No word has white space, so no word has this hash by its spelling.
END = hash_words(pa.array([" end"], pa.large_string()))[0]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, ends of texts among them, and the offset of each text's first."""
    words, ends = split_words(texts)
    h = hash_words(words)
    n = len(texts)
    out = np.full(len(h) + n, END, np.uint64)
    place = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(ends))
    out[place] = h
    return out, ends + np.arange(n + 1)


def bigrams(tokens_: np.ndarray, bits: int = 64) -> np.ndarray:
    """A hash of each token with the one before it, of which only the first ``bits`` bits are not 0; a text begins after an end."""
    before = np.concatenate([[END], tokens_[:-1]]) if len(tokens_) else tokens_
    rest = np.uint64(64 - bits)
    return mix(mix(before * _ONE + _STEP) + tokens_) >> rest << rest


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: high bytes that are all but empty cost next to nothing."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel().astype(np.uint64)


def place_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key in the upper 32 bits, and where in the shard's range it is in the lower ones: both ascend with the keys."""
    return (keys >> np.uint64(32)) * np.uint64(shards)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (place_of(keys, shards) >> np.uint64(32)).astype(np.int64)


def least_key(shard: int, shards: int) -> int:
    """The least key of a shard."""
    return -(-(shard << 32) // shards) << 32


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin among ascending ones, and where the last shard's end."""
    return np.append(np.searchsorted(keys, np.array([least_key(s, shards) for s in range(shards)], np.uint64)), len(keys))


def differences(keys: np.ndarray, shards: int, shard: int, bits: int) -> np.ndarray:
    """One shard's ascending keys of ``bits`` bits by their differences, the first by that from the shard's least."""
    return np.diff(keys >> np.uint64(64 - bits), prepend=np.uint64(least_key(shard, shards) >> 64 - bits))


def summed(differences_: np.ndarray, shards: int, shard: int, bits: int) -> np.ndarray:
    return (np.cumsum(differences_, dtype=np.uint64) + np.uint64(least_key(shard, shards) >> 64 - bits)) << np.uint64(64 - bits)


def _count(train: DataFrame, shards: int, bits: int, key_bits: int) -> DataFrame:
    """A row for each shard: its number of tokens, its unigrams with their counts, the number of them by floor(log2(count)), and its filter."""
    hashes, widths = hashes_of(bits), (64, key_bits)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush():
            for order, parts in enumerate(held):
                if not parts:
                    continue
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                cuts = shard_cuts(keys, shards).tolist()
                own = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in own], pa.int32()), pa.array([order] * len(own), pa.int32()), pa.array([b - a for _, a, b in own], pa.int64()), pa.array([packed(differences(keys[a:b], shards, i, widths[order])) for i, a, b in own], pa.binary()), pa.array([packed(n[a:b]) for _, a, b in own], pa.binary())], names=["shard", "order", "size", "keys", "n"])
                parts.clear()

        for batch in slices(batches, "text"):
            t, _ = tokens(batch.column("text"))
            held[0].append(t)
            held[1].append(bigrams(t, key_bits))
            if sum(map(len, held[0])) > FLUSH:
                yield from flush()
        yield from flush()

    def total(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        rows = list(zip(*(group.column(c).to_pylist() for c in ("order", "size", "keys", "n"))))
        both = []
        for order in range(2):
            own_rows = [r[1:] for r in rows if r[0] == order]
            every = np.concatenate([np.empty(0, np.uint64), *(summed(unpacked(k, size), shards, shard, widths[order]) for size, k, _ in own_rows)])
            times = np.concatenate([np.empty(0, np.uint64), *(unpacked(n, size) for size, _, n in own_rows)]).astype(np.int64)
            at = np.argsort(every)
            every = every[at]
            first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
            both.append((every[first], np.add.reduceat(times[at], first) if len(first) else times))
        keys, n = both[0]
        levels = np.bincount(np.log2(n).astype(np.int64), minlength=64)
        built = Filter.build(*(np.concatenate(x) for x in zip(*both)), hashes, bits, shards)
        out = {"shard": shard, "tokens": int(n.sum()), "uni_keys": keys.tobytes(), "uni_n": n.tobytes(), "uni_levels": levels.tolist(), "bits": built}
        return pa.Table.from_pylist([out], pa.schema([("shard", pa.int32()), ("tokens", pa.int64()), ("uni_keys", pa.binary()), ("uni_n", pa.binary()), ("uni_levels", pa.list_(pa.int64())), ("bits", pa.binary())]))

    ship(train.sparkSession)
    sent = map_arrow(train.select("text"), gather, "shard int, order int, size bigint, keys binary, n binary")
    return sent.groupBy("shard").applyInArrow(total, "shard int, tokens bigint, uni_keys binary, uni_n binary, uni_levels array<bigint>, bits binary")


def level_of(n: np.ndarray) -> np.ndarray:
    """The level of each count; -1 for 0."""
    return np.searchsorted(STEPS, n, "right") - 1


def bounds_of(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most count of each level; 0 for -1."""
    return np.where(level >= 0, STEPS[np.maximum(level, 0)], 0), np.where(level >= 0, STEPS[np.maximum(level, 0) + 1] - 1, 0)


def level_step(level: int) -> np.uint64:
    return np.uint64(level * int(_STEP) & (1 << 64) - 1)


def hashes_of(bits: int) -> int:
    return max(1, round(bits * math.log(2)))


class Filter:
    """The Bloom filter of one shard: blocks of equal size, and a key's bits at all levels are in the block of its range."""

    def __init__(self, raw: bytes, hashes: int, shards: int):
        self.there, self.hashes, self.shards = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").view(bool), hashes, shards
        self.width = min(BLOCK, len(self.there))
        self.shift = np.uint64(65 - self.width.bit_length())

    @classmethod
    def build(cls, keys: np.ndarray, n: np.ndarray, hashes: int, bits: int, shards: int) -> bytes:
        levels = level_of(n)
        size = int((levels + 1).sum()) * bits
        size = -(-size // BLOCK) * BLOCK if size > BLOCK else size and max(64, 1 << (size - 1).bit_length())
        out = cls(bytes(size // 8), hashes, shards)
        for level in range(int(levels.max(initial=-1)) + 1):
            k = keys[levels >= level]
            block, g = out._blocks(k), mix(k + level_step(level + 1))
            for _ in range(hashes):
                out.there[out._at(block, g)] = True
                g *= _NEXT
        return np.packbits(out.there, bitorder="little").tobytes()

    def _blocks(self, keys: np.ndarray) -> np.ndarray:
        """The first bit of each key's block."""
        share = place_of(keys, self.shards) & np.uint64(0xFFFFFFFF)
        return (share * np.uint64(len(self.there) // self.width) >> np.uint64(32)) * np.uint64(self.width)

    def _at(self, block: np.ndarray, g: np.ndarray) -> np.ndarray:
        return (block + (g >> self.shift)).view(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level that probing finds for each key, -1 for a key at none; quick for ascending keys."""
        found = np.full(len(keys), -1, np.int8)
        for a in range(0, len(keys) if len(self.there) else 0, PROBED):
            found[a : a + PROBED] = self._level(keys[a : a + PROBED])
        return found
    def _level(self, keys: np.ndarray) -> np.ndarray:
        found, live, block, level = np.full(len(keys), -1, np.int8), np.arange(len(keys)), self._blocks(keys), 0
        while len(live) and level < len(STEPS) - 1:
            g, ok = mix(keys + level_step(level + 1)), None
            for i in range(self.hashes):
                there = self.there[self._at(block, g)]
                ok = there if ok is None else ok & there
                left = np.count_nonzero(ok)
                if left < (0.7 if i < self.hashes - 1 else 1) * len(live):
                    at = np.flatnonzero(ok)
                    live, keys, block, g, ok = live[at], keys[at], block[at], g[at], None
                g *= _NEXT
            found[live] = level
            level += 1
        return found


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]


def levels_of(asked: list[np.ndarray], filter_: Filter) -> list[np.ndarray]:
    """The levels of each list's keys; a key that many lists hold is probed once."""
    every = distinct(np.concatenate([np.empty(0, np.uint64), *asked]))
    levels = filter_.level(every)
    return [levels[np.searchsorted(every, keys)] for keys in asked]


class Shards:
    """The filters of all shards, as a table (shard, bits)."""

    def __init__(self, parts: DataFrame, shards: int, hashes: int, key_bits: int):
        self.parts, self.shards, self.hashes, self.key_bits = parts, shards, hashes, key_bits

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each of a few keys, worked out on the driver, a shard at a time."""
        found, own = np.full(len(keys), -1, np.int64), shard_of(keys, self.shards)
        for s in np.unique(own).tolist():
            part = self.parts.where(F.col("shard") == s).first()
            if part:
                found[own == s] = Filter(part["bits"], self.hashes, self.shards).level(keys[own == s])
        return found


def questions(t: np.ndarray, shards: int, key_bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """For each shard that has n-grams of these tokens its number, how many they are, how many of them are unigrams, which come first, and the packed keys."""
    uni, bi = distinct(t), distinct(bigrams(t, key_bits))
    cuts = np.stack([shard_cuts(uni, shards), shard_cuts(bi, shards)])
    for s in np.flatnonzero(np.diff(cuts).any(0)).tolist():
        (a, b), (c, d) = cuts[:, s : s + 2].tolist()
        keys = differences(uni[a:b], shards, s, 64), differences(bi[c:d], shards, s, key_bits)
        yield s, b - a + d - c, b - a, packed(np.concatenate(keys))


def keys_asked(data: bytes, n: int, first: int, shards: int, shard: int, key_bits: int) -> np.ndarray:
    x = unpacked(data, n)
    return np.concatenate([summed(x[:first], shards, shard, 64), summed(x[first:], shards, shard, key_bits)])


def log_probabilities(uni: np.ndarray, own: np.ndarray, bi: np.ndarray, pair: np.ndarray, tokens_: int, types: int) -> np.ndarray:
    """log10 of each token's smoothed probability: levels of the distinct unigrams and bigrams, and which of them each token is and ends. The first token follows an end, as the last one is."""
    (least, most), (together, _) = bounds_of(uni), bounds_of(bi)
    before = most[np.roll(own, 1)]
    weight = np.where(before > 0, WEIGHT, 0.0)
    share = np.minimum(np.maximum(together - DISCOUNT, 0)[pair], before) / np.maximum(before, 1)
    return np.log10(weight * share + (1 - weight) * ((least + 1) / (tokens_ + types + 1))[own])


class Model:
    def __init__(self, filter_: Shards, tokens_: int, types: int, head: np.ndarray, head_n: np.ndarray):
        self.filter, self.tokens, self.types = filter_, tokens_, types
        at = np.argsort(head)
        self.head, self.head_n = head[at], head_n[at]


def train(docs: DataFrame, *, bits: int = BITS, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model, and the (key, n) counts of the words that are not in its head."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / SHARD_CHARS))
    key_bits = min(64, 16 + max(1, int(chars)).bit_length())
    counted = stage(_count(docs, shards, bits, key_bits), "ngrams")
    got = counted.agg(F.sum("tokens"), *[F.sum(F.element_at("uni_levels", i + 1)) for i in range(64)]).first()
    total, uni = int(got[0] or 0), np.array([int(x or 0) for x in got[1:]])

    above = np.cumsum(uni[::-1])[::-1]  # types of a count of 2^i or more
    least = 1 << int(np.argmax(above <= head))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("uni_keys").to_pylist(), batch.column("uni_n").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["key", "n"])

    counts = map_arrow(counted.select("uni_keys", "uni_n"), flat, "key bigint, n bigint")
    top = counts.where(F.col("n") >= least).toArrow()  # at most ``head`` rows
    model = Model(Shards(counted.select("shard", "bits"), shards, hashes_of(bits), key_bits), total, int(uni.sum()), top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy())
    return model, counts.where(F.col("n") < least)


def score(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of (doc_id, held_out, text)."""
    spark = docs.sparkSession
    ship(spark)
    heads = spark.sparkContext.broadcast((model.head, model.head_n))
    shards, hashes, key_bits, tokens_, types = model.filter.shards, model.filter.hashes, model.filter.key_bits, model.tokens, model.types
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = pa.schema([("slice", pa.int64()), ("shard", pa.int32()), ("size", pa.int64()), ("first", pa.int64()), ("data", pa.binary())])
    sent_type = "slice bigint, shard int, size bigint, first bigint, data binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each slice, a row for each shard with the n-grams to look up there, and one with the texts, under a number of its own below 0."""
        at = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            # texts go to a group by slice, spread over as many numbers as there are shards
            own = -1 - int(mix(np.array([at], np.uint64))[0] % np.uint64(shards))
            asked = [(own, 0, 0, sink.getvalue().to_pybytes()), *questions(tokens(batch.column("text"))[0], shards, key_bits)]
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(asked), pa.int64()), *(pa.array(x, sent.types[i + 1]) for i, x in enumerate(zip(*asked)))], schema=sent)
            at += batch.num_rows

    def answer(group: pa.Table) -> pa.Table:
        """The levels of a shard's n-grams, a byte each; texts go through as they are."""
        shard = group.column("shard")[0].as_py()
        if shard < 0:
            return group
        rows = list(zip(*(group.column(c).to_pylist() for c in ("slice", "size", "first", "data"))))
        filter_ = Filter(b"".join(d for k, _, _, d in rows if k < 0), hashes, shards)
        rows = [r for r in rows if r[0] >= 0]
        found = levels_of([keys_asked(d, n, first, shards, shard, key_bits) for _, n, first, d in rows], filter_)
        out = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in found]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(out), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(out, pa.binary())], schema=sent)

    def finish(group: pa.Table) -> pa.Table:
        row, parts = group.column("slice")[0].as_py(), sorted(zip(*(group.column(c).to_pylist() for c in ("shard", "size", "first", "data"))))
        (texts,) = [d for s, _, _, d in parts if s < 0]
        found = [(np.frombuffer(pa.decompress(d, n, codec="zstd", asbytes=True), np.int8), first) for s, n, first, d in parts if s >= 0]
        batch = pa.ipc.open_stream(texts).read_next_batch()
        head, head_n = heads.value
        t, ends = tokens(batch.column("text"))
        words, own = np.unique(t, return_inverse=True)
        pair = np.unique(bigrams(t, key_bits), return_inverse=True)[1]
        logs = log_probabilities(np.concatenate([x[:first] for x, first in found]), own, np.concatenate([x[first:] for x, first in found]), pair, tokens_, types)
        at = np.minimum(np.searchsorted(head, words), max(0, len(head) - 1))
        there = head[at] == words if len(head) else np.zeros(len(words), bool)
        c = np.where(there, head_n[at], 0) if len(head) else np.zeros(len(words))
        base, known, score = (np.add.reduceat(x, ends[:-1]) for x in (np.log10(c + 1.0)[own], there.astype(np.int64)[own], logs))
        # what is not in the head, by text and word
        rare = np.flatnonzero(~there[own])
        keys, tf = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(ends))[rare] * len(words) + own[rare], return_counts=True)
        lists = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * len(words)).astype(np.int32))
        rows = np.arange(row, row + batch.num_rows)
        return pa.table({"row": pa.array(rows), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(np.diff(ends)), "known": pa.array(known), "base": pa.array(base), "score": pa.array(score), "keys": pa.ListArray.from_arrays(lists, pa.array(words[keys % len(words)].view(np.int64))), "tf": pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int64)))})

    asked = map_arrow(docs.select("doc_id", "held_out", "text"), ask, sent_type)
    parts = model.filter.parts.select(F.lit(-1).cast("bigint").alias("slice"), "shard", *(F.lit(0).cast("bigint").alias(c) for c in ("size", "first")), F.col("bits").alias("data"))
    found = asked.union(parts).repartition(shards, "shard").groupBy("shard").applyInArrow(answer, sent_type)
    read = found.repartition(shards, "slice").groupBy("slice").applyInArrow(finish, f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, score double, keys array<bigint>, tf array<bigint>")
    read = stage(read, "scores")
    rare = read.select("row", F.explode(F.arrays_zip("keys", "tf")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.tf").alias("tf"))
    more = rare.join(rest, "key").groupBy("row").agg(F.sum("tf").alias("k"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("b"))
    whole = math.log10(model.tokens + model.types + 1)
    return read.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(parts=7, part=2))
    model, rest = train(docs.where("not held_out"))
    return score(docs, model, rest)
