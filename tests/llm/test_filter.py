"""Hashes of words, ranges of hashes and the blocks of a shard's filter: the work of op9_lm_score that grows with the corpus."""

import numpy as np
import pyarrow as pa

from veinwork.llm import lm, words


def test_short_words_need_no_call_each(monkeypatch):
    calls = []
    digest = words.xxh64_intdigest
    monkeypatch.setattr(words, "xxh64_intdigest", lambda w: calls.append(1) or digest(w))
    rng = np.random.default_rng(2)
    texts = sorted({"".join(chr(int(c)) for c in rng.integers(97, 1200, int(rng.integers(1, 25)))) for _ in range(20000)} | {"a" * k for k in range(1, 200)})
    long = sum(len(w.encode()) > 8 * words.LANES for w in texts)
    h = words.hash_words(pa.array(texts, pa.large_string()))
    assert len(np.unique(h)) == len(texts) and len(calls) == long < 200
    assert (np.bincount((h >> np.uint64(60)).astype(int), minlength=16) > len(texts) / 16 * 0.8).all()
    # neither the place in the array nor what comes after a word matters
    assert (words.hash_words(pa.array(["x", *texts[::-1]], pa.string()).slice(1)) == h[::-1]).all()
    assert (words.hash_words(pa.array(["b", "", "b", "b\0"])) == words.hash_words(pa.array(["b", "", "b", "b\0"] * 2))[4:]).all()
    assert len(set(words.hash_words(pa.array(["b", "", "b", "b\0"])).tolist())) == 3


def test_ascending_keys_are_in_the_order_of_shards_and_blocks():
    rng = np.random.default_rng(3)
    for shards, bits in ((1, 64), (7, 64), (200, 20), (51, 45), (1600, 45)):
        rest = np.uint64(64 - bits)
        keys = lm.distinct(np.append(rng.integers(0, 1 << 64, 30000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)) >> rest << rest)
        own, cuts = lm.shard_of(keys, shards), lm.shard_cuts(keys, shards)
        assert (np.diff(own) >= 0).all() and own.min() >= 0 and own.max() < shards
        assert (np.diff(cuts) == np.bincount(own, minlength=shards)).all() and cuts[0] == 0
        for s in np.unique(own).tolist()[:20] + [int(own[-1])]:
            part = keys[own == s]
            sent = lm.differences(part, shards, s, bits)
            assert (lm.summed(lm.unpacked(lm.packed(sent), len(sent)), shards, s, bits) == part).all()
    filter_ = lm.Filter(bytes(lm.BLOCK), lm.hashes_of(8), 51)
    part = keys[lm.shard_of(keys, 51) == 5]
    blocks = filter_._blocks(part)
    assert (np.diff(blocks.astype(np.int64)) >= 0).all() and set((blocks // np.uint64(lm.BLOCK)).tolist()) == set(range(8))


def test_filter_misses_nothing_and_rarely_errs():
    rng = np.random.default_rng(4)
    for size, skew in ((0, 2.0), (1, 2.0), (300, 2.0), (300_000, 1.7), (40_000, 1.05)):
        keys, n = np.sort(rng.integers(0, 1 << 64, size, np.uint64)), np.minimum(rng.zipf(skew, size), 1 << 40)
        true = lm.level_of(n)
        filter_ = lm.Filter(lm.Filter.build(keys, n, lm.hashes_of(8), 8, 1), lm.hashes_of(8), 1)
        found, other = filter_.level(keys), filter_.level(rng.integers(0, 1 << 64, 100_000, np.uint64))
        assert (found >= true).all() and (found > true).mean() < 0.04 if size else (other == -1).all()
        assert (other >= 0).mean() < 0.04


def test_what_many_slices_ask_is_probed_once():
    class Counting:
        def level(self, keys):
            self.keys = keys
            return (keys % np.uint64(5)).astype(np.int8)

    filter_, rng = Counting(), np.random.default_rng(5)
    asked = [np.concatenate([np.sort(rng.choice(2000, n, False)), np.sort(rng.choice(3000, n, False)) + 2000]).astype(np.uint64) for n in (1500, 1800, 0, 7)]
    for keys, levels in zip(asked, lm.levels_of(asked, filter_)):
        assert (levels == keys % np.uint64(5)).all()
    assert len(filter_.keys) == len(set(np.concatenate(asked).tolist())) and (np.diff(filter_.keys.astype(np.int64)) > 0).all()
    assert lm.levels_of([], filter_) == []
