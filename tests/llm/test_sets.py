"""Near duplicates and decontamination against comparison of all pairs."""

import random

import numpy as np
import pytest

from tests.llm.helpers import components, documents, shingles
from veinwork.llm import decontaminate, dedup


def near_copies(n_groups=6, size=14, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 160]))]
        for k in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8]) * len(base) // 160 + (k % 5 == 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((g * 100 + k, " ".join(copy)))
    rng.shuffle(rows)
    return rows + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "One"), (9005, "one"), (9006, "one two"), (9007, "two one")]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components(spark, width, percent):
    rows = near_copies()
    got = dedup.near_duplicates(documents(spark, rows), width=width, percent=percent, block=8, partners=1).collect()
    want = components(rows, width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_repeated_and_null_ids(spark):
    same = "a b c d e f"
    rows = [(1, same), (1, same), (None, same), (2, same), (None, "u v w x y z"), (None, "u v w x y z"), (None, None), (7, None)]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in dedup.near_duplicates(documents(spark, rows)).collect())
    assert got == [(-1, -1, False), (-1, -1, True), (-1, -1, True), (-1, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (7, 7, True)]
    assert dedup.near_duplicates(documents(spark, [])).count() == 0
    kept = dedup.deduplicate(documents(spark, rows))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, ""), (-1, "u v w x y z"), (1, same), (7, "")] and kept.columns == documents(spark, rows).columns


def test_ids_that_several_texts_have(spark):
    rng = random.Random(9)
    a, b = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False)}
    assert sorted(r["text"] for r in dedup.deduplicate(documents(spark, rows)).collect()) == sorted([a, b])
    near = [(1, a), (1, a + " more")]
    assert [r["doc_id"] for r in dedup.deduplicate(documents(spark, near)).collect()] == [1]


def test_hub_groups_are_compared_whole(spark):
    """Chains of texts of which only neighbours are linked, in groups of one hub each and of several."""
    rng = random.Random(3)
    rows = []
    for g in range(4):
        w = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(200)]
        for k in range(25):
            rows.append((100 * g + k, " ".join(w[k * 4 :] + [f"x{g}" for _ in range(k)])))
    got = dedup.near_duplicates(documents(spark, rows), width=3, percent=85, block=4, partners=1).collect()
    want = components(rows, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_pairs_at_the_threshold_share_a_band():
    """2,000 pairs of sets at a similarity of 0.85: each shares a band, and its signatures agree enough to be looked at."""
    rng = np.random.default_rng(4)
    for _ in range(2000):
        x = rng.integers(0, 2**63, 63).astype(np.uint64)
        a, b = (dedup.superminhash(np.sort(s), dedup.BANDS * dedup.ROWS) for s in (x[:57], np.concatenate([x[:51], x[57:60]])))
        assert (dedup.bands_of(a, dedup.BANDS, dedup.ROWS) == dedup.bands_of(b, dedup.BANDS, dedup.ROWS)).any()
        assert (a == b).sum() >= 200 * 0.85 - dedup.SIGMAS * (200 * 0.85 * 0.15) ** 0.5


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    off = []
    for share in (0.3, 0.6, 0.9):
        for _ in range(10):
            b = a.copy()
            n = int(300 * (1 - share))
            b[:n] = rng.integers(0, 2**63, n).astype(np.uint64)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            off.append((dedup.superminhash(a, 200) == dedup.superminhash(b, 200)).mean() - true)
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.12
    assert (dedup.superminhash(a[::-1].copy(), 200) == dedup.superminhash(a, 200)).all()


def test_contamination(spark):
    rng = random.Random(2)
    w = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(n))
    items = [(i, w(rng.choice([3, 6, 30, 80]))) for i in range(30)] + [(100, None), (101, ""), (102, "Yes No")]
    docs = [(i, w(300)) for i in range(20)] + [(50, None), (51, ""), (52, "yes  no")]
    for k, (i, t) in enumerate(items[:20]):
        part = t.split()
        for _ in range(k % 4):
            part[rng.randrange(len(part))] = "changed"
        docs.append((200 + i, f"{w(50)}\n{' '.join(part)} {w(400)}"))
    got = decontaminate.find_contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=2000)
    want = set()
    for d, t in docs:
        own = shingles(t, 5)
        for i, x in items:
            s = shingles(x, 5)
            if s and len(s & own) * 100 >= 80 * len(s):
                want.add((d, i, len(s), len(s & own)))
    assert {(r["doc_id"], r["item_id"], r["item_shingles"], r["shared"]) for r in got.collect()} == want and len(want) > 5
    left = decontaminate.remove_contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {x[0] for x in want}
    assert decontaminate.find_contaminated(documents(spark, []), spark.createDataFrame([], "item_id bigint, text string")).count() == 0
