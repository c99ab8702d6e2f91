"""The n-gram join, the Merkle manifest and hard negatives against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import LOWER, documents, shingles
from tests.llm.test_sets import near_copies
from veinwork.llm import manifest, negatives, ngram_join


def joined(rows, width, percent):
    """doc_id -> (size, smallest id reached, links), by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = {}
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        out[d] = (len(sets[i]), min(rows[j][0] for j in seen), len(links[i]))
    return out


@pytest.mark.parametrize(("width", "percent", "small"), [(5, 80, dict(members=2, cell_rows=4, cells=64)), (3, 85, dict(cell_elements=200)), (5, 100, {})])
def test_join(spark, width, percent, small):
    rows = near_copies() + [(7000 + i, "the same words come again and again here") for i in range(9)]
    got = ngram_join.jaccard_join(documents(spark, rows), width=width, percent=percent, **small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == joined(rows, width, percent) and len(got) == len(rows)


def test_join_of_odd_rows(spark):
    same, long = "a b c d e f", " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, same), (1, same), (None, same), (2, same), (None, "u v"), (None, "u v"), (None, None), (7, None), (8, long), (9, long + " end")]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_links"]) for r in ngram_join.jaccard_join(documents(spark, rows)).collect())
    assert got == [(-1, -1, 0), (-1, -1, 1), (-1, -1, 1), (-1, 1, 3), (1, 1, 3), (1, 1, 3), (2, 1, 3), (7, 7, 0), (8, 8, 1), (9, 8, 1)]
    assert ngram_join.jaccard_join(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        ngram_join.jaccard_join(documents(spark, rows), percent=70)


def test_links_just_at_the_threshold(spark):
    """Chains of sets at a similarity of 8/10 and just under it."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w[:13])), (2, " ".join(w[1:14])), (3, " ".join(w[40:53])), (4, " ".join(w[41:55]))]  # 9 shingles each: 8 of 10 shared; 8 of 11
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.jaccard_join(documents(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_divide_skip_finds_what_counting_finds():
    """Long and short lists: elements that nearly all sets have beside rare ones."""
    rng = np.random.default_rng(3)
    common, rare = rng.integers(0, 2**63, 60).astype(np.uint64), rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common, rng.integers(40, 60), replace=False), rng.choice(rare, rng.integers(0, 12))])) for _ in range(300)] + [rng.choice(rare, 5, replace=False)]
    sets = [np.sort(s) for s in sets]
    index, some = ngram_join.Index(sets), 0
    for k in range(0, 301, 7):
        want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(s, sets[k])) >= 80 * len(np.union1d(s, sets[k]))]
        assert sorted(index.occurrences(sets[k], 80).tolist()) == want
        some += len(want) > 1
    assert some > 5 and not len(index.occurrences(np.zeros(0, np.uint64), 80)) and not len(ngram_join.Index([]).occurrences(sets[0], 80))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def climb(leaves):
    """Levels of a tree of 16-fold nodes."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, pos):
    for level in levels[:-1]:
        run = pos // 16 * 16
        yield "".join(level[run:pos]), "".join(level[pos + 1 : run + 16])
        pos //= 16


def plain_manifest(rows):
    leaf = lambda r: plain_leaf(r, r[4])
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf(r) for r in by[s]]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, r in enumerate(by[s]):
            steps = [*path(trees[s], pos), *path(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = plain_leaf(r, r[4].translate(LOWER)) if bad and r[4] is not None else leaf(r)
            for left, right in steps:
                h = H(left, h, right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H(*(a + b for a, b in steps)), h, h == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [{"a": 300, None: 17, "": 1, "b": 16, "é": 33}, {"one": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}, {"a": 5000}])
def test_manifest(spark, sizes, monkeypatch):
    rng, rows = random.Random(4), []
    for source, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            rows.append((None if i % 50 == 49 else i if i % 7 else i - i % 14, source, rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(["Some TEXT", "no capitals", None, "", f"Text {i} ÄÖ"])))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, pos int, h string")
    monkeypatch.setattr(manifest, "table", lambda *_: docs)
    got = manifest.query(spark, "")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(manifest, "table", lambda *_: documents(spark, []))
    assert manifest.query(spark, "").count() == 0


def plain_negatives(rows):
    q = [(i, l, [int(np.floor(256 * x)) for x in map(float, v)]) for i, l, v in rows if None not in (i, l, v) and None not in v and np.isfinite(np.array(v, float)).all()]
    q = [(i, (l + 1) % 10 if i % 7 == 0 else l, v) for i, l, v in q]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for i in sorted({x[0] for x in q if x[0] % 100 == 0}):
        raw = {x[0]: x for x in reversed(q)}
        own = raw[i]
        scored = sorted((-dot(own[2], v), j, l) for j, l, v in q if j != i)
        for s, p, _ in [x for x in scored if x[2] == own[1]][:5]:
            fit = [(j, -n) for n, j, l in scored if l != own[1] and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(i, p, k + 1, j, -s, n) for k, (j, n) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("peak", [1.0, 2.0**40])
def test_hard_negatives(spark, peak, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        v = np.round(rng.normal(size=6) * (1 if i % 3 else 0.1) + (i % 4), 2 if i % 5 else 0) * peak
        rows.append((i, int(rng.integers(10)), [float(x) for x in v]))
    rows += [(700, 1, [0.0] * 6), (800, None, [1.0] * 6), (900, 2, None), (901, 2, [1.0, None]), (902, 2, [float("nan")] * 6), (None, 2, [1.0] * 6), (1000, 3, []), (903, 3, [1.0]), (904, 4, [1.0] * 9), (5, 4, [2.0] * 6)]
    monkeypatch.setattr(negatives, "SLICE", 100)
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, label int, embedding array<double>, place string, score int")
    monkeypatch.setattr(negatives, "table", lambda *_: data)
    got = sorted(map(tuple, negatives.query(spark, "").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == plain_negatives(rows) and len(got) > 100


def test_blocks_of_anchors_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    data = spark.createDataFrame([(i, i % 3, [float(x) for x in rng.normal(size=4)]) for i in range(120)], "vec_id bigint, label int, embedding array<double>")
    one, many = (sorted(map(tuple, negatives.hard_negatives(data, F.col("vec_id") % 10 == 0, F.col("label"), block=b).collect())) for b in (4096, 3))
    assert one == many and one
    assert negatives.hard_negatives(data.where("false"), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_threshold_stops_early():
    """Where few rows stand out, few are scored, and the result is that of all rows."""
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(5000, 4)) * 20)
    rows[:20] += 500
    part = negatives.Slice(np.arange(5000), np.arange(5000) % 2, rows, 600.0)
    best = [negatives.Best(3, True)]
    assert negatives.search(part, np.array([9.0, 8.0, 7.0, 5.0]), 0, -1, best) < 500
    scores = rows @ np.array([9.0, 8.0, 7.0, 5.0])
    assert best[0].ids.tolist() == sorted(range(0, 5000, 2), key=lambda i: (-scores[i], i))[:3]
    windowed = [negatives.Best(4, False, 2000, 9000)]
    negatives.search(part, np.array([9.0, 8.0, 7.0, 5.0]), 0, -1, windowed)
    assert windowed[0].ids.tolist() == sorted((i for i in range(1, 5000, 2) if 2000 <= scores[i] <= 9000), key=lambda i: (-scores[i], i))[:4]
