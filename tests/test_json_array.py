"""Arrays of objects cut anywhere: the objects are those of a whole parse, in order."""

import json
import random

import pytest

from veinwork.sources.json_array import read_objects


def objects(spark, path, size, level=1):
    """The objects, cut into ranges of a size; what is read later isn't."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, str(size))
        if size < 100:
            assert spark.read.text(path, lineSep="}").rdd.getNumPartitions() > 3
        return read_objects(spark, path, level)
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


def parsed(df):
    rows = sorted(df.collect(), key=lambda r: r.ord)
    assert [r.ord for r in rows] == list(range(len(rows)))
    return [json.loads(r.value) for r in rows]


def some_text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "法", "\n", "é", "😀", " "]) for _ in range(rng.randrange(12)))


def some_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return [rng.randrange(99), some_text(rng), None][kind]
    if kind == 3:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {some_text(rng): some_value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("seed,size,indent,ascii_", [(1, 1 << 20, None, True), (2, 700, None, False), (3, 90, 1, False), (4, 21, None, False)])
def test_random_arrays(spark, tmp_path, seed, size, indent, ascii_):
    rng = random.Random(seed)
    items = [{"k": some_value(rng), some_text(rng): some_text(rng)} for _ in range({90: 25, 21: 8}.get(size, 60))]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=indent, ensure_ascii=ascii_))
    assert parsed(objects(spark, f"{tmp_path}/a.json", size)) == items


def test_object_over_many_ranges(spark, tmp_path):
    items = [{"a": 1}, {"t": '}{"\\' * 100, "in": [{"x": {}}] * 20}, {}, {"b": "}"}]
    (tmp_path / "a.json").write_text(json.dumps({"note": "} [", "data": items}))
    assert parsed(objects(spark, f"{tmp_path}/a.json", 50, level=2)) == items


def test_several_files_and_lines(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"n": 2}]\n[{"n": 3}, 7, "x", [1], {"n": 4}]\n')
    (tmp_path / "a.json").write_text('[{"n": 0},\n{"n": 1}]')
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text("[]")
    assert [x["n"] for x in parsed(objects(spark, str(tmp_path), 8))] == [0, 1, 2, 3, 4]


def test_nothing_and_an_object_that_never_ends(spark, tmp_path):
    (tmp_path / "c.json").write_text(" ")
    assert read_objects(spark, f"{tmp_path}/c.json").count() == 0
    (tmp_path / "d.json").write_text('[{"n": 0}, {"n": {"m": 1')
    assert parsed(read_objects(spark, f"{tmp_path}/d.json")) == [{"n": 0}]
