"""JSON arrays cut by many tasks give the records that a whole-file reader gives."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest

from tallyweave.sources import items
from tallyweave.sources import json_arrays as J


@pytest.fixture
def small_splits(spark):
    kept = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "20"}
    for name, value in kept.items():
        spark.conf.set(name, value)
    yield spark
    for name in kept:
        spark.conf.unset(name)


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 1:
        return "".join(rng.choice('ab"\\{}[],:\n é日') for _ in range(rng.randrange(12)))
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind > 4:
        return {"".join(rng.choice('a"\\}{') for _ in range(3)): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return (rng.randrange(1000), None, None, rng.random() < 0.5)[kind]


def records(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: r["offset"]):
        found.setdefault(os.path.basename(r["file_path"]), []).append(r)
    return found


def test_random_arrays_and_lines_in_small_splits(small_splits, tmp_path):
    rng, want = random.Random(1), {}
    for f in range(9):
        rows = [{"i": i, "v": value(rng)} for i in range(rng.randrange(1, 300))]
        if f % 3 == 0:
            text = json.dumps(rows, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        elif f % 3 == 1:
            text = "\n".join(json.dumps(r) for r in rows) + "\r\n" * (f == 4)
        else:
            text = " \n" + json.dumps(rows) + "\n"
        (tmp_path / f"f{f}.json").write_text("\ufeff" * (f in (3, 7)) + text, encoding="utf-8")
        want[f"f{f}.json"] = rows
    for size in (1, 500, 1 << 20):
        found = records(J.read_records(small_splits, str(tmp_path), chunk_bytes=size))
        assert {f: [json.loads(r["record"]) for r in rows] for f, rows in found.items()} == want
    rows = found["f0.json"]  # offsets are places in the file
    whole = (tmp_path / "f0.json").read_bytes()
    assert all(whole[r["offset"] :].lstrip().startswith(r["record"].encode()) for r in rows)


def test_lists_of_a_field(small_splits, tmp_path):
    rng = random.Random(2)
    wanted = [{"i": i, "v": value(rng)} for i in range(300)]
    (tmp_path / "object.json").write_text(json.dumps({"a": [{"x": [1, {"metrics": [5]}]}], "n": 3, "metrics": wanted, "z": [{"q": 1}, [2]]}))
    (tmp_path / "bare.json").write_text(json.dumps(wanted))
    (tmp_path / "none.json").write_text(json.dumps({"other": wanted[:3], "metrics": []}))
    found = records(J.read_records(small_splits, str(tmp_path), field="metrics", chunk_bytes=300))
    assert {f: [json.loads(r["record"]) for r in rows] for f, rows in found.items()} == {"object.json": wanted, "bare.json": wanted}


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    text = ",".join(json.dumps({"id": str(i), "question": "[{" * (i % 50) + '"'}) for i in range(300_000))
    (tmp_path / "large.json").write_text(f"[{text}]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        chunks = J.read_chunks(spark, str(tmp_path))
        assert chunks.select("block").distinct().count() >= 6 and chunks.count() >= len(text) >> 21
        good, bad = items.read_items(spark, str(tmp_path))
        got = sorted((int(r["id"]), len(r["question"])) for r in good.select("id", "question").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, 2 * (i % 50) + 1) for i in range(300_000)] and not bad.count()


def test_broken_items_keep_file_offset_and_whole_text(spark, tmp_path):
    long = '{"id": ' + "x" * 1000
    (tmp_path / "a.json").write_text('[{"id": "1"}, ' + long + '}, {"id": "2"}, 7, ,]')
    (tmp_path / "b.json").write_text('[{"id": "3"}, {"id": "4')
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text(" [ ] ")
    good, bad = items.read_items(spark, str(tmp_path))
    assert sorted(r["id"] for r in good.collect()) == ["1", "2", "3"]
    assert {(r["file_name"], r["record"]) for r in bad.collect()} >= {("a.json", long + "}"), ("a.json", "7")}
    assert {r["offset"] for r in bad.filter("record like '%xx%'").collect()} == {13}


def test_escapes_and_states_of_random_bytes():
    rng = random.Random(3)
    for _ in range(3000):
        data = bytes(rng.choice(b'\\"{}[],a') for _ in range(rng.randint(1, 30)))
        for quoted in (False, True):
            inside, escaped, depth, turns = quoted, False, 0, 0
            for c in data:
                if escaped:
                    escaped = False
                elif c == J.BACKSLASH:
                    escaped = True
                elif c == J.QUOTE:
                    inside, turns = not inside, turns + 1
                elif not inside:
                    depth += (c in b"[{") - (c in b"]}")
            marks = J.marks_of(np.frombuffer(data, np.uint8))
            assert marks.turns == turns and J.depth_changes(marks.byte)[marks.inside == quoted].sum() == depth
