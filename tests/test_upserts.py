"""A table by key: the last record counts, untouched buckets stay as they are, and half-done runs change nothing."""

import os

import pytest

from scoreloom.sources import upserts as up

SCHEMA = "arm string, q int, at long, text string, tags array<string>"
KEYS = ["arm", "q"]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(spark, *values):
    return spark.createDataFrame([(*v, ["t", None]) for v in values], SCHEMA)


def table(spark, path):
    return {(r.arm, r.q): (r.at, r.text) for r in up.upserted(spark, path).collect()}


def test_last_records_count(spark, tmp_path):
    path = str(tmp_path / "t")
    assert up.not_there(rows(spark, ("a", 1, 1, "x")), path).count() == 1
    first = [("a", i, 5, f"old {i}") for i in range(40)] + [(None, 1, 5, "null arm"), (None, None, 5, "nulls"), ("a", None, 5, None), ("a", 0, 4, "older"), ("a", 0, 6, "newer")]
    assert up.upsert(rows(spark, *first), path, KEYS, "at", buckets=8) == 0
    want = {(a, q): (at, text) for a, q, at, text in first}
    want["a", 0] = (6, "newer")
    assert table(spark, path) == want
    before = files(path)
    assert up.upsert(rows(spark, (None, None, 5, "nulls again"), (None, None, 4, "too old")), path, KEYS, "at") == 1
    want[None, None] = (5, "nulls again")
    assert table(spark, path) == want
    now = files(path)
    assert all(now[f] == t for f, t in before.items()) and len(now) == len(before) + 1  # one bucket was written
    up.upsert(rows(spark, (None, 1, 1, "late"), ("b", 7, 1, "new key")), path, KEYS, "at")
    want["b", 7] = (1, "new key")
    assert table(spark, path) == want and up.upserted(spark, path).first().tags == ["t", None]
    asked = rows(spark, (None, None, 0, ""), ("b", 7, 0, ""), ("b", 8, 0, ""), (None, 9, 0, ""))
    assert {(r.arm, r.q) for r in up.not_there(asked, path).collect()} == {("b", 8), (None, 9)}
    assert up.upserted(spark, path, 0).count() == 43
    assert up.vacuum(spark, path) == [0] and table(spark, path) == want
    with pytest.raises(Exception):
        up.upserted(spark, path, 0).count()
    assert up.upsert(rows(spark, ("a", 1, 1, "x")).limit(0), path, KEYS, "at") == 2
    with pytest.raises(ValueError, match="keys"):
        up.upsert(rows(spark, ("a", 1, 1, "x")), path, ["q"])


def test_without_an_order_the_new_one_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    up.upsert(rows(spark, ("a", 1, 9, "one")), path, KEYS)
    up.upsert(rows(spark, ("a", 1, 1, "two")), path, KEYS)
    assert table(spark, path) == {("a", 1): (1, "two")}


def test_runs_that_end_half_way_and_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    up.upsert(rows(spark, ("a", 1, 1, "one")), path, KEYS)
    monkeypatch.setattr(up, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        up.upsert(rows(spark, ("a", 1, 2, "lost")), path, KEYS)
    monkeypatch.undo()
    assert table(spark, path) == {("a", 1): (1, "one")}
    up.upsert(rows(spark, ("a", 1, 3, "two")), path, KEYS)
    assert table(spark, path) == {("a", 1): (3, "two")}
    told = up.manifest(spark, path)
    with pytest.raises(RuntimeError, match="another writer"):
        up._publish(spark, path, told)
    assert not [f for f in os.listdir(f"{path}/manifests") if f.startswith(".0") and not f.endswith(".crc")]
