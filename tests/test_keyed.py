"""Versioned tables: merges, deletes, old versions, conflicting writers, readers during writes."""

import threading

import pytest

from acopio.sources.keyed import Conflict, KeyedTable

SCHEMA = "k long, part string, x int, at int"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_merge_delete_and_versions(spark, tmp_path):
    held = KeyedTable(spark, f"file://{tmp_path}/t", ["k", "part"], buckets=4)
    with pytest.raises(ValueError):
        held.read()
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert held.merge(make((1, "a", 1, 1), (1, "a", 2, 2), (2, "a", 3, 1), (None, "a", 4, 1), (3, None, 5, 1)), order=["at"]) == 0
    first = [(1, "a", 2, 2), (2, "a", 3, 1), (3, None, 5, 1), (None, "a", 4, 1)]
    assert rows(held.read()) == sorted(first, key=str)
    assert held.merge(make((2, "a", 30, 9), (None, "a", 40, 9), (9, "z", 90, 9))) == 1
    assert rows(held.read()) == sorted([(1, "a", 2, 2), (2, "a", 30, 9), (3, None, 5, 1), (9, "z", 90, 9), (None, "a", 40, 9)], key=str)
    assert rows(held.read(0)) == sorted(first, key=str)
    assert held.delete(make((3, None, 0, 0), (77, "q", 0, 0))) == 2 and held.read().count() == 4
    assert held.merge(make()) == 3 and held.read().count() == 4
    assert held.merge(spark.createDataFrame([(5, "n", "new")], "k long, part string, note string")) == 4
    assert held.read().columns == ["k", "part", "note", "x", "at"] or set(held.read().columns) == {"k", "part", "x", "at", "note"}
    assert held.replace(make((7, "r", 7, 7))) == 5 and rows(held.read()) == [(7, "r", 7, 7)]
    assert held.delete() == 6 and held.read().count() == 0 and held.read(5).count() == 1
    again = KeyedTable(spark, f"file://{tmp_path}/t")
    assert again.keys == ["k", "part"] and again.buckets == 4 and again.versions() == list(range(7))
    with pytest.raises(ValueError):
        KeyedTable(spark, f"file://{tmp_path}/t", ["k"])
    with pytest.raises(ValueError):
        again.read(99)


def test_only_touched_buckets_are_written(spark, tmp_path):
    held = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=8)
    held.merge(spark.range(1000).selectExpr("id", "1 as v"))
    before = held._manifest()["folders"]
    held.merge(spark.range(1).selectExpr("id", "2 as v"))
    after = held._manifest()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert held.read().where("v = 2").count() == 1 and held.read().count() == 1000


def test_conflict_and_concurrent_readers(spark, tmp_path):
    held = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=4)
    held.merge(spark.range(200).selectExpr("id", "0 as v"))
    stale = held._manifest()
    held.merge(spark.range(10).selectExpr("id", "1 as v"))
    with pytest.raises(Conflict):
        held._commit(stale, held.read().schema, stale["folders"])
    assert held.versions() == [0, 1]
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            seen.append(tuple(sorted({r["v"] for r in held.read().select("v").distinct().collect()})))

    reader = threading.Thread(target=look)
    reader.start()
    for v in (5, 6):
        held.replace(spark.range(200).selectExpr("id", f"{v} as v"))
    stop.set()
    reader.join()
    assert seen and set(seen) <= {(0, 1), (5,), (6,)}
