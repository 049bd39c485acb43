"""Versioned tables: inserts, deletes with counts, old versions, two writers, compaction."""

import pytest

from nomenclia.sources.versions import Conflict, Versioned


def keys(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_changes(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), "k")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v string")
    assert t.version() == 0
    with pytest.raises(ValueError):
        t.read()
    assert t.insert(rows((1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "n"))) == 5
    old = t.read()
    assert t.delete("v = 'c'") == 2  # a key's rows go together
    assert t.delete("k is null") == 1 and t.delete("k = 77") == 0
    assert t.insert(rows((3, "again"))) == 1  # what comes after a delete stays
    assert keys(t.read()) == [(1, "a"), (2, "b"), (3, "again")]
    assert old.count() == 5 and len(t.read(1).collect()) == 5 and keys(t.read(2).where("k is not null")) == [(1, "a"), (2, "b")]
    assert t.version() == 5
    with pytest.raises(ValueError):
        t.read(9)
    assert t.compact() == 3 and [c.kind for c in t.changes()] == ["whole"] and keys(t.read()) == [(1, "a"), (2, "b"), (3, "again")]
    assert t.delete("k = 3") == 1 and keys(t.read()) == [(1, "a"), (2, "b")] and keys(t.read(6)) == [(1, "a"), (2, "b"), (3, "again")]
    assert t.replace(rows((9, "z"))) == 1 and keys(t.read()) == [(9, "z")]


def test_two_writers(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), "k")
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    t.insert(one)
    base = t.version()
    folder, count = t._write("rows", one)
    t.insert(spark.createDataFrame([(2, "b")], "k long, v string"))
    with pytest.raises(Conflict):
        t._commit(base, "rows", folder, count)
    assert keys(t.read()) == [(1, "a"), (2, "b")]  # what failed is seen by no one
    assert all(f.name.lstrip(".").split(".")[0].isdigit() for f in (tmp_path / "t" / "versions").iterdir())


def test_a_table_of_keys_alone(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), "k")
    assert t.insert(spark.range(0).select("id").withColumnRenamed("id", "k")) == 0 and t.read().count() == 0
    t.insert(spark.range(1000).withColumnRenamed("id", "k"))
    assert t.delete("k % 3 = 0") == 334 and t.read().count() == 666
