"""Snapshots: a refresh equals a rebuild, keeps the files it doesn't touch, and fails without a trace."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from skein.sources.snapshots import RefreshConflict, SnapshotStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/t", ("k", "g"), buckets=16)
    s.write(spark.createDataFrame([(i, f"g{i % 3}", f"v{i}") for i in range(40)] + [(None, "g0", None)], "k long, g string, v string"))
    return s


def delta(spark):
    new = spark.createDataFrame([(3, "g0", "new"), (900, "g0", None), (None, "g0", "was null")], "k long, g string, v string")
    return new, spark.createDataFrame([(5, "g2"), (3, "g0"), (77, "g1")], "k long, g string")


def test_refresh_equals_rebuild(spark, store, tmp_path):
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True)}
    old, first = rows(store.read()), store.manifest()
    assert store.refresh(*delta(spark)) == 2
    want = [r for r in old if r[0] not in (3, 5, None)] + [(3, "g0", "new"), (900, "g0", None), (None, "g0", "was null")]
    assert rows(store.read()) == sorted(want, key=repr)
    again = SnapshotStore(spark, f"file://{tmp_path}/again", ("k", "g"), buckets=16)
    again.write(spark.createDataFrame(want, "k long, g string, v string"))
    facts = lambda s: {b: (x["rows"], x["hash"]) for b, x in s.manifest()["files"].items()}
    assert facts(again) == facts(store) and store.verify() == []
    # the first version is as it was, and untouched buckets share their files
    assert rows(store.read(1)) == old and store.versions() == [1, 2]
    assert {f: os.stat(f).st_mtime_ns for f in before} == before
    kept = [b for b, x in store.manifest()["files"].items() if first["files"].get(b) == x]
    assert len(kept) >= 16 - 5 - (16 - len(first["files"]))


def test_changes_between_versions(spark, store):
    store.refresh(*delta(spark))
    assert rows(store.changed(1, 2)) == sorted([("changed", 3, "g0"), ("removed", 5, "g2"), ("added", 900, "g0"), ("changed", None, "g0")], key=repr)
    assert rows(store.changed(2, 2)) == []


def test_empty_refresh_and_empty_table(spark, store, tmp_path):
    new, gone = delta(spark)
    store.refresh(new.limit(0), gone.limit(0))
    assert store.manifest()["files"] == store.manifest(1)["files"]
    empty = SnapshotStore(spark, f"file://{tmp_path}/empty", ("k", "g"), buckets=4)
    empty.write(new.limit(0))
    assert rows(empty.read()) == [] and empty.read().columns == ["k", "g", "v"]
    empty.refresh(new)
    assert len(rows(empty.read())) == 3


def test_a_failed_refresh_leaves_the_old_state(spark, store):
    old = rows(store.read())
    new, gone = delta(spark)
    broken = new.withColumn("v", F.when(F.col("k") == 900, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        store.refresh(broken, gone)
    assert store.versions() == [1] and rows(store.read()) == old
    # two writers: the second finds its version taken
    slow = store.manifest()
    store.refresh(new, gone)
    with pytest.raises(RefreshConflict):
        store._publish({**slow, "version": 2})
    assert store.versions() == [1, 2]


def test_damage_is_found(spark, store, tmp_path):
    victim = next(iter(store.manifest()["files"].items()))
    for f in glob.glob(f"{tmp_path}/t/{victim[1]['path']}/*.parquet"):
        os.remove(f)
    spark.createDataFrame([(1, "x", "y")], "k long, g string, v string").write.mode("append").parquet(f"file://{tmp_path}/t/{victim[1]['path']}")
    assert int(victim[0]) in store.verify()
