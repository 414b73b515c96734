"""The event store: repeated batches count once, a rebuild equals the kept state, damage is found."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skein.streaming.events import EventStore

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string"


def made(n=60, seed=1):
    r = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    return [(i, r.randrange(9), at + dt.timedelta(seconds=r.randrange(40)), r.choice(["view", "error", "click"])) for i in range(n)]


def want(rows):
    out = {}
    for i, u, ts, kind in rows:
        old = out.get(u, (None, 0, 0, (dt.datetime.min, -1)))
        newer = (ts, i) > old[3]
        out[u] = (kind if newer else old[0], old[1] + 1, old[2] + (kind == "error"), (ts, i) if newer else old[3])
    return {u: (s, c, e, k[0]) for u, (s, c, e, k) in out.items()}


def state(store, version=None):
    return {r.user_id: (r.status, r.changes, r.errors, r.latest) for r in store.projection(version).collect()}


def test_append_repeat_rebuild_verify(spark, tmp_path):
    rows = made()
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    store = EventStore(spark, f"file://{tmp_path}/s", buckets=4)
    assert store.epochs() == []
    assert store.append(frame([*rows[:20], rows[3], (None, 1, rows[0][2], "view"), (999, None, rows[0][2], "view")]), 0)
    assert store.append(frame(rows[20:40]), 1) and not store.append(frame(rows[20:40]), 1)
    assert store.append(frame(rows[35:60]), 2)  # five of them an epoch has already
    assert state(store) == want(rows) and state(store, 1) == want(rows[:20]) and state(store, 2) == want(rows[:40])
    assert store.verify().collect() == [] and store.events().count() == 60
    kept = state(store)
    store.rebuild()
    assert state(store) == kept and store.epochs() == [0, 1, 2]
    assert store.append(frame(rows[:0]), 3) and state(store) == kept


def test_a_failed_append_counts_for_nothing(spark, tmp_path):
    rows = made(30)
    store = EventStore(spark, f"file://{tmp_path}/s", buckets=4)
    store.append(spark.createDataFrame(rows[:15], SCHEMA), 0)
    late = spark.createDataFrame(rows[15:], SCHEMA)
    broken = late.withColumn("event_type", F.when(F.col("event_id") == 29, F.raise_error(F.lit("gone"))).otherwise(F.col("event_type")))
    with pytest.raises(Exception, match="gone"):
        store.append(broken, 1)
    assert store.epochs() == [0] and state(store) == want(rows[:15])
    store.append(late, 1)
    assert state(store) == want(rows)


def test_changed_logs_are_found(spark, tmp_path):
    rows = made(30)
    store = EventStore(spark, f"file://{tmp_path}/s", buckets=4)
    store.append(spark.createDataFrame(rows, SCHEMA), 0)
    spark.createDataFrame([(500, 3, rows[0][2], "error"), (501, 77, rows[0][2], "view")], SCHEMA).write.mode("append").parquet(f"file://{tmp_path}/s/log/epoch-0000000000")
    assert {r.user_id for r in store.verify().collect()} == {3, 77}


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = made(40)
    store = EventStore(spark, f"file://{tmp_path}/s", buckets=4)
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame(rows[:25], SCHEMA).coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    store.run(stream())
    assert state(store) == want(rows[:25])
    spark.createDataFrame(rows[25:], SCHEMA).repartition(2).write.mode("append").parquet(folder)
    store.run(stream())
    store.run(stream())
    assert state(store) == want(rows) and len(store.epochs()) == 3 and store.verify().collect() == []
