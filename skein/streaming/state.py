"""Stateful operators in Structured Streaming: event projection, windowed counts, deduplication, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.sources.staging import new_folder


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what its source holds now and return its rows as a table.

    Every micro-batch goes to a folder of its own under the shared folder, overwritten if the batch is repeated after a
    failure, so each batch counts once. With ``keys`` (update mode) the latest row of each key stays.
    """
    spark = stream.sparkSession
    out, log = new_folder(spark, "stream"), new_folder(spark, "stream-log")
    schema = stream.schema

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("__epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(put)
    writer.start().awaitTermination()
    got = spark.read.schema(StructType([*schema.fields, StructField("__epoch", IntegerType())])).option("recursiveFileLookup", "true").parquet(out)
    names = [c for c in schema.names if c != "__epoch"]
    if keys:
        last = got.groupBy(*keys).agg(F.max_by(F.struct(*names), "__epoch").alias("r"))
        return last.select("r.*")
    return got.select(*names)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream, with timestamps of the session's zone."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, every: str, late: str) -> DataFrame:
    """Counts and sums per window and kind, under a watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.col("w.start").alias("start"), "event_type", "n", "ids")


def first_of_each(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The rows whose keys were not seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


PROJECTION = "user_id long, status string, changes long, errors long, latest timestamp"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds the events of one entity in order into (status, changes, errors, time and id of the last one)."""
    status, changes, errors, at, last = state.get if state.exists else (None, 0, 0, None, -1)
    for pdf in frames:
        for ts, event_id, kind in pdf[["ts", "event_id", "event_type"]].sort_values(["ts", "event_id"]).itertuples(index=False):
            changes += 1
            errors += kind == "error"
            t = int(pd.Timestamp(ts).value)
            if at is None or (t, event_id) > (at, last):
                status, at, last = kind, t, int(event_id)
    state.update((status, int(changes), int(errors), at, last))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "changes": [changes], "errors": [errors], "latest": [pd.Timestamp(at)]})


def projection(events: DataFrame) -> DataFrame:
    """The event log folded to one row per user, kept in state across micro-batches."""
    own = events.select("user_id", "event_id", "ts", "event_type")
    return own.groupBy("user_id").applyInPandasWithState(_fold, PROJECTION, "status string, changes long, errors long, at long, last long", "update", GroupStateTimeout.NoTimeout)
