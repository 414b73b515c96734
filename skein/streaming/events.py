"""An event store: batches are appended once each, and a projection of them is kept in snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.snapshots import SnapshotStore
from skein.sources.staging import new_folder, stage


def folded(events: DataFrame) -> DataFrame:
    """``user_id, changes, errors, last``: events (user_id, event_id, ts, event_type) folded by entity; the last status is
    that of the latest event, of several at once that of the largest id."""
    last = F.max(F.struct("ts", "event_id", F.col("event_type").alias("status")))
    return events.groupBy("user_id").agg(F.count("*").alias("changes"), F.count_if(F.col("event_type") == "error").alias("errors"), last.alias("last"))


def merged(states: DataFrame) -> DataFrame:
    """Folded states of the same entities put together, in any order."""
    return states.groupBy("user_id").agg(F.sum("changes").alias("changes"), F.sum("errors").alias("errors"), F.max("last").alias("last"))


@dataclass
class EventStore:
    """Below ``root``: the log, a folder for each epoch, and the projection, a snapshot for each appended epoch.

    An epoch counts from the moment its snapshot's manifest exists, which names it. A batch that is repeated after that is
    passed over; one that failed before is written anew over what it left. A projection is built on the one before: an
    append reads and writes the buckets of its own entities only.
    """

    spark: SparkSession
    root: str
    buckets: int = 32

    @property
    def _state(self) -> SnapshotStore:
        return SnapshotStore(self.spark, f"{self.root}/projection", ("user_id",), self.buckets)

    def _folder(self, epoch: int) -> str:
        return f"{self.root}/log/epoch-{epoch:010d}"

    def epochs(self) -> list[int]:
        """Those that count, in order."""
        return self._state.manifest()["note"]["epochs"] if self._state.versions() else []

    def append(self, batch: DataFrame, epoch: int) -> bool:
        """Appends the events of one epoch; False if it is there already. Fits ``foreachBatch``. Events whose id an earlier
        epoch has, or that repeat in the batch, count once; those without id or entity are left out."""
        done = self.epochs()
        if epoch in done:
            return False
        new = batch.where("event_id IS NOT NULL AND user_id IS NOT NULL").dropDuplicates(["event_id"])
        if done:
            new = new.join(self.events().select("event_id"), "event_id", "left_anti").select(*batch.columns)
        new.write.mode("overwrite").option("compression", "zstd").parquet(self._folder(epoch))
        new = self.spark.read.schema(batch.schema).parquet(self._folder(epoch))
        states, note = stage(folded(new), "states"), {"epochs": [*done, epoch]}
        if not done:
            self._state.write(states, note)
            return True
        touched = [r[0] for r in states.select(self._state.bucket().alias("b")).distinct().collect()]  # at most one a bucket
        before = self._state.read(buckets=touched).join(states.select("user_id"), "user_id", "left_semi")
        self._state.refresh(stage(merged(before.unionByName(states)), "states"), note=note)
        return True

    def run(self, stream: DataFrame) -> None:
        """Appends what a stream's source holds now, each micro-batch as an epoch; the stream's own log goes on from the
        last time."""
        writer = stream.writeStream.option("checkpointLocation", f"{self.root}/stream").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, epoch: self.append(batch, epoch) and None).start().awaitTermination()

    def events(self) -> DataFrame:
        """The events of all epochs that count."""
        paths = [self._folder(e) for e in self.epochs()]
        schema = self.spark.read.parquet(paths[0]).schema
        return self.spark.read.schema(schema).parquet(*paths)

    def projection(self, version: int | None = None) -> DataFrame:
        """``user_id, status, changes, errors, latest`` after the last epoch, or as it was in a version."""
        return self._state.read(version).select("user_id", "last.status", "changes", "errors", F.col("last.ts").alias("latest"))

    def verify(self) -> DataFrame:
        """``user_id`` of every entity whose projection isn't what its events give: none, unless files were changed."""
        a, b = folded(self.events()).alias("a"), self._state.read().alias("b")
        same = F.col("a.changes").eqNullSafe(F.col("b.changes")) & F.col("a.errors").eqNullSafe(F.col("b.errors")) & F.col("a.last").eqNullSafe(F.col("b.last"))
        return a.join(b, F.col("a.user_id") == F.col("b.user_id"), "full_outer").where(~same).select(F.coalesce("a.user_id", "b.user_id").alias("user_id"))

    def rebuild(self) -> int:
        """A new snapshot from the events alone."""
        return self._state.write(folded(self.events()), {"epochs": self.epochs()})


def in_epochs(events: DataFrame, n: int) -> EventStore:
    """A new store with the events dealt to ``n`` epochs, one of them sent twice."""
    store = EventStore(events.sparkSession, new_folder(events.sparkSession, "events"))
    for epoch in [*range(n), n // 2]:
        store.append(events.where(F.pmod("event_id", F.lit(n)) == epoch), epoch)
    return store
