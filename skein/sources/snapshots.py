"""Tables in snapshots: rows in buckets by key, a manifest for each version, refreshes that rewrite only the buckets they touch.

A version is a manifest: where each bucket's files are, how many rows they have, and the sum of the rows' hashes. Files are
written first and never changed; a version exists from the moment its manifest does, which appears whole under its name. So a
write that fails leaves the version before, readers of an old version keep it, and versions share the buckets that are alike.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skein.sources.staging import CLEANUP, settings

BUCKET = "_bucket"


class RefreshConflict(RuntimeError):
    """Another writer made this version first."""


def _row_hash(columns: list[str]) -> Column:
    """Of a whole row; sums of it don't depend on the order of rows."""
    cells = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]  # hashes pass nulls over
    return F.xxhash64(*cells).cast("decimal(38,0)")


@dataclass
class SnapshotStore:
    """A table below ``root`` whose rows are dealt to ``buckets`` by a hash of ``key``. The manifest has a line a bucket,
    so its size doesn't grow with the rows; more rows want more buckets, which are fixed when the table is first written."""

    spark: SparkSession
    root: str
    key: tuple[str, ...]
    buckets: int = 64

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Versions in order; none before the first write."""
        at = self._path("manifests")
        fs = self._fs(at)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """That of ``version``, the last by default."""
        if version is None:
            version = self.versions()[-1]
        at = self._path(f"manifests/v{version:08d}.json")
        stream = self._fs(at).open(at)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        to, draft = self._path(f"manifests/v{manifest['version']:08d}.json"), self._path(f"drafts/{uuid.uuid4().hex}")
        fs = self._fs(to)
        fs.mkdirs(to.getParent())
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if fs.exists(to) or not fs.rename(draft, to):
            fs.delete(draft, False)
            raise RefreshConflict(f"version {manifest['version']} is there already")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, version: int) -> dict[str, dict]:
        """Files of the rows by bucket, and the manifest's lines for these."""
        folder = f"data/v{version:08d}-{uuid.uuid4().hex[:8]}"
        # buckets of many rows are split into several tasks
        dealt = df.withColumn(BUCKET, self.bucket()).hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *self.key)
        with settings(self.spark, {CLEANUP: "true"}):  # shuffle files go when the write ends
            dealt.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        back = self.spark.read.schema(StructType([*df.schema.fields, StructField(BUCKET, IntegerType())])).parquet(f"{self.root}/{folder}")
        lines = back.groupBy(BUCKET).agg(F.count("*").alias("rows"), F.sum(_row_hash(df.columns)).cast("string").alias("hash")).collect()  # one a bucket
        return {str(r[BUCKET]): {"path": f"{folder}/{BUCKET}={r[BUCKET]}", "rows": r["rows"], "hash": r["hash"]} for r in lines}

    def write(self, df: DataFrame, note: dict | None = None) -> int:
        """All rows of ``df`` as the next version. ``note`` is kept in its manifest."""
        version = (self.versions() or [0])[-1] + 1
        self._publish({"version": version, "buckets": self.buckets, "schema": df.schema.jsonValue(), "files": self._write(df, version), "note": note or {}})
        return version

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, of the given buckets only if there are any given."""
        found = self.manifest(version)
        files = {int(b): x["path"] for b, x in found["files"].items() if buckets is None or int(b) in set(buckets)}
        schema = StructType.fromJson(found["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{files[b]}" for b in sorted(files)))

    def refresh(self, upserts: DataFrame, deletes: DataFrame | None = None, note: dict | None = None) -> int:
        """The next version: rows of the keys in ``upserts`` replaced or added, those in ``deletes`` (the key's columns)
        gone; a key in both is replaced. ``upserts`` has the table's columns and all rows of its keys. Only buckets that hold one
        of these keys are read and written, the others keep their files; without changes the version has the same files."""
        before = self.manifest()
        if before["buckets"] != self.buckets:
            raise ValueError(f"the table has {before['buckets']} buckets")
        schema = StructType.fromJson(before["schema"])
        new = upserts.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))
        keys = new.select(*self.key)
        keys = keys.unionByName(deletes.select(*self.key)) if deletes is not None else keys
        touched = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # at most one a bucket
        files = {b: x for b, x in before["files"].items() if int(b) not in set(touched)}
        version = before["version"] + 1
        if touched:
            stay = self.read(before["version"], touched).alias("a").join(keys.distinct().alias("b"), _same(self.key), "left_anti")
            files |= self._write(stay.unionByName(new), version)
        self._publish({**before, "version": version, "files": files, "note": note or {}})
        return version

    def changed(self, old: int, new: int) -> DataFrame:
        """``kind`` (added, removed, changed) and the key of every row that differs between two versions. Buckets of equal
        files or of equal count and hash aren't read."""
        a, b = self.manifest(old)["files"], self.manifest(new)["files"]
        same = {k for k in a.keys() & b.keys() if (a[k]["rows"], a[k]["hash"]) == (b[k]["rows"], b[k]["hash"])}
        differ = [int(k) for k in (a.keys() | b.keys()) - same]
        both = []
        for version, mark in ((old, "old"), (new, "new")):
            rows = self.read(version, differ)
            both.append(rows.select(*self.key, _row_hash(rows.columns).alias(mark)))
        x = both[0].alias("a").join(both[1].alias("b"), _same(self.key), "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
        kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        return x.select(kind.alias("kind"), *(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in self.key))

    def verify(self, version: int | None = None) -> list[int]:
        """Buckets whose rows differ from what the manifest says of them."""
        found = self.manifest(version)
        rows = self.read(version)
        have = {str(r["b"]): (r["n"], r["h"]) for r in rows.groupBy(self.bucket().alias("b")).agg(F.count("*").alias("n"), F.sum(_row_hash(rows.columns)).cast("string").alias("h")).collect()}
        want = {b: (x["rows"], x["hash"]) for b, x in found["files"].items()}
        return sorted(int(b) for b in have.keys() | want.keys() if have.get(b) != want.get(b))


def _same(key: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out
