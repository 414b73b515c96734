"""Staged tables: intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a master on one machine gets a temporary folder, and any
    other raises: a folder of its own on each executor would lose rows."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skein-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


#: Spark forgets broadcasts, shuffles and plans of finished jobs when the driver's garbage is collected, which a driver that
#: only plans seldom does by itself: long iterations ask for it once in so many staged tables.
CLEAN_EVERY = 6
_staged = itertools.count(1)


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings with ``wanted`` for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str, broadcast: bool = True) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and survives lost executors.

    The write's shuffle files serve nothing afterwards, so Spark is told to drop them when it ends. ``broadcast=False``
    keeps Spark from broadcasting join sides: rounds over tables that grow with the input gain nothing from it, and every
    one costs the driver threads and memory.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with settings(spark, {CLEANUP: "true"} | ({} if broadcast else {_BROADCAST: "-1"})):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if next(_staged) % CLEAN_EVERY == 0:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        path = getattr(df, "_skein_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
