"""Sources and sinks: repository files, commit logs, JSON facts; graph exports with rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalars import base_name, clean_text, looks_binary

#: Language by file ending.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust",
    "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cs": "csharp", "rb": "ruby",
    "php": "php", "swift": "swift", "cbl": "cobol", "cob": "cobol", "md": "markdown",
}


def walk(spark: SparkSession, root: str, max_kb: int = 512, ignore: list[str] | None = None) -> DataFrame:
    """``path, size, modified``: files below ``root`` up to a size, without those that an ignore expression matches.

    Only listings are read: the content column is pruned.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    f = f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(F.col("size") <= max_kb * 1024)
    for pattern in ignore or []:
        f = f.where(~F.col("path").rlike(pattern))
    return f


def read_files(spark: SparkSession, root: str, max_kb: int = 512) -> DataFrame:
    """``path, language, content`` of text files; binary ones are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_kb * 1024)
    t = f.select("path", F.col("content").cast("string").alias("content"))
    ending = F.lower(F.regexp_extract(base_name(F.col("path")), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return t.where(~looks_binary(F.col("content"))).select("path", F.element_at(table, ending).alias("language"), clean_text(F.col("content")).alias("content"))


def commits(log: DataFrame, column: str = "value") -> DataFrame:
    """``sha, author, ts, files`` from commit records: a head ``sha<TAB>author<TAB>epoch``, then one file per line.

    Each row holds one record, as the text source gives with its line separator set to the record mark.
    """
    parts = F.split(F.trim(column), "\n")
    head = F.split(F.element_at(parts, 1), "\t")
    rows = log.where(F.size(head) >= 3)
    files = F.array_distinct(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.trim(x) != ""))
    return rows.select(head[0].alias("sha"), head[1].alias("author"), F.timestamp_seconds(head[2].cast("long")).alias("ts"), files.alias("files"))


def read_commits(spark: SparkSession, path: str, mark: str = "\x1e") -> DataFrame:
    return commits(spark.read.option("lineSep", mark).text(path))


def hunks(diff: DataFrame, column: str = "value") -> DataFrame:
    """``file, start, end`` of the new side of unified diffs, one diff per row."""
    files = F.slice(F.split(column, r"(?m)^\+\+\+ b/"), F.lit(2), F.lit(1 << 30))
    one = diff.select(F.explode(files).alias("f")).select(F.regexp_extract("f", r"^([^\n]*)", 1).alias("file"), F.explode(F.regexp_extract_all("f", F.lit(r"@@ -\S+ \+(\d+(?:,\d+)?) @@"), F.lit(1))).alias("h"))
    a = F.substring_index("h", ",", 1).cast("int")
    n = F.when(F.instr("h", ",") > 0, F.substring_index("h", ",", -1).cast("int")).otherwise(1)
    return one.select("file", a.alias("start"), (a + n - 1).alias("end")).where("end >= start")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label and edges by type as Parquet; edges without both ends go to ``rejects``."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    ids = nodes.select("id").distinct()
    good = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    good.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    a = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    b = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    a.unionByName(b).write.mode("overwrite").parquet(f"{path}/rejects")


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON object per line, nodes and edges under ``kind``."""
    rows = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("record")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("record")))
    rows.write.mode("overwrite").json(path)


def without_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of some files (``path``) and their edges."""
    gone = nodes.join(files, nodes["path"] == files["path"], "left_semi").select("id")
    kept = nodes.join(gone, "id", "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, e
