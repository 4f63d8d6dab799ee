"""Tables of a folder, scratch tables in the shared folder, and tolerant readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
        found = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with a short lineage, kept when executors go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shared: dict[tuple[str, str, str], tuple[list, str]] = {}


def files_state(spark: SparkSession, folder: str) -> list[tuple]:
    """(path, length, files, modification time) of each table of a folder; a table of many files has the time of its own folder."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    fs = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    said = lambda f, c: (f.getPath().toString(), c.getLength(), c.getFileCount(), f.getModificationTime())
    return sorted(said(f, fs.getContentSummary(f.getPath())) for f in fs.globStatus(glob) or [])


def shared_path(spark: SparkSession, folder: str, name: str, make) -> str:
    """The path that make(spark, folder, path) has filled, once for an application and the state of a folder's files.

    It is made anew if the files have changed or the path has gone; what was made of other files is deleted.
    """
    key, state = (spark.sparkContext.applicationId, folder, name), files_state(spark, folder)
    was, path = _shared.get(key, (None, None))
    if was != state or not there(spark, path):
        if path:
            delete(spark, path)
        path = f"{shared_dir(spark)}/quill-{name}-{uuid.uuid4().hex}"
        make(spark, folder, path)
        _shared[key] = state, path
    return path


def shared(spark: SparkSession, folder: str, name: str, make) -> DataFrame:
    """make(spark, folder) as a table that the queries of a session share."""
    return spark.read.parquet(shared_path(spark, folder, name, lambda s, f, path: make(s, f).write.parquet(path)))


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents by an explicit schema, one to a file or one to a line; a path that isn't there gives no rows."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path) if there(spark, path) else spark.createDataFrame([], schema)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files; an error if there are none."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, size, modified) of files; a folder that isn't there gives none."""
    schema = "path string, name string, size bigint, modified timestamp"
    if not there(spark, folder):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_registry(spark: SparkSession, path: str, row: str) -> DataFrame:
    """A registry document, a JSON map of rows by file_id, as one row for each file."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{row}>>").alias("m"))
    return whole.select(F.explode("m").alias("file_id", "row")).select("file_id", "row.*")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seed): a JSON array if the text begins with [, else one for each line."""
    text = F.trim(F.col("value"))
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, r"\r?\n"))
    return spark.read.text(path, wholetext=True).select(F.explode(items).alias("seed")).select(F.trim("seed").alias("seed")).where("seed <> ''")


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled edges: every cell trimmed, missing ones as empty text."""
    schema = "source_doi string, target_doi string, source_title string, target_title string, label string, n_contexts string, reason string"
    rows = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return rows.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in rows.columns])


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last by order, as a later write replaces an earlier one."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("__r", r).where("__r = 1").drop("__r")
