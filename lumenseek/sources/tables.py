"""Tracked files from tables and directories, in the shape that the index takes: path, blob_sha, raw_sha, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.functions import hashing


def from_table(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """One file per row; the id is that of its bytes. Rows without a path or content are dropped, as missing files are."""
    rows = df.select(path.cast("string").alias("path"), content.cast("binary").alias("content"))
    rows = rows.where("path IS NOT NULL AND content IS NOT NULL")
    return rows.select("path", hashing.git_blob_sha(F.col("content")).alias("blob_sha"), F.lit(False).alias("raw_sha"), "content")


def from_directory(spark: SparkSession, directory: str, glob: str | None = None) -> DataFrame:
    """All files below a directory of any store that Spark reads, with paths relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(directory)
    root = spark._jvm.org.apache.hadoop.fs.Path(directory)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    plain = F.regexp_replace("path", "^([a-z]+:)/+", "$1/")
    prefix = F.regexp_replace(F.lit(root), "^([a-z]+:)/+", "$1/")
    path = F.when(F.startswith(plain, prefix), F.substring(plain, F.length(prefix) + 1, F.length(plain))).otherwise(F.col("path"))
    return from_table(files, path, F.col("content"))


def documents_as_files(documents: DataFrame) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return from_table(documents, path, F.col("text"))
