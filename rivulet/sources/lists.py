"""Administrators' lists: followed and priority channels, blocklist, ad patterns, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PROFILE


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One channel id per line."""
    line = F.trim("value")
    return spark.read.text(path).where(line != "").select(line.cast("long").alias("chat_id"))


def read_lines(spark: SparkSession, path: str, name: str = "text") -> DataFrame:
    """One entry per line, only the line end removed."""
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias(name))


def append_lines(lines: DataFrame, path: str) -> None:
    lines.select(F.col(lines.columns[0]).alias("value")).write.mode("append").text(path)


def read_profiles(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Channel profiles as JSON lines: the snapshot of this version, by default the newest one; none where none were written yet.

    A path without snapshots is read as one.
    """
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return spark.createDataFrame([], PROFILE)
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.getFileStatus(where).isDirectory() else []
    # A snapshot counts when its writer has finished it.
    versions = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if any(n.startswith("version=") for n in names):
        wanted = max(versions, default=None) if version is None else version if version in versions else None
        return spark.read.schema(PROFILE).json(f"{path.rstrip('/')}/version={wanted}") if wanted is not None else spark.createDataFrame([], PROFILE)
    return spark.read.schema(PROFILE).json(path)


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, file_size, bytes`` of the files of a folder and those below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.col("content").alias("bytes"))


def write_profiles(profiles: DataFrame, path: str, version: int) -> str:
    """Write one snapshot; readers pick the version they want, so a failed write spoils nothing."""
    target = f"{path.rstrip('/')}/version={version}"
    profiles.write.mode("overwrite").json(target)
    return target
