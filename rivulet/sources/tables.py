"""Readers of parquet and JSON tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def spread_small(df: DataFrame) -> DataFrame:
    """Use all cores on an input that arrives in fewer splits than there are cores.

    Inputs with enough splits, so all large ones, are left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; malformed lines end up in ``_corrupt``."""
    full = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType(), True)])
    return spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
