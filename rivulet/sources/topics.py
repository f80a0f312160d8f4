"""Message topics: Kafka where its connector is present, a folder of files otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def read_kafka(spark: SparkSession, servers: str, topics: list[str], starting: str = "latest") -> DataFrame:
    """Records of several topics in one subscription; offsets live in the query's checkpoint."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", starting).option("includeHeaders", "true")
        .load().withColumn("value", F.col("value").cast("string"))
    )


def read_folder(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream of parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def as_records(records: DataFrame) -> DataFrame:
    """``key, partition, headers`` as far as they are there, and all other columns as JSON in ``value``."""
    own = [c for c in ("key", "partition", "headers") if c in records.columns]
    return records.select(*own, F.to_json(F.struct(*[c for c in records.columns if c not in own])).alias("value"))


def from_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse: ``value`` read by its declared schema; ``_corrupt`` holds a value that cannot be read, null otherwise."""
    full = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType(), True)])
    read = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rest = [c for c in records.columns if c != "value"]
    return records.select(*rest, F.coalesce(read, F.struct(*[(F.col("value") if f.name == "_corrupt" else F.lit(None)).cast(f.dataType).alias(f.name) for f in full.fields])).alias("_v")).select(*rest, "_v.*")


def write_kafka(records: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Keyed records with partition and headers carried over, as JSON."""
    return (
        as_records(records).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("topic", topic).option("checkpointLocation", checkpoint)
    )


def write_folder(records: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same records as files of a folder that :func:`read_folder` reads as a stream."""
    return as_records(records).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def write_nowhere(records: DataFrame, checkpoint: str) -> DataStreamWriter:
    """Stand-in sink where running without Kafka is allowed."""
    return records.writeStream.format("noop").option("checkpointLocation", checkpoint)
