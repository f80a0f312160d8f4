"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}
# Shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, app: str = "rivulet", **conf) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="rivulet-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that :func:`settle` writes inside, when everything that reads them is done.

    For code that writes its results, such as the work of a micro-batch. What a function returns must not depend on tables of the scope.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared checkpoint folder and read it back.

    This cuts the lineage between the rounds of iterative operators. The table
    survives the loss of an executor, unlike a local checkpoint, and stays
    columnar, unlike an RDD checkpoint. What was shuffled for it goes when it is written. Inside :func:`scratch` it goes when the scope ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    if stack := getattr(_scopes, "stack", None):
        stack[-1].append(path)
    with _without_leftovers(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def condense(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``settle(make())``, after which the tables that ``make`` settled go. Nothing else may read them."""
    stack = _scopes.__dict__.setdefault("stack", [])
    paths: list[str] = []
    try:
        stack.append(paths)
        try:
            df = make()
        finally:
            stack.pop()
        return settle(df)
    finally:
        for path in paths:
            _remove(spark, path)


def is_settled(df: DataFrame) -> bool:
    return "_settled_at" in df.__dict__


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`settle` gave and that nothing will read again; other tables stay."""
    for table in filter(is_settled, tables):
        _remove(table.sparkSession, table._settled_at)
