"""Shared helpers: written intermediate tables, Arrow batch size, id folds."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import checkpoint_dir

BATCH_ROWS = 512


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches at ``rows`` rows: a Python worker then never holds
    more than that many whole texts at once, however large the partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs run inside, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession):
    """Jobs run inside drop their shuffle files when they end, and not when the driver next collects garbage.

    A later job over the same frame writes its shuffles anew.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read
    back: lineage ends there, its shuffle files go, and a lost executor re-reads files."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    with freed_shuffles(spark):
        df.write.options(**options).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of this library's own in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Intermediate tables of one operator, removed together at the end of a ``with`` block.

    What the operator returns may only read tables written outside the block's
    care (``keep=True``), since the others are gone by then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Tables":
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def drop(self) -> None:
        """Remove the tables written so far, where a ``with`` block does not fit."""
        while self.paths:
            removed(self.spark, self.paths.pop())

    def written(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = shared_path(self.spark, name)
        if not keep:
            self.paths.append(path)
        return written(df, name, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whichever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def crc_fold(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
