"""Stored datasets: built once, with a small statistics sidecar, rebuilt only when their input files change
(S6 build-once table, S7 table read, S11 cache, A5 bounds and A8 resolution without a scan).

A dataset is a folder of versions.  The builder's plan runs once, in the
staging write of a new version; row count and time bounds are observed in that
same job.  A version counts from the moment its sidecar is there, which is
written last, so readers never see half of one; older versions go after that.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from chronoweave.functions.ordered import TARGET_ROWS, Buckets
from chronoweave.operators import gaps
from chronoweave.operators.clean import q

STATS = ("version string, built_us bigint, input_mark string, row_count bigint, ts_min timestamp_ntz, ts_max timestamp_ntz, "
         "resolution_us bigint, densest_month_rows bigint")


@dataclass(frozen=True)
class Stored:
    """A stored table and what its sidecar says: one row with the columns of ``STATS``."""

    table: DataFrame
    stats: DataFrame
    row_count: int
    ts_min: dt.datetime | None
    ts_max: dt.datetime | None
    resolution_us: int
    densest_month_rows: int
    version: str

    @property
    def bucket(self) -> str | Buckets:
        """Buckets for ordered windows over the whole time axis: months, if the stored counts say that they are small enough."""
        return Buckets() if self.densest_month_rows <= TARGET_ROWS else "auto"

    def resolution(self, margin: float = gaps.MARGIN_SECONDS) -> DataFrame:
        """The stored resolution in the form of ``gaps.resolution_with_fallback``."""
        seconds = F.col("resolution_us") / F.lit(1e6)
        return self.stats.select("resolution_us", seconds.alias("resolution_seconds"),
                                 (seconds + F.lit(float(margin))).alias("threshold_seconds"))

    def bounds(self) -> DataFrame:
        return self.stats.select("ts_min", "ts_max")


def input_mark(spark: SparkSession, inputs: list[str]) -> str:
    """What tells one state of the input files from another: their number, bytes, and a digest over name, size and time.

    The files are listed and summed up by Spark; one row reaches the driver.
    """
    files = spark.read.format("binaryFile").load(inputs).select("path", "length", "modificationTime")
    one = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b"),
                    F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)).alias("x")).first()
    return f"{one['n']}:{one['b']}:{one['x']}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _committed(spark: SparkSession, path: str) -> list[str]:
    """Versions with a finished sidecar."""
    fs, p = _fs(spark, f"{path}/stats-*/_SUCCESS")
    return sorted(s.getPath().getParent().getName().removeprefix("stats-") for s in (fs.globStatus(p) or []))


def _read(spark: SparkSession, path: str, version: str) -> Stored:
    stats = spark.read.schema(STATS).parquet(f"{path}/stats-{version}")
    r = stats.first()
    return Stored(spark.read.parquet(f"{path}/data-{version}"), stats, r["row_count"], r["ts_min"], r["ts_max"],
                  r["resolution_us"], r["densest_month_rows"], version)


def stored(spark: SparkSession, path: str) -> Stored | None:
    """The last committed version of a dataset, or None."""
    versions = _committed(spark, path)
    if not versions:
        return None
    built = spark.read.schema(STATS).parquet(*[f"{path}/stats-{v}" for v in versions])
    return _read(spark, path, built.orderBy(F.col("built_us").desc()).first()["version"])


def build(spark: SparkSession, path: str, builder: Callable[[], DataFrame], ts: str = "Timestamp",
          inputs: list[str] | None = None) -> Stored:
    """The stored dataset at ``path``, built if there is none or if ``inputs`` are not those it was built from.

    Without ``inputs`` an existing version is never stale.  A builder that
    gives no rows raises ValueError and leaves what was there.  The table is
    range-partitioned by time, sorted inside tasks and laid out by month
    (``ts_month``); the sidecar holds row count, time bounds, resolution (with
    the fallback) and the rows of the densest month.
    """
    before = stored(spark, path)
    mark = input_mark(spark, inputs) if inputs else None
    if before is not None:
        known = before.stats.first()["input_mark"]
        if mark is None or mark == known:
            return before
    version, seen = uuid.uuid4().hex, Observation()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = builder().withColumn("ts_month", F.date_format(q(ts), "yyyy-MM"))
    rows = rows.repartitionByRange(n, q(ts)).sortWithinPartitions(q(ts)).observe(
        seen, F.count(F.lit(1)).alias("row_count"), F.min(q(ts)).cast("string").alias("ts_min"),
        F.max(q(ts)).cast("string").alias("ts_max"))
    data = f"{path}/data-{version}"
    rows.write.partitionBy("ts_month").parquet(data)
    fs, p = _fs(spark, data)
    if not seen.get["row_count"]:
        fs.delete(p, True)
        raise ValueError(f"building {path!r} gave no rows")
    table = spark.read.parquet(data)
    dense = table.groupBy("ts_month").count().agg(F.max("count")).first()[0]
    found = gaps.resolution_with_fallback(table.select(q(ts)), ts, bucket=Buckets() if dense <= TARGET_ROWS else "auto").first()
    low, high = (v and dt.datetime.fromisoformat(v) for v in (seen.get["ts_min"], seen.get["ts_max"]))
    row = (version, time.time_ns() // 1000, mark, seen.get["row_count"], low, high, found["resolution_us"], dense)
    spark.createDataFrame([row], STATS).coalesce(1).write.parquet(f"{path}/stats-{version}")
    if before is not None:  # readers of the old version have until now; its sidecar goes first
        for part in ("stats", "data"):
            fs.delete(_fs(spark, f"{path}/{part}-{before.version}")[1], True)
    return _read(spark, path, version)
