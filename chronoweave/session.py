"""Session settings and lineage cutting.

The engine assumes ``timestamp_ntz`` time axes, ANSI mode (so parsing and
division use the ``try_*`` forms) and a UTC session zone.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "chronoweave", extra: dict | None = None) -> SparkSession:
    """Local/test session; on a cluster pass the cluster master and sizing."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, executor_cores_total: int,
                 target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Sizing for a cluster run: shuffle partitions so that each holds about
    ``target_partition_bytes`` (at least 3 waves of the cores), AQE
    coalescing/skew splitting at the same size, and scan splits of the same
    size.  Example: 100 TB on 8,000 cores -> 800,000 initial partitions that
    AQE coalesces where the data shrinks (aggregates, filters)."""
    parts = max(3 * executor_cores_total, input_bytes // target_partition_bytes)
    size = str(target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": size,
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name it (shared storage survives executor loss). Only a
    local-mode session without the setting gets a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before cutting lineage")
        d = tempfile.mkdtemp(prefix="cw-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: the plan restarts from a scan (with statistics and filter
    pushdown), and a lost executor re-reads files instead of recomputing.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def table_path(spark: SparkSession, name: str) -> str:
    """Location under the shared checkpoint folder for a written table."""
    return os.path.join(checkpoint_dir(spark), name)
