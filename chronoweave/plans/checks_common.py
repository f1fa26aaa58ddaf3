"""Shared inputs for the registered queries: driver tables and derived series.

Each query reads the given tables (or data Spark derives from them), so its
work grows with them.  The DuckDB oracle text for the same inputs sits next
to each Spark form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoweave.functions.timecols import to_ntz


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular keyed series: 1-minute mean of events.value per event_type."""
    e = table(spark, sf_dir, "events")
    return (e.groupBy("event_type", to_ntz(F.date_trunc("minute", "ts")).alias("ts"))
            .agg(F.avg("value").alias("value")))


EVENTS_MINUTE_SQL = ("SELECT event_type, date_trunc('minute', ts) AS ts, avg(value) AS value "
                     "FROM events GROUP BY ALL")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-axis series: orders by o_orderdate (duplicates unified by mean)."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    return o.groupBy("o_orderdate").agg(F.avg("o_totalprice").alias("o_totalprice"))


ORDERS_DAILY_SQL = ("SELECT o_orderdate, avg(o_totalprice) AS o_totalprice "
                    "FROM orders GROUP BY o_orderdate")


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)
