"""The cleaning steps that need no global order, applied to a stream.

Rows arrive through ``readStream``: bad time stamps are dropped (P6),
duplicate time stamps are averaged inside a watermark (A2, state bounded by
the watermark), then device-fault values become NULL (P9), keeping the
reference's order (unify before sentinel removal).  Gap handling needs the
whole axis and stays a batch step on the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from chronoweave.operators import clean


def clean_stream(stream: DataFrame, ts: str = "Timestamp", partition_by: list[str] | None = None,
                 fault_columns=clean.DEFAULT_FAULT_COLUMNS, fault_sentinels=clean.DEFAULT_FAULT_SENTINELS,
                 atol: float = clean.DEFAULT_ATOL, watermark: str | None = None,
                 unify: bool = True, non_numeric: str = "error") -> DataFrame:
    """The row-level steps on a stream; text columns are treated as in the batch step.

    Unifying needs a bound on lateness, which only the caller knows: rows
    later than ``watermark`` are left out of their time stamp's mean and
    counted by the running query (see ``late_rows``).
    """
    if unify and not watermark:
        raise ValueError("unify needs a watermark: how late a row may come")
    d = clean.drop_invalid_ts(stream, ts)
    if unify:
        # event-time watermarks need a session-zone timestamp: convert for the
        # stateful step and back (exact in a UTC session)
        d = d.withColumn(ts, clean.q(ts).cast("timestamp")).withWatermark(ts, watermark)
        d = clean.unify_duplicates(d, ts, partition_by, non_numeric=non_numeric)
        d = d.withColumn(ts, clean.q(ts).cast("timestamp_ntz"))
    return clean.sentinel_to_null(d, fault_columns, fault_sentinels, atol)


def late_rows(query) -> int:
    """Rows left out because they came after the watermark, in the recent batches whose progress the query still holds
    (``spark.sql.streaming.numRecentProgressUpdates``, 100 by default); earlier batches are not counted."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def start(stream: DataFrame, sink_path: str, checkpoint: str, **kw):
    """Run ``clean_stream`` into parquet files (append: a time stamp is final
    once the watermark has passed it)."""
    return (clean_stream(stream, **kw).writeStream.format("parquet").outputMode("append")
            .option("path", sink_path).option("checkpointLocation", checkpoint).start())
