"""Time-axis repair: deltas, sampling resolution, gap report, gap fill.

W1 ts_delta, A7 resolution, A8 resolution_with_fallback, W2 gap_report,
W3 gap_fill.  Every ordered step goes through the bucketed helpers, so a
table with a single time axis and no key is still spread over many tasks.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, functions as F, types as T

from chronoweave.functions.joins import join_on_keys
from chronoweave.functions.ordered import Buckets, ordered_columns
from chronoweave.functions.timecols import add_micros, attach_scalars, micros_between
from chronoweave.operators.clean import NUMERIC, q

# Fixed values (the reference's defaults): fill value for inserted rows
# 999999.0, tolerance margin 0.5 s, resolution fallback 10.0 s.
FILL_VALUE = 999999.0
MARGIN_SECONDS = 0.5
FALLBACK_RESOLUTION_SECONDS = 10.0


def ts_delta(df: DataFrame, ts: str = "Timestamp", partition_by: list[str] | None = None,
             bucket: str | Buckets = "auto", prev_col: str = "prev_ts",
             delta_col: str = "delta_seconds") -> DataFrame:
    """Previous time stamp and the step to it in seconds (NULL on first row)."""
    d = ordered_columns(df, ts, partition_by=partition_by, bucket=bucket, lag={prev_col: q(ts)})
    return d.withColumn(delta_col, micros_between(prev_col, q(ts)) / F.lit(1e6))


def _steps(df: DataFrame, ts: str, partition_by, bucket: str | Buckets) -> DataFrame:
    keys = list(partition_by or [])
    d = ordered_columns(df.select(*[q(k) for k in keys], q(ts)), ts, partition_by=keys,
                        bucket=bucket, lag={"__prev": q(ts)})
    return d.withColumn("__step_us", micros_between("__prev", q(ts)))


def _mode_of_steps(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent step per key; ties go to the smallest step."""
    counted = (steps.where(F.col("__step_us").isNotNull())
               .groupBy(*[q(k) for k in keys], "__step_us").count())
    best = F.min_by(F.col("__step_us"), F.struct((-F.col("count")).alias("n"), F.col("__step_us")))
    return (counted.groupBy(*[q(k) for k in keys]).agg(best.alias("resolution_us"))
            .where(F.col("resolution_us").isNotNull())
            .withColumn("resolution_seconds", F.col("resolution_us") / F.lit(1e6)))


def resolution(df: DataFrame, ts: str = "Timestamp", partition_by: list[str] | None = None,
               bucket: str | Buckets = "auto") -> DataFrame:
    """Sampling resolution per key (one row per key having >= 2 rows).

    Columns: keys..., resolution_us (bigint), resolution_seconds (double).
    """
    keys = list(partition_by or [])
    return _mode_of_steps(_steps(df, ts, keys, bucket), keys)


def resolution_with_fallback(df: DataFrame, ts: str = "Timestamp",
                             partition_by: list[str] | None = None, bucket: str | Buckets = "auto",
                             fallback_seconds: float = FALLBACK_RESOLUTION_SECONDS,
                             margin: float = MARGIN_SECONDS) -> DataFrame:
    """Resolution, or ``fallback_seconds`` where none can be computed.

    Adds ``threshold_seconds`` = resolution + margin (the run-split step).
    Every key present in ``df`` gets a row; without keys exactly one row.
    One aggregate chain: each key's first row (no step) is counted too, so
    a key with a single row keeps a group whose best step is NULL.
    """
    keys = list(partition_by or [])
    steps = _steps(df, ts, keys, bucket)
    counted = steps.groupBy(*[q(k) for k in keys], "__step_us").count()
    # non-NULL steps first, then most frequent, then smallest
    best = F.min_by(F.col("__step_us"), F.struct(F.col("__step_us").isNull().alias("z"),
                                                 (-F.col("count")).alias("n"), F.col("__step_us").alias("s")))
    fb_us = int(round(fallback_seconds * 1e6))
    res = counted.groupBy(*[q(k) for k in keys]).agg(best.alias("resolution_us"))
    if not keys:
        # a table without rows still yields the one fallback row
        res = attach_scalars(df.agg(F.count(F.lit(1)).alias("__n")), res, ["resolution_us"]).drop("__n")
    return (res.withColumn("resolution_us", F.coalesce("resolution_us", F.lit(fb_us).cast("bigint")))
            .withColumn("resolution_seconds", F.col("resolution_us") / F.lit(1e6))
            .withColumn("threshold_seconds", F.col("resolution_seconds") + F.lit(float(margin))))


def _join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a per-key table (AQE broadcasts it once its size is measured);
    without keys it holds at most one row and is attached as a scalar."""
    if keys:
        return join_on_keys(big, small, keys, how)
    return attach_scalars(big, small, [c for c in small.columns])


def _report_with_res(df: DataFrame, ts: str, keys: list[str], margin: float, bucket: str | Buckets,
                     res: DataFrame | None) -> DataFrame:
    steps = _steps(df, ts, keys, bucket).where(F.col("__step_us").isNotNull())
    if res is None:
        res = _mode_of_steps(steps, keys)
    r = _join_small(steps, res.select(*[q(k) for k in keys], "resolution_us"), keys)
    gap = F.col("__step_us") / F.lit(1e6)
    res_s = F.col("resolution_us") / F.lit(1e6)
    missing = F.greatest(F.lit(0).cast("bigint"),
                         F.floor(F.try_divide(gap + F.lit(float(margin)), res_s)) - F.lit(1))
    return (r.where(F.abs(gap - res_s) > F.lit(float(margin)))
            .select(*[q(k) for k in keys],
                    F.col("__prev").alias("prev_ts"), q(ts).alias("curr_ts"),
                    gap.alias("gap_seconds"), missing.cast("bigint").alias("missing_samples"),
                    F.col("resolution_us")))


def gap_report(df: DataFrame, ts: str = "Timestamp", partition_by: list[str] | None = None,
               margin: float = MARGIN_SECONDS, bucket: str | Buckets = "auto",
               res: DataFrame | None = None) -> DataFrame:
    """Steps off the resolution by more than ``margin`` seconds.

    Long and short steps are both listed; missing_samples =
    max(0, floor((gap + margin) / res) - 1).  Keys with fewer than two rows
    have no resolution and report nothing.
    """
    keys = list(partition_by or [])
    return _report_with_res(df, ts, keys, margin, bucket, res).drop("resolution_us")


def _holds(dtype: T.DataType, value: float) -> bool:
    """Whether a numeric type represents ``value`` exactly; other types are not asked to."""
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}.get(type(dtype))
    if bits:
        return float(value).is_integer() and -2**bits <= value < 2**bits
    if isinstance(dtype, T.DecimalType):
        return abs(value) < 10 ** (dtype.precision - dtype.scale) and float(round(value, dtype.scale)) == float(value)
    if isinstance(dtype, T.FloatType):
        return struct.unpack("f", struct.pack("f", value))[0] == value
    return True


def gap_fill(df: DataFrame, ts: str = "Timestamp", partition_by: list[str] | None = None,
             fill_value: float = FILL_VALUE, margin: float = MARGIN_SECONDS,
             bucket: str | Buckets = "auto", chunk: int = 100_000,
             res: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert ``prev_ts + j*res`` (j = 1..missing) for every reported gap.

    Inserted rows hold ``fill_value`` in every measurement column (numeric
    columns; others NULL) and the key values of their series.  A numeric
    column too narrow for it becomes double, existing values included.  Returns
    ``(filled, report)``; ``filled`` is not sorted (sort once, at write).

    A long outage at a fine resolution inserts many rows from ONE report
    row, so the range is first cut into ``chunk``-sized pieces that are
    spread over tasks before they are expanded.
    """
    keys = list(partition_by or [])
    wide = {f.name: q(f.name).cast("double") for f in df.schema.fields
            if f.name not in (*keys, ts) and not _holds(f.dataType, fill_value)}
    df = df.withColumns(wide) if wide else df
    rep = _report_with_res(df, ts, keys, margin, bucket, res)
    need = rep.where(F.col("missing_samples") > 0)
    pieces = need.select(
        *[q(k) for k in keys], "prev_ts", "resolution_us", "missing_samples",
        F.explode(F.sequence(F.lit(0).cast("bigint"),
                             F.floor((F.col("missing_samples") - 1) / F.lit(chunk)).cast("bigint"))
                  ).alias("__chunk"))
    pieces = pieces.repartition(*[q(k) for k in keys], "prev_ts", "__chunk")
    lo = F.col("__chunk") * F.lit(chunk) + F.lit(1)
    hi = F.least(F.col("missing_samples"), (F.col("__chunk") + F.lit(1)) * F.lit(chunk))
    new_ts = (pieces.select(*[q(k) for k in keys], "prev_ts", "resolution_us",
                            F.explode(F.sequence(lo, hi)).alias("__j"))
              .select(*[q(k) for k in keys],
                      add_micros("prev_ts", F.col("__j") * F.col("resolution_us")).alias(ts)))
    fills = []
    for f in df.schema.fields:
        if f.name in keys or f.name == ts:
            continue
        if isinstance(f.dataType, NUMERIC):
            fills.append(F.lit(float(fill_value)).cast(f.dataType).alias(f.name))
        else:
            fills.append(F.lit(None).cast(f.dataType).alias(f.name))
    inserted = new_ts.select(*[q(k) for k in keys], q(ts), *fills).select(*[q(c) for c in df.columns])
    return df.unionByName(inserted), rep.drop("resolution_us")
