"""Chart-query operators on one time axis (P1 P2 P3 P10 A5 O1 S8 W7, time labels)."""

from __future__ import annotations

import datetime as _dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronoweave.functions.ordered import Buckets, ordered_positions
from chronoweave.operators.clean import q
from chronoweave.operators.quality import is_valid

# Fixed values (the reference's display constants): 600 points per series on
# the live chart; positional viewer window max(200 rows, 10 % of rows);
# 5 sample rows; time label format "%Y-%m-%d\n%H:%M:%S".
DEFAULT_POINTS = 600
WINDOW_MIN_ROWS = 200
WINDOW_FRACTION_DIVISOR = 10
SAMPLE_ROWS = 5
TS_LABEL_FORMAT = "yyyy-MM-dd\nHH:mm:ss"
MONTH_COLUMN = "ts_month"  # partition column of materialised tables (yyyy-MM)


def selector_decode(code: Column) -> Column:
    """``comp::mode::col`` -> struct(component, mode, column); split at most twice.

    A code without ``::`` is a plain column name (component and mode NULL).
    """
    parts = F.split(code, "::", 3)
    has = code.contains("::") & (F.size(parts) == 3)
    return F.struct(F.when(has, parts[0]).alias("component"),
                    F.when(has, parts[1]).alias("mode"),
                    F.when(has, parts[2]).otherwise(code).alias("column"))


def resolve_selection(codes: list[str]) -> list[str]:
    """Driver-side twin of P2 for the few selector strings a chart request holds."""
    out = []
    for c in codes:
        parts = c.split("::", 2)
        out.append(parts[2] if "::" in c and len(parts) == 3 else c)
    return out


def series_projection(df: DataFrame, ts: str, wanted: list[str],
                      partition_by: list[str] | None = None) -> DataFrame:
    """(keys, ts, each wanted column that exists); unknown names are skipped."""
    keys = list(partition_by or [])
    cols = [c for c in resolve_selection(wanted) if c in df.columns and c != ts and c not in keys]
    return df.select(*[q(k) for k in keys], q(ts), *[q(c) for c in dict.fromkeys(cols)])


def _parse_bound(v) -> _dt.datetime | None:
    if v is None:
        return None
    if isinstance(v, _dt.datetime):
        return v
    try:
        t = pd.to_datetime(v)
    except (ValueError, TypeError):
        return None
    return None if pd.isna(t) else t.to_pydatetime()


def time_range_clip(df: DataFrame, ts: str, lo=None, hi=None) -> DataFrame:
    """Keep lo <= ts <= hi (closed); no clip unless both bounds parse.

    The bounds are literals, so the filter reaches the parquet scan.
    """
    a, b = _parse_bound(lo), _parse_bound(hi)
    if a is None or b is None:
        return df
    # text literals cast to NTZ: no time-zone conversion on either side
    lo_lit = F.lit(a.isoformat(sep=" ")).cast("timestamp_ntz")
    hi_lit = F.lit(b.isoformat(sep=" ")).cast("timestamp_ntz")
    out = df.where(q(ts).between(lo_lit, hi_lit))
    if MONTH_COLUMN in df.columns:
        # materialised tables are partitioned by month: prune whole folders too
        out = out.where(F.col(MONTH_COLUMN).between(F.lit(a.strftime("%Y-%m")), F.lit(b.strftime("%Y-%m"))))
    return out


def time_bounds(df: DataFrame, ts: str, partition_by: list[str] | None = None) -> DataFrame:
    """A5: first and last time stamp of the (unclipped) table."""
    keys = list(partition_by or [])
    return df.groupBy(*[q(k) for k in keys]).agg(F.min(q(ts)).alias("ts_min"), F.max(q(ts)).alias("ts_max"))


def sorted_series(df: DataFrame, ts: str, tie: list[str] | None = None) -> DataFrame:
    """O1: ascending time order (range-partitioned global sort)."""
    return df.orderBy(q(ts), *[q(c) for c in (tie or [])])


def sample_head(df: DataFrame, ts: str, n: int = SAMPLE_ROWS, tie: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in time order (top-k, no full sort)."""
    return df.orderBy(q(ts), *[q(c) for c in (tie or [])]).limit(n)


def ts_label(c: Column) -> Column:
    """Time label ``yyyy-MM-dd\\nHH:mm:ss`` of times and of text that reads as one; other values as plain text."""
    text = c.cast("string")
    return F.coalesce(F.date_format(text.try_cast("timestamp_ntz"), TS_LABEL_FORMAT), text)


def positional_window(df: DataFrame, ts: str, start: int, order: list[str] | None = None,
                      partition_by: list[str] | None = None, bucket: str | Buckets = "auto") -> DataFrame:
    """P10: rows [start, start + size) in time order, size = max(200, n // 10).

    ``start`` is clamped to [0, max(0, n - size)].  A histogram over time
    buckets tells which buckets hold the wanted positions; only their rows are
    ranked.  Adds ``row_pos`` (0-based).
    """
    def bounds(n: Column) -> tuple[Column, Column]:
        size = F.greatest(F.lit(WINDOW_MIN_ROWS).cast("bigint"),
                          F.floor(n / F.lit(WINDOW_FRACTION_DIVISOR)).cast("bigint"))
        first = F.least(F.greatest(F.lit(int(start)).cast("bigint"), F.lit(0).cast("bigint")),
                        F.greatest(F.lit(0).cast("bigint"), n - size))
        return first, first + size

    def wanted(first: Column, last: Column, n: Column) -> Column:
        lo, hi = bounds(n)
        return (last > lo) & (first <= hi)

    ranked = ordered_positions(df, ts, order=list(order or [ts]), partition_by=list(partition_by or []), bucket=bucket,
                               pick=wanted)
    lo, hi = bounds(F.col("__cnt"))
    pos = F.col("__rn") - 1
    return ranked.where((pos >= lo) & (pos < hi)).withColumn("row_pos", pos).drop("__rn", "__cnt")


def minmax_downsample(df: DataFrame, ts: str, value: str = "value", n: int = DEFAULT_POINTS,
                      partition_by: list[str] | None = None, bucket: str | Buckets = "auto") -> DataFrame:
    """About ``n`` points per series from its valid rows.

    Valid rows are numbered in (ts, value) order and cut into n // 2
    equal-count buckets; each bucket keeps its min row and its max row
    (ties -> earliest row).  A series with <= n valid rows is kept whole,
    rows that repeat included.
    """
    keys = list(partition_by or [])
    return _minmax_rows(_numbered_valid(df, ts, value, keys, bucket), ts, value, n, keys).select(
        *[q(k) for k in keys], q(ts), q(value))


def _numbered_valid(df: DataFrame, ts: str, value: str, keys: list[str], bucket: str | Buckets) -> DataFrame:
    """Valid rows with their number ``__rn`` in (ts, value) order and their series' row count ``__cnt``."""
    v = df.where(is_valid(q(value)) & ~F.isnan(q(value))).select(*[q(k) for k in keys], q(ts), q(value))
    return ordered_positions(v, ts, order=[ts, value], partition_by=keys, bucket=bucket)


def _minmax_rows(numbered: DataFrame, ts: str, value: str, n: int, keys: list[str]) -> DataFrame:
    """The min and max row of every bucket, by row number, so that equal rows stay apart."""
    half = max(1, n // 2)
    j = numbered.withColumn("__bk", F.when(F.col("__cnt") <= n, F.col("__rn"))
                     .otherwise(F.expr(f"((__rn - 1) * {half}) div __cnt")))
    kb = [q(k) for k in keys] + ["__bk"]
    row = F.struct(F.col("__rn").alias("n"), q(ts).alias("t"), q(value).alias("v"))
    picks = j.groupBy(*kb).agg(F.min_by(row, F.struct(q(value), F.col("__rn"))).alias("__lo"),
                               F.min_by(row, F.struct(-q(value), F.col("__rn"))).alias("__hi"))
    both = picks.select(*[q(k) for k in keys], F.explode(F.array_distinct(F.array("__lo", "__hi"))).alias("__p"))
    return both.select(*[q(k) for k in keys], F.col("__p.n").alias("__rn"), F.col("__p.t").alias(ts),
                       F.col("__p.v").alias(value))


def _lttb_indices(x: np.ndarray, y: np.ndarray, n_out: int) -> np.ndarray:
    """Largest-Triangle-Three-Buckets (Steinarsson 2013) on one short series."""
    m = len(x)
    if n_out >= m or n_out < 3:
        return np.arange(m)
    # whole-number bucket edges over the inner points: bucket i is [edge(i), edge(i + 1))
    edge = [1 + i * (m - 2) // (n_out - 2) for i in range(n_out - 1)] + [m]
    idx = np.empty(n_out, dtype=np.int64)
    idx[0], idx[-1] = 0, m - 1
    a = 0
    for i in range(n_out - 2):
        lo, hi, nhi = edge[i], edge[i + 1], edge[i + 2]
        avg_x, avg_y = x[hi:nhi].mean(), y[hi:nhi].mean()
        area = np.abs((x[a] - avg_x) * (y[lo:hi] - y[a]) - (x[a] - x[lo:hi]) * (avg_y - y[a]))
        a = lo + int(np.argmax(area))
        idx[i + 1] = a
    return idx


def lttb_downsample(df: DataFrame, ts: str, value: str = "value", n: int = DEFAULT_POINTS,
                    partition_by: list[str] | None = None, bucket: str | Buckets = "auto") -> DataFrame:
    """Min-max preselection to 4n points (distributed), then LTTB per series.

    The Python step sees at most ~4n + 2 rows per series (bounded group),
    keeps the first and last row, and returns <= n rows, a subset of the input.
    """
    keys = list(partition_by or [])
    numbered = _numbered_valid(df, ts, value, keys, bucket)
    ends = numbered.where((F.col("__rn") == 1) | (F.col("__rn") == F.col("__cnt")))
    cand = (_minmax_rows(numbered, ts, value, 4 * n, keys)
            .unionByName(ends.select(*[q(k) for k in keys], "__rn", q(ts), q(value))).dropDuplicates([*keys, "__rn"]))
    out_schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField(ts, T.TimestampNTZType()), T.StructField(value, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn").drop(columns="__rn").reset_index(drop=True)
        x = ((pdf[ts] - pdf[ts].iloc[0]) // pd.Timedelta(microseconds=1)).to_numpy(dtype=np.float64)
        y = pdf[value].to_numpy(dtype=np.float64)
        return pdf.iloc[_lttb_indices(x, y, n)]

    if keys:
        return cand.groupBy(*[q(k) for k in keys]).applyInPandas(run, out_schema)
    return (cand.withColumn("__one", F.lit(0)).groupBy("__one")
            .applyInPandas(lambda p: run(p.drop(columns="__one")), out_schema))
