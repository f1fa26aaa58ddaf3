"""Row cleaning: timestamp repair, numeric coercion, sentinels, duplicates.

P6 drop_invalid_ts, P7 normalize_ts, P8 numeric_coerce, P9 sentinel_to_null
(+ sentinel_report), A1 duplicate_report, A2 unify_duplicates.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

log = logging.getLogger(__name__)

# Fixed values (must equal the reference's defaults for the frequency-fault step):
# default columns "MG-LV-MSB_Frequency", "Island_mode_MCCB_Frequency";
# default sentinel -327.679993; absolute tolerance 1e-6 (relative tolerance 0).
DEFAULT_FAULT_COLUMNS = ("MG-LV-MSB_Frequency", "Island_mode_MCCB_Frequency")
DEFAULT_FAULT_SENTINELS = (-327.679993,)
DEFAULT_ATOL = 1e-6

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def q(name: str) -> Column:
    """Column by exact name, safe for names holding dots or dashes."""
    return F.col(f"`{name}`")


def parse_ts(c: Column, dtype: T.DataType, fmt: str | None = None) -> Column:
    """Coerce a column to ``timestamp_ntz``; failures become NULL (never raise)."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    s = c.cast("string")
    if not fmt:
        return s.try_cast("timestamp_ntz")  # no zone on the way, so no skipped or repeated hours
    # read as UTC and shown as UTC: the session's zone cancels out
    utc = F.try_to_timestamp(F.concat(s, F.lit(" +00:00")), F.lit(f"{fmt} xxx"))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), utc.cast("timestamp_ntz"))


def drop_invalid_ts(df: DataFrame, ts: str = "Timestamp", fmt: str | None = None) -> DataFrame:
    """Coerce ``ts`` and drop rows whose time cannot be parsed."""
    dtype = df.schema[ts].dataType
    return df.withColumn(ts, parse_ts(q(ts), dtype, fmt)).where(q(ts).isNotNull())


def normalize_ts(df: DataFrame, ts: str = "Timestamp", fmt: str | None = None) -> DataFrame:
    """Pick the time column, name it ``ts`` and coerce it (rows kept).

    Order of choice: a column whose name equals ``ts`` ignoring case, else the
    first timestamp-typed column, else nothing (warning, frame unchanged).
    Spark has no index, so the reference's index cases cannot occur.
    """
    cols = df.columns
    chosen = next((c for c in cols if c.lower() == ts.lower()), None)
    if chosen is None:
        chosen = next((f.name for f in df.schema.fields
                       if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))), None)
    if chosen is None:
        log.warning("no column or index usable as %r", ts)
        return df
    if chosen != ts:
        df = df.withColumnRenamed(chosen, ts)
    return df.withColumn(ts, parse_ts(q(ts), df.schema[ts].dataType, fmt))


# Java's parser also reads a trailing type letter ("1d", "12F"); a number here has none
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def to_double(c: Column) -> Column:
    """Double of a number or of text that is one; NULL otherwise."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def numeric_coerce(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Non-numeric text becomes NULL; NaN also becomes NULL (missing)."""
    wanted = [c for c in cols if c in df.columns]
    repl = {}
    for c in wanted:
        v = to_double(q(c)) if isinstance(df.schema[c].dataType, T.StringType) else q(c).try_cast("double")
        repl[c] = F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    return df.withColumns(repl) if repl else df


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Turn float NaN into NULL, the missing marker Spark aggregates skip."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols if cols is not None else df.columns) if c in fl]
    if not targets:
        return df
    return df.withColumns({c: F.when(F.isnan(q(c)), F.lit(None)).otherwise(q(c)) for c in targets})


def _close(c: Column, s: float, atol: float) -> Column:
    return F.abs(c - F.lit(float(s))) <= F.lit(float(atol))


def sentinel_to_null(df: DataFrame, cols: Iterable[str] = DEFAULT_FAULT_COLUMNS,
                     sentinels: Iterable[float] | float = DEFAULT_FAULT_SENTINELS,
                     atol: float = DEFAULT_ATOL) -> DataFrame:
    """Values within ``atol`` of any sentinel become NULL; unknown columns ignored."""
    sents = [float(sentinels)] if isinstance(sentinels, (int, float)) else [float(s) for s in sentinels]
    targets = [c for c in cols if c in df.columns]
    repl = {}
    for c in targets:
        hit = None
        for s in sents:
            h = _close(q(c), s, atol)
            hit = h if hit is None else (hit | h)
        repl[c] = F.when(hit, F.lit(None)).otherwise(q(c))
    return df.withColumns(repl) if repl else df


def sentinel_report(df: DataFrame, cols: Iterable[str] = DEFAULT_FAULT_COLUMNS,
                    sentinels: Iterable[float] | float = DEFAULT_FAULT_SENTINELS,
                    atol: float = DEFAULT_ATOL) -> DataFrame:
    """Replaced-value counts per (column, sentinel), one aggregate pass."""
    sents = [float(sentinels)] if isinstance(sentinels, (int, float)) else [float(s) for s in sentinels]
    targets = [c for c in cols if c in df.columns]
    aggs, labels = [], []
    for i, c in enumerate(targets):
        for j, s in enumerate(sents):
            aggs.append(F.count_if(_close(q(c), s, atol)).alias(f"n{i}_{j}"))
            labels.append((c, s, f"n{i}_{j}"))
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, sentinel double, replaced bigint")
    row = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(s).alias("sentinel"),
                                         F.col(n).alias("replaced")) for c, s, n in labels]))
    return row.select(stack.alias("r")).select("r.*")


def duplicate_report(df: DataFrame, ts: str = "Timestamp",
                     partition_by: list[str] | None = None) -> DataFrame:
    """A1: every row whose time stamp occurs more than once (``keep=False``).

    The duplicate keys come from a partially aggregated count, then a left
    semi join brings back their rows; a hot time stamp is handled by the
    map-side combine and AQE's skew-join split, never by one window group.
    """
    keys = list(partition_by or []) + [ts]
    from chronoweave.functions.joins import join_on_keys

    dup = df.groupBy(*[q(k) for k in keys]).count().where(F.col("count") > 1).drop("count")
    return join_on_keys(df, dup, keys, "left_semi")


def unify_duplicates(df: DataFrame, ts: str = "Timestamp", partition_by: list[str] | None = None,
                     non_numeric: str = "error") -> DataFrame:
    """A2: one row per time stamp, each measurement the mean of its rows.

    Missing values (NULL and NaN) are skipped; all-missing gives NULL.
    Booleans average as 0/1.  Text columns raise (as the reference does)
    unless ``non_numeric='drop'``.
    """
    keys = list(partition_by or []) + [ts]
    aggs = []
    for f in df.schema.fields:
        if f.name in keys:
            continue
        c = q(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif not isinstance(f.dataType, NUMERIC):
            if non_numeric == "drop":
                continue
            raise ValueError(f"column {f.name!r} is not numeric and cannot be averaged")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        aggs.append(F.avg(c).alias(f.name))
    if not aggs:
        return df.select(*keys).distinct()
    return df.groupBy(*[q(k) for k in keys]).agg(*aggs)
