"""Ordered window functions over a time axis without a one-task sort.

A telemetry table usually has ONE time axis and no entity key, so a plain
``Window.orderBy(ts)`` would move every row into a single task.  These
helpers split the axis into coarse time buckets and run the window inside
``partitionBy(keys..., bucket)``.  What a row needs from earlier or later
buckets (the last value before the bucket, the running total so far, the
first value after it) is computed on a per-bucket summary -- one row per
bucket after a partial aggregation -- and fed back as one extra "carry" row
per bucket that is ordered first (or last) inside the same window, then
removed.  That costs a single shuffle of the data (the window exchange) and
no join against the data.

Features (each maps an output name to a source column or expression):

* ``lag``            value of the previous row
* ``lead``           value of the next row
* ``cumsum``         running sum including the current row
* ``cummax_before``  running max over the rows strictly before the row

The buckets follow the data by default (``"auto"``, see ``time_buckets``):
calendar months, cut finer for just those (key, month) spans that are too
dense for one task.  A caller who knows the density can name a width, or hand
on the ``Buckets`` of the table, and save that count.  The summary table has
one row per (key, bucket).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.functions.joins import join_on_keys
from chronoweave.functions.timecols import CALENDAR_UNITS, attach_scalars, bucket_of, clock_micros
from chronoweave.session import cut_lineage

_B, _R = "__cw_bucket", "__cw_rank"
_UNB = Window.unboundedPreceding


def _c(c: str | Column) -> Column:
    return _q(c) if isinstance(c, str) else c


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ordered_columns(df: DataFrame, ts: str, *, order: list[str] | None = None,
                    partition_by: list[str] | None = None, bucket: str | Buckets = "auto",
                    lag: dict | None = None, lead: dict | None = None,
                    cumsum: dict | None = None, cummax_before: dict | None = None,
                    bucket_col: Column | None = None) -> DataFrame:
    """Add ordered-window columns computed per ``partition_by`` in ``order``.

    ``order`` defaults to ``[ts]``; the bucket (``bucket_of(ts, bucket)``,
    or ``bucket_col`` when given) must be non-decreasing along ``order``.
    Rows with a null ``ts`` form their own bucket and are ordered on their own.
    ``bucket="auto"`` counts rows per key and month first (one job).
    """
    keys = list(partition_by or [])
    order = list(order or [ts])
    feats = []
    for kind, mapping in (("lag", lag), ("lead", lead), ("cumsum", cumsum), ("cmax", cummax_before)):
        for out, src in (mapping or {}).items():
            feats.append((out, kind, f"__cw_src{len(feats)}", _c(src)))
    if not feats:
        return df
    srcs = [s for _, _, s, _ in feats]

    if bucket_col is not None:
        d, fine = df.withColumn(_B, bucket_col), None
    else:
        d, fine = with_bucket(df, ts, keys, bucket, tied=order == [ts])
    # one projection (each DataFrame step is analysed eagerly on the driver)
    d = d.select("*", F.lit(1).alias(_R), *[e.alias(s) for _, _, s, e in feats])

    # Per-bucket summary: partial aggregation shrinks it before its shuffle.
    okey = F.struct(*[_q(o) for o in order]) if len(order) > 1 else _q(order[0])
    same = {s for _, _, s, e in feats if len(order) == 1 and str(e) in (str(F.col(order[0])), str(_q(order[0])))} if "." not in order[0] else set()
    aggs = []
    for _, kind, s, _ in feats:
        # the order column itself needs no by-aggregate: its last value is its max
        if kind == "lag":
            aggs.append((F.max(s) if s in same else F.max_by(s, okey)).alias(s))
        elif kind == "lead":
            aggs.append((F.min(s) if s in same else F.min_by(s, okey)).alias(s))
        elif kind == "cumsum":
            aggs.append(F.sum(s).alias(s))
        else:
            aggs.append(F.max(s).alias(s))
    part = [_q(k) for k in keys]
    summary = d.groupBy(*part, _B).agg(*aggs)

    # Carry values across buckets: a window over the summary (one row per bucket).
    carry, before, after = _carries(summary, keys, feats, fine)
    pieces = [d]
    if before:
        pieces.append(carry.select(*part, _B, F.lit(0).alias(_R), *before))
    if after:
        pieces.append(carry.select(*part, _B, F.lit(2).alias(_R), *after))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces)

    w = Window.partitionBy(*part, _B).orderBy(F.col(_R), *[_q(o) for o in order])
    outs = []
    for out, kind, s, _ in feats:
        if kind == "lag":
            x = F.lag(s).over(w)
        elif kind == "lead":
            x = F.lead(s).over(w)
        elif kind == "cumsum":
            x = F.sum(s).over(w.rowsBetween(_UNB, 0))
        else:
            x = F.max(s).over(w.rowsBetween(_UNB, -1))
        outs.append(x.alias(out))
    kept = u.select(*[F.col(f"`{c}`") for c in df.columns], _R, *outs).where(F.col(_R) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(o) for o, _, _, _ in feats])


_SUPER = 4096  # buckets per super-bucket when the summary itself is split


def _carries(summary: DataFrame, keys: list[str], feats, fine: Column | None):
    """Per-bucket carry columns: (before-row expressions, after-row expressions).

    With calendar buckets the summary has one row per (key, bucket) and a
    window partitioned by key is small.  Finer buckets can be many (one per
    second over years), so the summary's own ordered problem is solved with
    the same bucketed method; ``fine`` says which buckets go together.
    """
    if fine is None:
        ws = Window.partitionBy(*[_q(k) for k in keys]).orderBy(_B)
        before, after = [], []
        for _, kind, s, _ in feats:
            if kind == "lag":
                before.append(F.lag(s).over(ws).alias(s))
            elif kind == "cumsum":
                before.append(F.sum(s).over(ws.rowsBetween(_UNB, -1)).alias(s))
            elif kind == "cmax":
                before.append(F.max(s).over(ws.rowsBetween(_UNB, -1)).alias(s))
            else:
                after.append(F.lead(s).over(ws).alias(s))
        return summary, before, after
    fb, together = "__cw_fine_bucket", "__cw_together"
    sm = summary.select(*[F.col(f"`{k}`") for k in keys], F.col(_B).alias(fb), fine.alias(together),
                        *[F.col(s).alias(f"{s}_v") for _, _, s, _ in feats])
    spec = {"lag": {}, "lead": {}, "cumsum": {}, "cmax": {}}
    for _, kind, s, _ in feats:
        spec[kind][f"{s}_c"] = F.col(f"{s}_v")
    c = ordered_columns(sm, fb, order=[fb], partition_by=keys,
                        bucket_col=F.col(together),
                        lag=spec["lag"], lead=spec["lead"], cumsum=spec["cumsum"],
                        cummax_before=spec["cmax"]).withColumnRenamed(fb, _B).drop(together)
    before, after = [], []
    for _, kind, s, _ in feats:
        if kind == "cumsum":
            # inclusive running total over buckets minus the bucket's own total
            before.append((F.col(f"{s}_c") - F.col(f"{s}_v")).alias(s))
        elif kind == "lead":
            after.append(F.col(f"{s}_c").alias(s))
        else:
            before.append(F.col(f"{s}_c").alias(s))
    return c, before, after


def ordered_lag(df: DataFrame, col: str | Column, ts: str, out: str, *,
                partition_by: list[str] | None = None, order: list[str] | None = None,
                bucket: str | Buckets = "auto") -> DataFrame:
    return ordered_columns(df, ts, order=order, partition_by=partition_by, bucket=bucket,
                           lag={out: col})


def ordered_lead(df: DataFrame, col: str | Column, ts: str, out: str, *,
                 partition_by: list[str] | None = None, order: list[str] | None = None,
                 bucket: str = "auto") -> DataFrame:
    return ordered_columns(df, ts, order=order, partition_by=partition_by, bucket=bucket,
                           lead={out: col})


def ordered_cumsum(df: DataFrame, col: str | Column, ts: str, out: str, *,
                   partition_by: list[str] | None = None, order: list[str] | None = None,
                   bucket: str = "auto") -> DataFrame:
    return ordered_columns(df, ts, order=order, partition_by=partition_by, bucket=bucket,
                           cumsum={out: col})


def ordered_row_number(df: DataFrame, ts: str, out: str, *, order: list[str],
                       partition_by: list[str] | None = None, bucket: str = "auto") -> DataFrame:
    """1-based row number in ``order`` (give a total order for a stable result)."""
    return ordered_columns(df, ts, order=order, partition_by=partition_by, bucket=bucket,
                           cumsum={out: F.lit(1).cast("bigint")})


TARGET_ROWS = 2_000_000
RANK_ROWS = 500_000  # rows that a task sorts to rank them, about; and so of a bucket that is ranked
_WIDTH, _MONTH, _TIES = "__cw_width", "__cw_month", "__cw_ties"
# Nested widths in microseconds, finest first: counted by the second, and by the microsecond where that is not enough.
_BY_SECOND = (1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000)
_BY_MICRO = (1, 1_000)


@dataclass(frozen=True)
class Buckets:
    """How the time axis of a table is cut, by key.

    Months, but for the (key, month) spans listed in ``widths``: those are cut
    into whole widths of their own (microseconds), and rows that share key and
    time stamp into ``ties`` hash parts where even they are too many.  The
    table holds at most one row for ``target_rows`` rows of data; None means
    that no month is too dense.  ``rows`` is the number of rows with a time
    stamp, if it was counted.
    """

    keys: tuple[str, ...] = ()
    widths: DataFrame | None = None
    rows: int | None = field(default=None, compare=False)


def with_bucket(df: DataFrame, ts: str, keys: list[str], bucket: str | Buckets = "auto",
                tied: bool = False) -> tuple[DataFrame, Column | None]:
    """``df`` with its bucket column ``__cw_bucket``, non-decreasing in ``ts``; and, if buckets may be many, which go together.

    ``tied`` says that rows of one time stamp may come in any order, so that
    a time stamp with very many rows may be cut as well.
    """
    if bucket == "auto":
        bucket = time_buckets(df, ts, keys)
    if isinstance(bucket, str):
        fine = None if bucket in CALENDAR_UNITS else F.floor(F.col(_B) / F.lit(_SUPER))
        return df.withColumn(_B, bucket_of(ts, bucket)), fine
    if bucket.widths is None:
        return df.withColumn(_B, bucket_of(ts, "month")), None
    own = [k for k in bucket.keys if k in df.columns]
    if len(own) < len(bucket.keys):
        raise ValueError(f"the buckets are cut by {list(bucket.keys)}, the table has {own}")
    names = df.columns
    d = join_on_keys(df.withColumn(_MONTH, bucket_of(ts, "month")), bucket.widths, [*bucket.keys, _MONTH], "left")
    start = F.floor(clock_micros(ts) / F.col(_WIDTH)) * F.col(_WIDTH)
    salt = F.when(F.col(_TIES) > 1, F.pmod(F.xxhash64(*[_q(c) for c in names]), F.col(_TIES))).otherwise(0) \
        if tied else F.lit(0)
    cut = F.when(_q(ts).isNotNull(), F.struct(F.coalesce(start, clock_micros(_MONTH)).cast("bigint").alias("at"),
                                              salt.cast("bigint").alias("part")))
    return d.select(*[_q(c) for c in names], cut.alias(_B)), F.floor(F.col(f"{_B}.at") / F.lit(_BY_SECOND[-1]))


def time_buckets(df: DataFrame, ts: str, partition_by: list[str] | None = None,
                 target_rows: int = TARGET_ROWS) -> Buckets:
    """Buckets of at most ``target_rows`` rows of one key, from coarse to fine.

    One job counts rows per (key, month); where no month is too dense, as in
    most tables, that is all.  Otherwise only the dense months are counted per
    second and rolled up to minutes, hours and days, and each gets the
    coarsest width that fits; the same by the microsecond where a second is
    too dense.  A key that is dense for a day is cut finer in that month alone.
    """
    keys = list(partition_by or [])
    part = [_q(k) for k in keys]
    rows = df.select(*part, _q(ts).alias("__t"), bucket_of(ts, "month").alias(_MONTH)).where(F.col("__t").isNotNull())
    months = rows.groupBy(*part, _MONTH).count()
    densest, total = months.agg(F.max("count"), F.coalesce(F.sum("count"), F.lit(0))).first()
    if (densest or 0) <= target_rows:
        return Buckets(tuple(keys), rows=total)
    many = cut_lineage(months.where(F.col("count") > target_rows).drop("count"), "dense-months")
    found = _fitting(rows, many, keys, _BY_SECOND, target_rows)
    rest = found.where(F.col(_WIDTH).isNull()).select(*part, _MONTH)
    if rest.take(1):
        fine = _fitting(rows, rest, keys, _BY_MICRO, target_rows)
        fine = fine.withColumn(_TIES, F.when(F.col(_WIDTH).isNull(), F.ceil(F.col("__n") / F.lit(target_rows)))
                               .otherwise(1)).fillna(1, [_WIDTH])
        found = found.where(F.col(_WIDTH).isNotNull()).withColumn(_TIES, F.lit(1).cast("bigint")).unionByName(fine)
    else:
        found = found.withColumn(_TIES, F.lit(1).cast("bigint"))
    return Buckets(tuple(keys), cut_lineage(found.drop("__n"), "bucket-widths"), total)


def _fitting(rows: DataFrame, spans: DataFrame, keys: list[str], widths: tuple[int, ...], target: int) -> DataFrame:
    """(keys, month, width, n) of the listed spans: the coarsest width whose densest piece holds ``target`` rows at
    most (null if none does), and the rows of the densest piece of the finest width.  Each level sums the one before."""
    part = [_q(k) for k in [*keys, _MONTH]]
    at = F.floor(clock_micros("__t") / F.lit(widths[0])).cast("bigint")
    level = (join_on_keys(rows, spans, [*keys, _MONTH], "inner").groupBy(*part, at.alias("__s"))
             .agg(F.count(F.lit(1)).alias("__n")).withColumn("__m0", F.col("__n")))
    for i in range(1, len(widths)):
        up = F.floor(F.col("__s") / F.lit(widths[i] // widths[i - 1])).cast("bigint")
        level = (level.groupBy(*part, up.alias("__s"))
                 .agg(F.sum("__n").alias("__n"), *[F.max(f"__m{j}").alias(f"__m{j}") for j in range(i)])
                 .withColumn(f"__m{i}", F.col("__n")))
    top = level.groupBy(*part).agg(*[F.max(f"__m{i}").alias(f"__m{i}") for i in range(len(widths))])
    width = F.lit(None).cast("bigint")
    for i, w in enumerate(widths):
        width = F.when(F.col(f"__m{i}") <= target, F.lit(w).cast("bigint")).otherwise(width)
    return cut_lineage(top.select(*part, width.alias(_WIDTH), F.col("__m0").alias("__n")), "span-widths")


_K = "__cw_key"


def key_of(keys: list[str]) -> Column:
    """Keys and bucket as one column that is never null, so that joins and windows on it share one exchange."""
    return F.struct(*[_q(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(_B).alias("b")).alias(_K)


def _rank_tasks(df: DataFrame, bucket: str | Buckets) -> int | None:
    """Tasks for ranking at ``RANK_ROWS`` rows each, where the session's own number of them is too small or unknown to suffice.

    Adaptive execution joins shuffle partitions by their compressed bytes, so
    that millions of much repeated rows can end up in one sort.
    """
    rows = bucket.rows if isinstance(bucket, Buckets) else None
    spark = df.sparkSession
    least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = -(-(rows or 0) // RANK_ROWS)
    return n if n > least else None


def ordered_positions(df: DataFrame, ts: str, *, order: list[str], partition_by: list[str] | None = None,
                      bucket: str | Buckets = "auto", pos: str = "__rn", total: str = "__cnt",
                      pick=None) -> DataFrame:
    """Adds each row's 1-based position ``pos`` in ``order`` and the number of its key's rows, ``total``.

    A histogram (rows per key and bucket) and its running totals place the
    buckets; only rows inside a bucket are ranked.  ``pick(first, last, n)``
    may keep just the buckets whose positions first..last of n it wants: the
    others are dropped before anything is shuffled or ranked.

    With ``"auto"``, or ``Buckets`` that were counted, buckets are dealt to as
    many tasks as the rows ask for, about ``RANK_ROWS`` each: what a task sorts
    does not grow with the table.
    """
    keys = list(partition_by or [])
    if bucket == "auto":
        bucket = time_buckets(df, ts, keys, RANK_ROWS)
    d, fine = with_bucket(df, ts, keys, bucket)
    tasks = _rank_tasks(df, bucket)
    names = df.columns
    d = d.select("*", key_of(keys))
    ks = [f"k{i}" for i in range(len(keys))]
    hist = d.groupBy(_K).agg(F.count(F.lit(1)).alias("__n"))
    if fine is None:
        ws = Window.partitionBy(*[F.col(f"{_K}.{k}") for k in ks])
        hist = hist.select(_K, "__n", F.sum("__n").over(ws).alias(total), F.coalesce(
            F.sum("__n").over(ws.orderBy(F.col(f"{_K}.b")).rowsBetween(_UNB, -1)), F.lit(0)).alias("__before"))
    else:
        flat = hist.select(f"{_K}.*", "__n").withColumn(_B, F.col("b"))
        flat = ordered_columns(flat.withColumn("__together", fine).drop(_B), "b", order=["b"], partition_by=ks,
                               bucket_col=F.col("__together"), cumsum={"__cum": F.col("__n")})
        sums = flat.groupBy(*ks).agg(F.sum("__n").alias(total))
        flat = join_on_keys(flat, sums, ks) if keys else attach_scalars(flat, sums, [total])
        hist = flat.select(F.struct(*ks, "b").alias(_K), "__n", total, (F.col("__cum") - F.col("__n")).alias("__before"))
    if pick is not None:
        hist = hist.where(pick(F.col("__before") + 1, F.col("__before") + F.col("__n"), F.col(total)))
    if tasks and pick is None:
        d = d.repartition(tasks, _K)
    j = d.join(hist.drop("__n"), _K)
    if tasks and pick is not None:
        j = j.repartition(tasks, _K)  # only what was picked
    rank = F.row_number().over(Window.partitionBy(_K).orderBy(*[_q(o) for o in order]))
    return j.select(*[_q(c) for c in names], (rank + F.col("__before")).cast("bigint").alias(pos), F.col(total))
