"""Data-quality views of a series: valid values, sentinel classes, extrema,
marker points, symmetric range, table profile, bad-data runs, interval merge
and shaded boxes (P4 P5 A3 A4 A6 A9 W4 W5 W6).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.functions.joins import join_on_keys
from chronoweave.functions.ordered import Buckets, key_of, time_buckets, with_bucket
from chronoweave.functions.timecols import add_micros, attach_scalars, micros_between
from chronoweave.operators import gaps
from chronoweave.operators.clean import q
from chronoweave.session import cut_lineage

# Fixed values (the reference's chart rules): valid range [-999998.0, 999998.0];
# 999999.0 marks an inserted gap row (shaded red), -999999.0 an anomaly
# (shaded orange).
VALID_LOW, VALID_HIGH = -999998.0, 999998.0
GAP_VALUE, ANOMALY_VALUE = 999999.0, -999999.0
SENTINEL_CLASSES = {GAP_VALUE: "red", ANOMALY_VALUE: "orange"}


def is_valid(c: Column) -> Column:
    return c.between(F.lit(VALID_LOW), F.lit(VALID_HIGH))


def to_long(df: DataFrame, ts: str, cols: list[str], partition_by: list[str] | None = None,
            series_col: str = "series", value_col: str = "value") -> DataFrame:
    """Wide (ts, c1, c2, ...) -> long (keys, ts, series, value double)."""
    keys = list(partition_by or [])
    present = [c for c in cols if c in df.columns]
    d = df.select(*[q(k) for k in keys], q(ts), *[q(c).cast("double").alias(c) for c in present])
    return d.unpivot([*keys, ts], present, series_col, value_col)


def sentinel_rows(df: DataFrame, ts: str, cols: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """(keys, series, ts, class) of the sentinel values.  Rows without any leave before the rest is unpivoted."""
    present = [c for c in cols if c in df.columns]
    some = reduce(lambda a, b: a | b, [q(c).isin(GAP_VALUE, ANOMALY_VALUE) for c in present])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), q(c).cast("double").alias("value")) for c in present]))
    keys = [q(k) for k in (partition_by or [])]
    value = F.col("__v.value")
    return (df.where(some).select(*keys, q(ts), each.alias("__v")).where(value.isin(GAP_VALUE, ANOMALY_VALUE))
            .select(*keys, F.col("__v.series").alias("series"), q(ts),
                    F.when(value == F.lit(GAP_VALUE), F.lit("red")).otherwise(F.lit("orange")).alias("class")))


def valid_values(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value lies in the valid range (NULL/NaN excluded)."""
    return df.where(is_valid(q(value)) & ~F.isnan(q(value)))


def sentinel_class(c: Column) -> Column:
    return (F.when(c == F.lit(ANOMALY_VALUE), F.lit("anomaly"))
            .when(c == F.lit(GAP_VALUE), F.lit("gap"))
            .when(is_valid(c) & ~F.isnan(c), F.lit("valid"))
            .otherwise(F.lit("ignored")))


def sentinel_classes(df: DataFrame, value: str = "value", out: str = "class") -> DataFrame:
    """P5: anomaly / gap / valid / ignored for every row (a partition of the rows)."""
    return df.withColumn(out, sentinel_class(q(value)))


def series_extrema(df: DataFrame, cols: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """A3: min and max of the valid values of every column, one aggregate pass.

    Returns (keys..., series, min, max); a series without a valid value is absent.
    """
    keys = list(partition_by or [])
    present = [c for c in cols if c in df.columns]
    aggs = []
    for i, c in enumerate(present):
        v = F.when(is_valid(q(c)) & ~F.isnan(q(c)), q(c))
        aggs += [F.min(v).alias(f"__mn{i}"), F.max(v).alias(f"__mx{i}")]
    a = df.groupBy(*[q(k) for k in keys]).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"__mn{i}").cast("double").alias("min"),
                                        F.col(f"__mx{i}").cast("double").alias("max"))
                               for i, c in enumerate(present)]))
    return (a.select(*[q(k) for k in keys], rows.alias("__r")).select(*[q(k) for k in keys], "__r.*")
            .where(F.col("min").isNotNull()))


def overall_extrema(df: DataFrame, cols: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """A4: min/max across the selected series; marker level = min, else 0."""
    keys = list(partition_by or [])
    present = [c for c in cols if c in df.columns]
    vs = [F.when(is_valid(q(c)) & ~F.isnan(q(c)), q(c).cast("double")) for c in present]
    lo = F.least(*[F.min(v) for v in vs]) if len(vs) > 1 else F.min(vs[0])
    hi = F.greatest(*[F.max(v) for v in vs]) if len(vs) > 1 else F.max(vs[0])
    return (df.groupBy(*[q(k) for k in keys]).agg(lo.alias("y_min"), hi.alias("y_max"))
            .withColumn("marker_level", F.coalesce(F.col("y_min"), F.lit(0.0))))


def marker_points(df: DataFrame, ts: str, cols: list[str],
                  partition_by: list[str] | None = None) -> DataFrame:
    """A4 use: anomaly (-999999) and gap (999999) rows drawn at the marker level.

    Returns (keys..., series, ts, class, y).
    """
    keys = list(partition_by or [])
    ext = overall_extrema(df, cols, keys).select(*[q(k) for k in keys], "marker_level")
    hits = sentinel_rows(df, ts, cols, keys)
    j = join_on_keys(hits, ext, keys, "left") if keys else attach_scalars(hits, ext, ["marker_level"])
    return j.select(*[q(k) for k in keys], "series", q(ts), "class", F.col("marker_level").alias("y"))


def symmetric_range(df: DataFrame, cols: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """m = max(|min|, |max|) over the selected series -> (-m, m).

    Sentinels are not removed; a series with a missing value in the rows at
    hand contributes nothing.
    """
    keys = list(partition_by or [])
    present = [c for c in cols if c in df.columns]
    whole = {c: F.count_if(q(c).isNull() | F.isnan(q(c))) == 0 for c in present}
    los = [F.when(whole[c], F.min(q(c).cast("double"))) for c in present]
    his = [F.when(whole[c], F.max(q(c).cast("double"))) for c in present]
    lo = F.least(*los) if len(los) > 1 else los[0]
    hi = F.greatest(*his) if len(his) > 1 else his[0]
    m = F.greatest(F.abs(F.col("__lo")), F.abs(F.col("__hi")))
    return (df.groupBy(*[q(k) for k in keys]).agg(lo.alias("__lo"), hi.alias("__hi"))
            .select(*[q(k) for k in keys], (-m).alias("range_low"), m.alias("range_high")))


def table_info(df: DataFrame) -> DataFrame:
    """A9 ``info``: (position, column, non_null, dtype) for every column, one aggregate pass."""
    row = df.agg(*[F.count(q(c)).alias(f"__n{i}") for i, c in enumerate(df.columns)])
    items = F.array(*[F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(f.name).alias("column"),
                               F.col(f"__n{i}").alias("non_null"),
                               F.lit(f.dataType.simpleString()).alias("dtype"))
                      for i, f in enumerate(df.schema.fields)])
    return row.select(F.explode(items).alias("__r")).select("__r.*")


def _search(v: Column, splits: Column, lo: int, hi: int, base: Column | None, stride: int) -> Column:
    """Binary search over split positions base + i*stride (1-based), i in [lo, hi]."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    pos = F.lit(mid * stride + stride) if base is None else base + F.lit(mid + 1)
    return F.when(v <= F.element_at(splits, pos), _search(v, splits, lo, mid, base, stride)) \
        .otherwise(_search(v, splits, mid + 1, hi, base, stride))


def _bucket_of_value(df: DataFrame, v: str, splits: str, fan: int, out: str) -> DataFrame:
    """Range index of ``v`` among ``fan * fan - 1`` sorted splits, in two
    codegen-friendly binary searches (coarse over every ``fan``-th split,
    then fine inside the coarse range): about 2*log2(fan) comparisons."""
    coarse = _search(F.col(v), F.col(splits), 0, fan - 1, None, fan)
    d = df.withColumn("__coarse", coarse)
    base = F.col("__coarse") * F.lit(fan)
    fine = _search(F.col(v), F.col(splits), 0, fan - 1, base, 1)
    return d.withColumn(out, F.col("__coarse") * F.lit(fan) + fine).drop("__coarse")


QUARTILES = (0.25, 0.5, 0.75)


def _quartile_ranks(n: int) -> list[tuple[int, int, float]]:
    """1-based lower and upper rank and the fraction between them, for each quartile of ``n`` values."""
    out = []
    for p in QUARTILES:
        pos = p * (n - 1)
        out.append((math.floor(pos) + 1, math.ceil(pos) + 1, pos - math.floor(pos)))
    return out


def _wanted_ranges(dv: DataFrame, target_rows: int, fan: int) -> list[dict]:
    """Value ranges (column, lo, hi, before, rows) that hold the quartile ranks, each of at most ``target_rows`` values.

    ``dv`` has one row per column and value with its count ``__c``.  Ranges
    start as whole columns; those over the target are cut into ``fan**2``
    pieces at approximate quantiles, the pieces are counted, and only the at
    most six with a wanted rank go on.  The driver holds six ranges a column
    and, in a round, the counts of their pieces.
    """
    spark = dv.sparkSession
    whole = dv.groupBy("column").agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("rows"),
                                     F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    ranks = {r["column"]: sorted({k for lo, hi, _ in _quartile_ranks(r["n"]) for k in (lo, hi)}) for r in whole}
    done, todo = [], [{"column": r["column"], "lo": r["lo"], "hi": r["hi"], "before": 0, "rows": r["rows"]} for r in whole]
    k = fan * fan
    while todo:
        done += [r for r in todo if r["rows"] <= target_rows]
        todo = [r for r in todo if r["rows"] > target_rows]
        if not todo:
            break
        rows = _in_ranges(dv, spark, todo)
        splits = rows.groupBy("__r").agg(F.percentile_approx("value", [i / k for i in range(1, k)], k * 4).alias("__splits"))
        cut = _bucket_of_value(rows.join(F.broadcast(splits), "__r"), "value", "__splits", fan, "__b")
        pieces = cut.groupBy("__r", "__b").agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("rows"),
                                               F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        smaller, at = [], {}
        for piece in sorted(pieces, key=lambda x: (x["__r"], x["__b"])):
            whole_range = todo[piece["__r"]]
            before = at.get(piece["__r"], whole_range["before"])
            at[piece["__r"]] = before + piece["n"]
            if any(before < r <= before + piece["n"] for r in ranks[whole_range["column"]]):
                smaller.append({"column": whole_range["column"], "lo": piece["lo"], "hi": piece["hi"],
                                "before": before, "rows": piece["rows"]})
        todo = smaller
    return done


def _in_ranges(dv: DataFrame, spark, ranges: list[dict]) -> DataFrame:
    """The rows of ``dv`` in each range, with its number and the count before it."""
    table = spark.createDataFrame([(i, r["column"], r["lo"], r["hi"], r["before"]) for i, r in enumerate(ranges)],
                                  "__r int, column string, __lo double, __hi double, __before long")
    return (dv.join(F.broadcast(table), "column").where(q("value").between(F.col("__lo"), F.col("__hi")))
            .drop("__lo", "__hi"))


def profile(df: DataFrame, cols: list[str], target_rows: int = 1_000_000, fan: int = 32) -> DataFrame:
    """Count, mean, sample std, min, exact 25/50/75 % (linear), max per column.

    Exact quantiles by distributed selection, without gathering a column into
    one task:
    1. rows are counted per distinct value (map-side combine shrinks
       low-cardinality measurements to a few rows) and the counts written;
    2. a column of over ``target_rows`` distinct values is cut at approximate
       quantiles (any monotone cut is right; it only balances the work), and
       the pieces that hold one of the six ranks needed (lo/hi rank of each
       quartile) are cut again until each is under the target;
    3. only those pieces are ranked, each in its own window partition.
    Returns (column, count, mean, std, min, q25, q50, q75, max).
    """
    present = [c for c in cols if c in df.columns]
    lng = (df.select(*[q(c).cast("double").alias(c) for c in present])
           .unpivot([], present, "column", "value"))
    lng = lng.where(q("value").isNotNull() & ~F.isnan(q("value")))
    dv = cut_lineage(lng.groupBy("column", "value").agg(F.count(F.lit(1)).alias("__c")), "profile-values")
    stats = lng.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    rows = _in_ranges(dv, df.sparkSession, _wanted_ranges(dv, target_rows, fan))
    wr = Window.partitionBy("column", "__r").orderBy("value")
    rows = rows.withColumn("__cum", F.col("__before") + F.sum("__c").over(
        wr.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(stats.select("column", "count"), "column")

    def at_rank(r: Column) -> Column:
        return (F.col("__cum") - F.col("__c") < r) & (r <= F.col("__cum"))

    qcols = []
    for p in QUARTILES:
        pos = F.lit(p) * (F.col("count") - 1)
        lo_r, hi_r = F.floor(pos) + 1, F.ceil(pos) + 1
        vlo = F.max(F.when(at_rank(lo_r), q("value")))
        vhi = F.max(F.when(at_rank(hi_r), q("value")))
        frac = F.first(pos - F.floor(pos))
        qcols.append((vlo + (vhi - vlo) * frac).alias(f"q{int(p * 100)}"))
    qv = rows.groupBy("column").agg(*qcols)
    return (stats.join(qv, "column", "left")
            .select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


_UNB = Window.unboundedPreceding
_EARLIER, _SO_FAR = (_UNB, -1), (_UNB, Window.currentRow)


def bad_runs(df: DataFrame, ts: str, cols: list[str], partition_by: list[str] | None = None,
             res: DataFrame | None = None, margin: float = gaps.MARGIN_SECONDS,
             bucket: str | Buckets = "auto") -> DataFrame:
    """Runs of sentinel rows per (keys, series, class) -> shaded intervals.

    A new run starts where the step to the previous sentinel row of the same
    series and class exceeds resolution + margin.  Interval =
    [first - res/2, last + res/2]; class red (999999) or orange (-999999).
    Resolution comes from the whole time axis of each key (fallback 10 s).

    One pass over the sentinel rows: inside a bucket a running count of far
    steps numbers the runs, which shrink to their ends where they are.  Only a
    bucket's first and last run can go on in another bucket; those, two rows a
    bucket, are put together by a second, small window.
    """
    keys = list(partition_by or [])
    if bucket == "auto":  # chosen once, for the resolution and the runs
        bucket = time_buckets(df, ts, keys)
    if res is None:
        res = gaps.resolution_with_fallback(df, ts, keys, bucket, margin=margin)
    rs = res.select(*[q(k) for k in keys], "resolution_us", "threshold_seconds")
    hits = sentinel_rows(df, ts, cols, keys)
    hits = (join_on_keys(hits, rs, keys) if keys
            else attach_scalars(hits, rs, ["resolution_us", "threshold_seconds"]))
    part = keys + ["series", "class"]
    d, _ = with_bucket(hits, ts, keys, bucket)
    # one set of columns for both ends of the plan, so that they share its exchange
    d = d.select(key_of(part), q(ts), "resolution_us", "threshold_seconds")
    names = [F.col(f"__cw_key.k{i}").alias(c) for i, c in enumerate(part)]
    here = Window.partitionBy("__cw_key")

    def far(before: str, now: Column) -> Column:
        step = micros_between(before, now) / F.lit(1e6)
        return (F.col(before).isNull() | (step > F.col("threshold_seconds"))).cast("int")

    local = d.withColumn("__p", F.lag(q(ts)).over(here.orderBy(q(ts))))
    local = local.withColumn("__run", F.sum(far("__p", q(ts))).over(here.orderBy(q(ts)).rowsBetween(*_SO_FAR)))
    runs = local.groupBy("__cw_key", "__run").agg(
        F.min(q(ts)).alias("__a"), F.max(q(ts)).alias("__z"),
        F.first("resolution_us").alias("resolution_us"), F.first("threshold_seconds").alias("threshold_seconds"))
    runs = runs.withColumn("__last", F.max("__run").over(here))
    edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__last"))
    wide = ["__a", "__z", "resolution_us"]
    across = Window.partitionBy(*[q(c) for c in part]).orderBy("__a", "__z")
    ends = (runs.where(edge).select(*names, *wide, "threshold_seconds").withColumn("__p", F.lag("__z").over(across))
            .withColumn("__run", F.sum(far("__p", F.col("__a"))).over(across.rowsBetween(*_SO_FAR)))
            .groupBy(*[q(c) for c in part], "__run").agg(F.min("__a").alias("__a"), F.max("__z").alias("__z"),
                                                         F.first("resolution_us").alias("resolution_us")))
    whole = runs.where(~edge).select(*names, *wide).unionByName(ends.select(*[q(c) for c in part], *wide))
    half = F.floor(F.col("resolution_us") / F.lit(2)).cast("bigint")
    return whole.select(*[q(k) for k in keys], "series", add_micros("__a", -half).alias("start"),
                        add_micros("__z", half).alias("end"), "class")


def merge_intervals(iv: DataFrame, partition_by: list[str] | None = None, start: str = "start",
                    end: str = "end", cls: str = "class", bucket: str | Buckets = "auto",
                    classes: tuple[str, ...] | None = tuple(SENTINEL_CLASSES.values()),
                    series: list[str] | None = None) -> DataFrame:
    """Merge overlapping or touching intervals of the same class.

    In order of start an interval joins the current merged one when it
    starts no later than that one's end AND has the same class; a different
    class in between breaks the merge.  Equal starts go by the place of the
    interval's ``series`` column in the list ``series`` (if both are there),
    then by the place of its class in ``classes`` (None: no such order), then
    by end.

    One exchange of the intervals, by time bucket.  A bucket is summed up by
    its first and last class, whether it holds one run of one class only, and
    the greatest end in its last run.  These summaries combine from bucket to
    bucket (a bucket of one run, of the class before it, carries the open end
    on), so a small window over them tells each bucket the class and end that
    are open at its start.  With that the groups inside a bucket are final,
    but for the first and the last, which a second small window puts together.
    """
    keys = list(partition_by or [])
    place = F.array_position(F.array(*[F.lit(s) for s in series]), F.col("series")) \
        if series and "series" in iv.columns else F.lit(0)
    kind = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(cls)) if classes else F.lit(0)
    d = iv.select(*[q(k) for k in keys], q(start), q(end), q(cls), place.cast("int").alias("__so"), kind.cast("int").alias("__co"))
    d, _ = with_bucket(d, start, keys, bucket)
    # one set of columns for all branches of the plan, so that they share its exchange
    d = d.select(key_of(keys), q(start), q(end), q(cls), "__so", "__co")
    names = [F.col(f"__cw_key.k{i}").alias(k) for i, k in enumerate(keys)]
    here = Window.partitionBy("__cw_key")
    ordered = here.orderBy(q(start), "__so", "__co", q(end), q(cls))
    d = d.withColumn("__pc", F.lag(q(cls)).over(ordered))
    d = d.withColumn("__cr", F.sum((F.col("__pc").isNull() | (F.col("__pc") != q(cls))).cast("int")).over(
        ordered.rowsBetween(*_SO_FAR)))  # number of the class run inside the bucket

    state = d.groupBy("__cw_key").agg(
        F.max(F.when(F.col("__cr") == 1, q(cls))).alias("first_class"), F.max("__cr").alias("class_runs"),
        F.max(F.struct(F.col("__cr"), q(cls).alias("c"))).getField("c").alias("last_class"),
        F.max(F.struct(F.col("__cr"), q(end).alias("e"))).getField("e").alias("last_end"))
    over = Window.partitionBy(*[F.col(f"__cw_key.k{i}") for i in range(len(keys))]).orderBy(F.col("__cw_key.b"))
    before = F.lag("last_class").over(over)
    state = state.withColumn("__open_class", before)
    goes_on = (F.col("class_runs") == 1) & F.col("first_class").eqNullSafe(F.col("__open_class"))
    state = state.withColumn("__chain", F.sum((~goes_on).cast("int")).over(over.rowsBetween(*_SO_FAR)))
    state = state.withColumn("__open_end", F.max(F.struct(F.col("__chain"), F.col("last_end").alias("e"))).over(
        over.rowsBetween(*_EARLIER)).getField("e"))
    # the chain that is open before a bucket is the last one so far, and its greatest end the greatest of its buckets

    d = d.join(state.select("__cw_key", "__open_class", "__open_end"), "__cw_key")
    top = F.max(F.struct(F.col("__cr"), q(end).alias("e"))).over(ordered.rowsBetween(*_EARLIER))
    d = d.withColumn("__top", top)
    inside = F.when(F.col("__top.__cr") == F.col("__cr"), F.col("__top.e"))
    carried = F.when((F.col("__cr") == 1) & (F.col("__open_class") == q(cls)), F.col("__open_end"))
    reach = F.greatest(inside, carried)
    d = d.withColumn("__g", F.sum((reach.isNull() | (q(start) > reach)).cast("int")).over(ordered.rowsBetween(*_SO_FAR)))
    groups = d.groupBy("__cw_key", "__g").agg(
        F.min(q(start)).alias(start), F.max(q(end)).alias(end),
        F.first(q(cls)).alias(cls)).withColumn("__last", F.max("__g").over(here))
    # group 0 belongs to the group that is open at the bucket's start
    edge = (F.col("__g") == 0) | (F.col("__g") == F.col("__last"))
    across = Window.partitionBy(*[q(k) for k in keys]).orderBy("__b", "__g").rowsBetween(*_SO_FAR)
    out = [q(start), q(end), q(cls)]
    ends = (groups.where(edge).select(*names, F.col("__cw_key.b").alias("__b"), "__g", *out)
            .withColumn("__g", F.sum((F.col("__g") > 0).cast("int")).over(across))
            .groupBy(*[q(k) for k in keys], "__g")
            .agg(F.min(q(start)).alias(start), F.max(q(end)).alias(end), F.first(q(cls)).alias(cls)))
    return groups.where(~edge).select(*names, *out).unionByName(ends.drop("__g"))


def bad_intervals(df: DataFrame, ts: str, cols: list[str], partition_by: list[str] | None = None,
                  res: DataFrame | None = None, bucket: str | Buckets = "auto") -> DataFrame:
    """W4 and W5 together: the merged bad-data intervals of the selected series, their time axis cut into buckets once."""
    if bucket == "auto":
        bucket = time_buckets(df, ts, partition_by)
    runs = bad_runs(df, ts, cols, partition_by, res=res, bucket=bucket)
    return merge_intervals(runs, partition_by, series=cols, bucket=bucket)


def interval_boxes(merged: DataFrame, extrema: DataFrame,
                   partition_by: list[str] | None = None) -> DataFrame:
    """Each merged interval as a box spanning the overall [y_min, y_max]."""
    keys = list(partition_by or [])
    ext = extrema.select(*[q(k) for k in keys], F.col("y_min").alias("y_low"),
                         F.col("y_max").alias("y_high"))
    return join_on_keys(merged, ext, keys, "left") if keys else attach_scalars(merged, ext, ["y_low", "y_high"])
