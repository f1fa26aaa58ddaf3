"""Plan tests: no window over rows without a partition spec; pushdown reaches the scan."""

import re

from pyspark.sql import functions as F

from chronoweave.operators import gaps, quality, series
from tests.conftest import SF

PASS_THROUGH = ("Sort", "Exchange", "AQEShuffleRead", "ShuffleQueryStage", "InputAdapter",
                "WholeStageCodegen", "Project", "Filter", "ColumnarToRow", "Window")  # all keep rows as they are


def _top_lists(text: str) -> list[str]:
    """Top-level [...] groups of a plan node's argument string."""
    out, depth, start = [], 0, None
    for i, ch in enumerate(text):
        if ch == "[":
            if depth == 0:
                start = i + 1
            depth += 1
        elif ch == "]":
            depth -= 1
            if depth == 0:
                out.append(text[start:i])
    return out


def unpartitioned_windows_not_on_aggregates(df) -> list[str]:
    df.write.format("noop").mode("overwrite").save()
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    bad = []
    for i, line in enumerate(lines):
        if "Window [" not in line:
            continue
        groups = _top_lists(line[line.index("Window ["):])
        if len(groups) != 2:
            continue  # exprs, partition spec, order spec: a partitioned window
        for below in lines[i + 1:]:
            node = re.sub(r"^[\s:+\-|*()0-9]*", "", below)
            name = re.split(r"[\s(\[]", node, maxsplit=1)[0]
            if name in PASS_THROUGH:
                continue
            if not name.endswith("Aggregate"):
                bad.append(line.strip()[:120] + " ON " + node[:80])
            break
    return bad


def test_single_axis_operators_stay_distributed(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderdate", "o_totalprice")
    u = o.groupBy("o_orderdate").agg(F.avg("o_totalprice").alias("v"))
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "value")
    filled, rep = gaps.gap_fill(u, "o_orderdate")
    frames = [gaps.ts_delta(u, "o_orderdate"), rep, filled,
              series.positional_window(e, "ts", 10, order=["ts", "event_id"]),
              series.minmax_downsample(e, "ts", "value", 50)]
    for df in frames:
        assert unpartitioned_windows_not_on_aggregates(df) == []


def test_bad_runs_and_merge_stay_distributed(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("ts", F.when(F.col("value") > 100, 999999.0)
                                                              .otherwise(F.col("value")).alias("v"))
    runs = quality.bad_runs(e, "ts", ["v"])
    assert unpartitioned_windows_not_on_aggregates(runs) == []
    assert unpartitioned_windows_not_on_aggregates(quality.merge_intervals(runs)) == []


def test_intervals_are_shuffled_once_and_nothing_is_written(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_type", "ts", F.when(F.col("value") > 100, 999999.0)
                                                              .otherwise(F.col("value")).alias("v"))
    runs = quality.bad_runs(e, "ts", ["v"], ["event_type"], bucket="month")
    iv = spark.createDataFrame(runs.collect(), runs.schema)
    for df in (runs, quality.merge_intervals(iv, ["event_type"], bucket="month")):
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        rows = [n for n in plan.split("\n") if "Exchange hashpartitioning(__cw_key" in n and "ReusedExchange" not in n]
        assert len(rows) == 1, rows  # by (key, bucket), shared by all branches of the plan


def test_clip_pushed_to_scan(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    plan = series.time_range_clip(e.select("ts", "value"), "ts", "2024-01-02", "2024-01-03") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan
