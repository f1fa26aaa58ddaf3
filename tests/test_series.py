import datetime as dt

from pyspark.sql import functions as F

from chronoweave.operators import series
from tests.helpers import frame, ts


def test_time_range_clip_closed_and_optional(spark):
    df = frame(spark, [(ts(0),), (ts(10),), (ts(20),)], "Timestamp timestamp_ntz")
    assert series.time_range_clip(df, "Timestamp", ts(0), ts(10)).count() == 2
    assert series.time_range_clip(df, "Timestamp", ts(0), None).count() == 3
    assert series.time_range_clip(df, "Timestamp", "nonsense", "2030-01-01").count() == 3
    plan = series.time_range_clip(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts",
                                  "2024-01-02", "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan


def test_selector_decode(spark):
    df = frame(spark, [("B::raw::a::b",), ("plain",), ("x::y",)], "code string")
    got = [tuple(r) for r in df.select(series.selector_decode(F.col("code")).alias("s")).select("s.*").collect()]
    assert got == [("B", "raw", "a::b"), (None, None, "plain"), (None, None, "x::y")]


def test_positional_window_sizes(spark):
    for n, size in ((1000, 200), (5000, 500)):
        df = frame(spark, [(i, ts(i)) for i in range(n)], "id long, Timestamp timestamp_ntz")
        w = series.positional_window(df, "Timestamp", n, order=["Timestamp", "id"])
        pos = sorted(r.row_pos for r in w.collect())
        assert len(pos) == size and pos[0] == n - size


def test_minmax_downsample(spark):
    rows = [("s", ts(i), float(i % 17)) for i in range(1000)] + [("t", ts(i), 1.0) for i in range(5)]
    df = frame(spark, rows, "k string, Timestamp timestamp_ntz, value double")
    out = series.minmax_downsample(df, "Timestamp", "value", 100, ["k"])
    s = out.where("k = 's'")
    assert s.count() <= 100
    assert s.agg(F.min("value"), F.max("value")).first() == (0.0, 16.0)
    assert out.where("k = 't'").count() == 5
    assert out.join(df, ["k", "Timestamp", "value"], "left_anti").count() == 0


def test_lttb_properties(spark):
    rows = [("s", ts(i), float((i * 7919) % 101)) for i in range(3000)]
    df = frame(spark, rows, "k string, Timestamp timestamp_ntz, value double")
    out = series.lttb_downsample(df, "Timestamp", "value", 100, ["k"])
    ts_out = sorted(r.Timestamp for r in out.collect())
    assert len(ts_out) <= 100 and ts_out[0] == ts(0) and ts_out[-1] == ts(2999)
    assert out.join(df, ["k", "Timestamp", "value"], "left_anti").count() == 0


def test_ts_label(spark):
    df = frame(spark, [(dt.datetime(2024, 3, 4, 5, 6, 7),)], "t timestamp_ntz")
    assert df.select(series.ts_label(F.col("t"))).first()[0] == "2024-03-04\n05:06:07"


def test_chart_request_outputs(spark):
    from chronoweave.plans.chart import series_query
    rows = [(ts(i * 10), float(i % 13), 999999.0 if 20 <= i < 25 else 1.0) for i in range(500)]
    df = frame(spark, rows, "Timestamp timestamp_ntz, a double, b double")
    c = series_query(df, ["a", "x::raw::b", "zz"], "Timestamp", ts(0), ts(4000), n=50)
    assert c.points.where("series = 'a'").count() <= 50
    assert {r.series for r in c.extrema.collect()} == {"a", "b"}
    assert c.overall.first().marker_level == 0.0
    assert c.markers.count() == 5
    box = c.boxes.collect()
    assert len(box) == 1 and box[0].start == ts(195) and box[0].end == ts(245)
    assert c.bounds.first().ts_max == ts(4990)


def test_chart_resolution_from_whole_table(spark):
    from chronoweave.plans.chart import series_query
    # whole table sampled every 10 s; the visible part has a 30 s spacing
    rows = [(ts(i * 10), 1.0) for i in range(100)] + [(ts(2000 + i * 30), 999999.0) for i in range(3)]
    df = frame(spark, rows, "Timestamp timestamp_ntz, a double")
    c = series_query(df, ["a"], "Timestamp", ts(2000), ts(2100), n=50)
    # 30 s steps exceed 10 s + 0.5 s: three separate runs of +-5 s
    got = sorted((r.start, r.end) for r in c.boxes.collect())
    assert got == [(ts(1995), ts(2005)), (ts(2025), ts(2035)), (ts(2055), ts(2065))]
