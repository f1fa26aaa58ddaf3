"""Cases in which rows or values were once lost or changed."""

import collections
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.ordered import ordered_columns
from chronoweave.functions.timecols import micros_between
from chronoweave.operators import catalogue, clean, gaps, quality, series
from chronoweave.plans.chart import series_query
from chronoweave.sources import files
from tests.helpers import frame, ts


def test_equal_rows_survive_downsampling(spark):
    rows = [("k", ts(0), 1.0)] * 3 + [("k", ts(1), 2.0)]
    df = frame(spark, rows, "k string, Timestamp timestamp_ntz, value double")
    for down in (series.minmax_downsample, series.lttb_downsample):
        assert sorted(tuple(r) for r in down(df, "Timestamp", "value", 10, ["k"]).collect()) == sorted(rows)


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "decimal(5,2)", "decimal(9,2)", "float"])
def test_inserted_rows_hold_the_fill_value(spark, kind):
    rows = [(ts(x), 1.5) for x in (0, 10, 20, 50, 60)]
    df = frame(spark, rows, "Timestamp timestamp_ntz, a double").withColumn("a", F.col("a").cast(kind))
    out, _ = gaps.gap_fill(df, "Timestamp")
    got = {r["Timestamp"]: float(r["a"]) for r in out.collect()}
    assert got[ts(30)] == got[ts(40)] == 999999.0 and len(got) == 7
    assert got[ts(0)] == float(df.first()["a"])


def test_numbers_carry_no_type_letter(spark):
    df = frame(spark, [("1d",), ("12F",), (" 3.5 ",), ("-1e3",), (".5",), ("x",), (None,), ("nan",)], "a string")
    got = [r.a for r in clean.numeric_coerce(df, ["a"]).collect()]
    assert got == [None, None, 3.5, -1000.0, 0.5, None, None, None]


def test_quoted_headers_and_booleans(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Timestamp,"P, kW",ok,part\n2024-01-01 00:00:00,5,True,1d\n2024-01-01 00:01:00,6,false,2d\n')
    df = files.scan_union(spark, [str(tmp_path / "a.csv")])
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [
        ("Timestamp", "timestamp_ntz"), ("P, kW", "bigint"), ("ok", "boolean"), ("part", "string")]
    assert [(r["P, kW"], r["ok"]) for r in df.orderBy("Timestamp").collect()] == [(5, True), (6, False)]
    assert clean.unify_duplicates(df.drop("part")).orderBy("Timestamp").first()["ok"] == 1.0


def test_symmetric_range_leaves_out_series_with_missing_values(spark):
    df = frame(spark, [(1.0, 5.0), (float("nan"), -3.0), (100.0, 2.0)], "a double, b double")
    assert tuple(quality.symmetric_range(df, ["a", "b"]).first()) == (-5.0, 5.0)
    df = frame(spark, [(1.0, 5.0), (None, -7.0)], "a double, b double")
    assert tuple(quality.symmetric_range(df, ["a", "b"]).first()) == (-7.0, 7.0)


def test_type_filter_matches_every_suffix(spark):
    options = frame(spark, [(1, "x", "c::raw::a::b"), (2, "y", "c::raw::b::a")], "ordinal long, label string, value string")
    cat = frame(spark, [(1, "c", None, "a::b", None, None, "volt", None)],
                "ordinal long, component_id string, component_name string, measurement string, display_name string, "
                "unit string, type string, description string")
    assert [r.value for r in catalogue.filter_type(options, "volt", cat).collect()] == ["c::raw::a::b"]


def test_dotted_names_as_keys_and_order(spark):
    df = frame(spark, [("k", ts(i), i) for i in range(4)], "`a.b` string, `t.s` timestamp_ntz, v int")
    out = ordered_columns(df, "t.s", partition_by=["a.b"], lag={"p": F.col("`t.s`")}, cumsum={"n": F.lit(1)})
    assert sorted((r["t.s"], r["p"], r["n"]) for r in out.collect())[1:] == [(ts(i), ts(i - 1), i + 1) for i in range(1, 4)]
    filled, _ = gaps.gap_fill(df, "t.s", ["a.b"])
    assert filled.count() == 4


def test_clock_change_hours_are_ordinary_hours(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Madrid")
    try:
        start = dt.datetime(2024, 3, 31)
        texts = [((start + dt.timedelta(minutes=30 * i)).isoformat(sep=" "),) for i in range(12)]
        df = clean.drop_invalid_ts(frame(spark, texts, "Timestamp string"), "Timestamp")
        assert df.count() == 12 and gaps.gap_report(df, "Timestamp").count() == 0
        with_format = clean.drop_invalid_ts(frame(spark, texts, "Timestamp string"), "Timestamp", "yyyy-MM-dd HH:mm:ss")
        assert sorted(r[0] for r in with_format.collect()) == sorted(r[0] for r in df.collect())
        x = frame(spark, [(dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(2024, 3, 31, 2, 30))],
                  "a timestamp_ntz, b timestamp_ntz")
        want = (dt.datetime(2024, 3, 31, 2, 30) - dt.datetime(1969, 12, 31, 23, 59, 59, 999_999)) // dt.timedelta(microseconds=1)
        assert x.select(micros_between("a", "b")).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_label_of_plain_text(spark):
    df = frame(spark, [("pump",), ("2024-03-04 05:06:07",), (None,)], "t string")
    assert [r[0] for r in df.select(series.ts_label(F.col("t"))).collect()] == ["pump", "2024-03-04\n05:06:07", None]


def test_unreadable_groups_are_not_overwritten(spark, tmp_path):
    d = tmp_path / "d.json"
    d.write_text('{"a_Q01": 1}')
    g = tmp_path / "groups"
    g.mkdir()
    (g / "part-0.json").write_bytes(b"\x1f\x8bnot json")
    files.ensure_event_groups(spark, str(d), str(g))
    assert (g / "part-0.json").read_bytes() == b"\x1f\x8bnot json"
    assert files.ensure_event_groups(spark, str(d), str(tmp_path / "new")).count() == 1


def test_chart_reads_only_the_months_it_shows_and_writes_nothing_unasked(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(200)]
    table = files.materialize(frame(spark, rows, "Timestamp timestamp_ntz, a double"), str(tmp_path / "t"))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    seen = set(os.listdir(shared)) if shared else set()
    c = series_query(table, ["a"], "Timestamp", "2024-03-01", "2024-03-31", n=10)
    plan = c.points._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ts_month" in plan and "GreaterThanOrEqual(Timestamp" in plan
    assert c.points.count() == 10
    if shared:
        assert set(os.listdir(shared)) == seen
    assert c.boxes.count() == 0


def test_manifest_values_keep_their_types(spark, tmp_path):
    from chronoweave.operators.validate import validate_manifest_values
    from chronoweave.sources.registry import read_manifest_values, scan_datasets
    (tmp_path / "a set").mkdir()
    (tmp_path / "a set" / "control_dataset.yml").write_text(
        "metadata: {version: 1.0, dataset: a, description: '', date_created: '2024', type: TabularDataSet}\n"
        "pipelineCleanData:\n  run_enabled: 'yes'\n  available_functions:\n"
        "    - merge_all_datasets: {enabled: true, module: m, func: f, description: d}\n"
        "    - rellenar_timestamps: {enabled: 1, module: m}\n")
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "control_dataset.yml").write_text("other: 1\nmetadata: {}\n")
    got = {(r.dataset, r.section, r.step, r.rule, r.field) for r in
           validate_manifest_values(read_manifest_values(spark, str(tmp_path))).collect()}
    assert {g[1:] for g in got if g[0] == "a set"} == {
        ("metadata", None, "type", "version"), ("metadata", None, "required", "description"),
        ("pipelineCleanData", None, "type", "run_enabled"), ("step", "rellenar_timestamps", "type", "enabled"),
        ("step", "rellenar_timestamps", "required", "func"), ("step", "rellenar_timestamps", "required", "description")}
    assert {g[4] for g in got if g[0] == "empty"} == {"version", "dataset", "description", "date_created", "type"}
    assert [r["name"] for r in scan_datasets(spark, str(tmp_path)).orderBy("name").collect()] == ["a set", "empty"]
    assert scan_datasets(spark, str(tmp_path / "nowhere")).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_manifest_values_are_never_broadcast(spark):
    from chronoweave.operators.validate import validate_manifest_values
    rows = [(f"d{i % 3}" if i else None, "metadata", None, "version", "str" if i % 2 else "float", "1") for i in range(8)]
    out = validate_manifest_values(spark.createDataFrame(
        rows, "dataset string, section string, step string, field string, type string, text string"))
    # the fixed schema alone may be broadcast: values grow with the manifests, whatever their size estimate says
    assert _plan(out).count("BroadcastExchange") == 1 and "SortMergeJoin" in _plan(out)
    got = [(r.dataset, r.rule, r.field) for r in out.collect()]
    assert got.count(("d0", "type", "version")) == 1 and got.count(("d1", "type", "version")) == 1  # of d0: 3, 6; d1: 1, 4, 7
    assert got.count((None, "required", "version")) == 1  # a null name finds no value
    assert len(got) == 2 + 1 + got.count(("d2", "type", "version")) + 4 * 4


def test_reading_columns_join_each_part_once(spark, tmp_path):
    from chronoweave.plans.checks_meta import reading_columns
    spark.createDataFrame([(1, "a", "T"), (1, "b", "T"), (2, "c", "U"), (None, "d", "V")],
                          "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,)] * 500 + [(3,), (None,)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = reading_columns(spark, str(tmp_path))
    assert {(r.ordinal, r.column) for r in out.collect()} == {(0, "Timestamp"), (1, "a"), (1, "b"), (1, "t")}
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("LeftSemi" in x for x in lines) == sum("Aggregate [p_partkey" in x or "Aggregate [l_partkey" in x for x in lines) == 2


def test_ranking_tasks_follow_the_rows(spark, monkeypatch):
    from chronoweave.functions import ordered
    monkeypatch.setattr(ordered, "RANK_ROWS", 100)
    rows = [("a", ts(i % 700 * 86400), float(i % 5)) for i in range(4200)]
    df = frame(spark, rows, "k string, t timestamp_ntz, value double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else rows this few are broadcast to their histogram
    try:
        out = ordered.ordered_positions(df, "t", order=["t", "value"], partition_by=["k"])
        tasks = out.select("__rn", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = collections.Counter(r.task for r in tasks)
    assert len(tasks) == 4200 and len(counts) > 16 and max(counts.values()) < 700  # before: 8 tasks at most
    for bucket in ("auto", "month"):
        got = ordered.ordered_positions(df, "t", order=["t", "value"], partition_by=["k"], bucket=bucket)
        assert sorted((r.t, r.value, r["__rn"], r["__cnt"]) for r in got.collect()) == [
            (t, v, i + 1, 4200) for i, (t, v) in enumerate(sorted((r[1], r[2]) for r in rows))]
