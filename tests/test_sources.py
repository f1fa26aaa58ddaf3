import datetime as dt
import json

import pytest

from chronoweave.sources import files, registry


def test_select_files_name_order_year_and_cap(spark, tmp_path):
    for n in ("202403.csv", "202401.csv", "202302.csv", "202402.csv"):
        (tmp_path / n).write_text("Timestamp,a\n2024-01-01 00:00:00,1\n")
    got = files.select_files(spark, str(tmp_path / "*.csv"), max_files=2, year_filter="2024")
    assert [p.rsplit("/", 1)[1] for p in got] == ["202401.csv", "202402.csv"]
    with pytest.raises(FileNotFoundError):
        files.select_files(spark, str(tmp_path / "*.csv"), year_filter="1999")


def test_read_first_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("when,x\n2024-01-01 00:00:00,1\n")
    (tmp_path / "a.csv").write_text("when,x\n2024-01-02 00:00:00,2\nnot a time,3\n")
    df, name = files.read_first_csv(spark, str(tmp_path))
    assert name == "a.csv" and dict(df.dtypes)["when"] == "string"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "z.csv").write_text("when,x\n2024-01-02 00:00:00,2\n")
    df2, _ = files.read_first_csv(spark, str(tmp_path / "c"))
    assert dict(df2.dtypes)["when"] == "timestamp_ntz"
    assert files.read_first_csv(spark, str(tmp_path / "missing")) == (None, None)


def test_materialize_sorted_month_partitions(spark, tmp_path):
    rows = [(dt.datetime(2024, m, d), float(m * 100 + d)) for m in (1, 2, 3) for d in (3, 1, 2)]
    df = spark.createDataFrame(rows, "Timestamp timestamp_ntz, a double")
    back = files.materialize(df, str(tmp_path / "t"), "Timestamp")
    assert back.count() == 9 and dict(back.dtypes)["Timestamp"] == "timestamp_ntz"
    assert sorted(r.ts_month for r in back.select("ts_month").distinct().collect()) == ["2024-01", "2024-02", "2024-03"]
    sample, cols = files.sample_and_columns(back, "Timestamp", 2)
    assert [r.a for r in sample.collect()] == [101.0, 102.0] and cols == ["a"]


def test_ensure_event_groups_builds_once(spark, tmp_path):
    d = tmp_path / "dict.json"
    d.write_text(json.dumps({"A_Q05": 1, "A_from_Q05_to_Q10": 2}))
    out = str(tmp_path / "groups")
    g = files.ensure_event_groups(spark, str(d), out)
    assert [r.component for r in g.collect()] == ["A"]
    d.write_text(json.dumps({"B_Q01": 1}))
    assert [r.component for r in files.ensure_event_groups(spark, str(d), out).collect()] == ["A"]
    with pytest.raises(ValueError):
        files.ensure_event_groups(spark, "", str(tmp_path / "none"))


def test_scan_datasets(spark, tmp_path):
    ds = tmp_path / "My-Set"
    ds.mkdir()
    (ds / "control_dataset.yml").write_text(
        "metadata:\n  version: 1\n  dataset: My-Set\n  description: d\n  date_created: 2024-01-01\n"
        "pipelineCleanData:\n  run_enabled: true\n  available_functions:\n"
        "    - clean_and_unify_duplicates: {enabled: true}\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "no_manifest").mkdir()
    reg = registry.scan_datasets(spark, str(tmp_path)).collect()
    assert len(reg) == 1
    r = reg[0]
    assert r.name == "My-Set" and r.table_name == "my_set" and r.type == "TabularDataSet"
    assert r.steps[0].name == "clean_and_unify_duplicates" and r.steps[0].enabled


def test_build_dataset_once(spark, tmp_path):
    from chronoweave.plans import steps
    (tmp_path / "202401.csv").write_text(
        "Timestamp,MG-LV-MSB_Frequency,b\n2024-01-01 00:00:00,50,1\n2024-01-01 00:00:00,-327.679993,3\n"
        "2024-01-01 00:00:10,-327.679993,NA\n2024-01-01 00:00:40,49,2\nbad,1,1\n")
    (tmp_path / "202402.csv").write_text("Timestamp,b\n2024-01-01 00:00:50,5\n")
    cfg = {"run_enabled": True, "available_functions": [
        {"merge_all_datasets": {"enabled": True}}, {"clean_and_unify_duplicates": {"enabled": True}},
        {"negative_freq_report": {"enabled": True}}, {"rellenar_timestamps": {"enabled": True}},
        {"normalize_timestamp_column": {"enabled": True}}]}
    paths = [str(tmp_path / "202401.csv"), str(tmp_path / "202402.csv")]
    t = steps.build_dataset(spark, "cw_test_ds", paths, cfg)
    rows = {r.Timestamp.second: r for r in t.collect()}
    assert sorted(rows) == [0, 10, 20, 30, 40, 50]
    assert rows[10]["MG-LV-MSB_Frequency"] is None          # fault value removed
    assert rows[20]["b"] == 999999.0 and rows[30]["b"] == 999999.0  # gap rows
    (tmp_path / "202401.csv").write_text("Timestamp,b\n2030-01-01 00:00:00,1\n")
    assert steps.build_dataset(spark, "cw_test_ds", paths, cfg).count() == 6   # not rebuilt


def test_run_metrics_counts(spark, tmp_path):
    from chronoweave.plans import steps
    (tmp_path / "a.csv").write_text("Timestamp,MG-LV-MSB_Frequency\n2024-01-01 00:00:00,-327.679993\n"
                                    "2024-01-01 00:00:10,50\n2024-01-01 00:00:10,52\n")
    (tmp_path / "b.csv").write_text("Timestamp,MG-LV-MSB_Frequency\n2024-01-01 00:00:40,49\nbad,1\n")
    raw = files.scan_union(spark, files.select_files(spark, str(tmp_path / "*.csv")), with_file=True)
    cfg = {"run_enabled": True, "available_functions": [
        {"merge_all_datasets": {"enabled": True}}, {"clean_and_unify_duplicates": {"enabled": True}},
        {"negative_freq_report": {"enabled": True}}, {"rellenar_timestamps": {"enabled": True}}]}
    out, ctx = steps.run_steps(raw.drop("_source_file"), cfg)
    m = {(r.step, r.metric): r.value for r in steps.run_metrics(raw, out, ctx).collect()}
    assert m[("load", "rows_in")] == 5 and m[("load", "rows_valid_ts")] == 4 and m[("load", "files")] == 2
    assert m[("load", "rows:a.csv")] == 3
    assert m[("unify", "rows_with_duplicate_ts")] == 2
    assert m[("sentinel", "replaced:MG-LV-MSB_Frequency:-327.679993")] == 1
    assert m[("fill", "rows_inserted")] == 2 and m[("final", "rows_out")] == 5


def test_clip_prunes_month_folders(spark, tmp_path):
    from chronoweave.operators import series
    rows = [(dt.datetime(2024, m, 15), float(m)) for m in range(1, 13)]
    back = files.materialize(spark.createDataFrame(rows, "Timestamp timestamp_ntz, a double"),
                             str(tmp_path / "t"), "Timestamp")
    clipped = series.time_range_clip(back, "Timestamp", "2024-03-01", "2024-04-30")
    assert sorted(r.a for r in clipped.collect()) == [3.0, 4.0]
    plan = clipped._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ts_month" in plan
