import math

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import clean
from chronoweave.plans import steps
from tests.helpers import frame, ts

SCHEMA = "Timestamp timestamp_ntz, a double"


def test_drop_invalid_ts(spark):
    df = frame(spark, [("bad", 1.0), (None, 2.0), ("2024-01-01 00:00:10", 3.0)], "Timestamp string, a double")
    out = clean.drop_invalid_ts(df).collect()
    assert [r.a for r in out] == [3.0]
    assert out[0].Timestamp == ts(10)


def test_unify_mean_skips_missing(spark):
    df = frame(spark, [(ts(0), 1.0), (ts(0), 3.0), (ts(0), None), (ts(10), None), (ts(20), float("nan")),
                       (ts(20), 4.0)], SCHEMA)
    got = {r.Timestamp: r.a for r in clean.unify_duplicates(df).collect()}
    assert got[ts(0)] == 2.0 and got[ts(10)] is None and got[ts(20)] == 4.0


def test_unify_rejects_text(spark):
    df = frame(spark, [(ts(0), "x")], "Timestamp timestamp_ntz, s string")
    with pytest.raises(ValueError):
        clean.unify_duplicates(df)


def test_duplicate_report_keeps_all_copies(spark):
    df = frame(spark, [(ts(1), 1.0), (ts(1), 2.0), (ts(2), 3.0)], SCHEMA)
    assert sorted(r.a for r in clean.duplicate_report(df).collect()) == [1.0, 2.0]


def test_sentinel_to_null_tolerance(spark):
    import numpy as np
    f32 = float(np.float32(-327.68))
    df = frame(spark, [(ts(0), -327.679993), (ts(1), f32), (ts(2), -327.68), (ts(3), None)],
               "Timestamp timestamp_ntz, `MG-LV-MSB_Frequency` double")
    out = clean.sentinel_to_null(df, ["MG-LV-MSB_Frequency", "unknown"]).orderBy("Timestamp").collect()
    vals = [r["MG-LV-MSB_Frequency"] for r in out]
    assert vals[0] is None and vals[1] is None and vals[2] == -327.68 and vals[3] is None


def test_unify_before_sentinel_keeps_mean(spark):
    df = frame(spark, [(ts(0), -327.679993), (ts(0), 50.0)], "Timestamp timestamp_ntz, `MG-LV-MSB_Frequency` double")
    cfg = {"run_enabled": True, "available_functions": [
        {"clean_and_unify_duplicates": {"enabled": True}}, {"negative_freq_report": {"enabled": True}}]}
    out, _ = steps.run_steps(df, cfg)
    v = out.collect()[0]["MG-LV-MSB_Frequency"]
    assert math.isclose(v, (50.0 - 327.679993) / 2)


def test_normalize_ts_choices(spark):
    a = frame(spark, [("2024-01-01 00:00:00", 1.0)], "TIMESTAMP string, a double")
    assert "Timestamp" in clean.normalize_ts(a).columns
    b = frame(spark, [(ts(0), 1.0)], "when timestamp_ntz, a double")
    assert clean.normalize_ts(b).columns[0] == "Timestamp"
    c = frame(spark, [(1, 1.0)], "k int, a double")
    assert clean.normalize_ts(c).columns == ["k", "a"]


def test_numeric_coerce(spark):
    df = frame(spark, [("1.5",), ("NA",), ("x",), ("NaN",)], "a string")
    got = [r.a for r in clean.numeric_coerce(df, ["a", "zz"]).collect()]
    assert got == [1.5, None, None, None]


def test_run_disabled_is_raw_load(spark):
    df = frame(spark, [("2024-01-01 00:00:00", 1.0), ("2024-01-01 00:00:00", 2.0)], "Timestamp string, a double")
    out, _ = steps.run_steps(df, {"run_enabled": False})
    assert out.count() == 2
    with pytest.raises(RuntimeError):
        steps.run_steps(df, {"run_enabled": True, "available_functions": []})


def test_step_config_forms():
    assert steps.declared_steps({"available_functions": {"a": None}}) == {"a": {}}
    assert steps.declared_steps({"available_functions": [{"b": {"enabled": True}}]}) == {"b": {"enabled": True}}
