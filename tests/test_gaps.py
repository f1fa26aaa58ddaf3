from pyspark.sql import functions as F

from chronoweave.operators import gaps
from tests.helpers import frame, ts

SCHEMA = "Timestamp timestamp_ntz, a double, b double"


def axis(spark, secs):
    return frame(spark, [(ts(s), 1.0, 2.0) for s in secs], SCHEMA)


def test_resolution_tie_smallest(spark):
    r = gaps.resolution(axis(spark, [0, 10, 20, 40, 60])).collect()
    assert r[0].resolution_seconds == 10.0


def test_single_row_no_resolution(spark):
    df = axis(spark, [0])
    assert gaps.resolution(df).count() == 0
    assert gaps.gap_report(df).count() == 0
    filled, rep = gaps.gap_fill(df)
    assert filled.count() == 1 and rep.count() == 0
    fb = gaps.resolution_with_fallback(df).collect()[0]
    assert fb.resolution_seconds == 10.0 and fb.threshold_seconds == 10.5


def test_gap_report_rules(spark):
    secs = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90]
    steps = [10.4, 10.6, 25, 29.6, 4]
    t = 90
    for s in steps:
        t += s
        secs.append(t)
    rep = {round(r.gap_seconds, 6): r.missing_samples for r in gaps.gap_report(axis(spark, secs)).collect()}
    assert 10.4 not in rep
    assert rep[10.6] == 0 and rep[25.0] == 1 and rep[29.6] == 2 and rep[4.0] == 0


def test_gap_fill_inserts_sentinels(spark):
    df = axis(spark, [0, 10, 20, 30, 70, 80])
    filled, rep = gaps.gap_fill(df)
    ins = filled.where(F.col("a") == 999999.0).orderBy("Timestamp").collect()
    assert [r.Timestamp for r in ins] == [ts(40), ts(50), ts(60)]
    assert all(r.b == 999999.0 for r in ins)
    assert gaps.gap_report(filled).where("missing_samples > 0").count() == 0


def test_gap_fill_chunks_long_outage(spark):
    df = axis(spark, [0, 1, 2, 3, 3 + 2500])
    filled, _ = gaps.gap_fill(df, chunk=7)
    assert filled.count() == 5 + 2499
    assert filled.select("Timestamp").distinct().count() == 5 + 2499


def test_no_gaps_unchanged(spark):
    df = axis(spark, [0, 10, 20])
    filled, rep = gaps.gap_fill(df)
    assert rep.count() == 0 and filled.count() == 3


def test_keyed_resolution(spark):
    rows = [("x", ts(s), 1.0) for s in (0, 5, 10)] + [("y", ts(s), 1.0) for s in (0, 60, 120, 300)]
    df = frame(spark, rows, "k string, Timestamp timestamp_ntz, a double")
    r = {x.k: x.resolution_seconds for x in gaps.resolution(df, partition_by=["k"]).collect()}
    assert r == {"x": 5.0, "y": 60.0}
    rep = gaps.gap_report(df, partition_by=["k"]).collect()
    assert [(x.k, x.missing_samples) for x in rep] == [("y", 2)]


def test_null_key_series_kept(spark):
    rows = [(None, ts(s), 1.0) for s in (0, 10, 40)] + [("y", ts(s), 1.0) for s in (0, 5, 10)]
    df = frame(spark, rows, "k string, Timestamp timestamp_ntz, a double")
    rep = gaps.gap_report(df, partition_by=["k"]).collect()
    assert [(r.k, r.missing_samples) for r in rep] == [(None, 2)]
    filled, _ = gaps.gap_fill(df, partition_by=["k"])
    assert filled.where("k is null").count() == 5


def test_cleaning_run_with_auto_bucket(spark):
    from chronoweave.plans import steps
    df = axis(spark, [0, 10, 20, 30, 70, 80, 80])
    cfg = {"run_enabled": True, "available_functions": [
        {"clean_and_unify_duplicates": {"enabled": True}}, {"rellenar_timestamps": {"enabled": True}}]}
    out, ctx = steps.run_steps(df, cfg, bucket="auto")
    assert out.count() == 6 + 3
    assert ctx.reports["gap_report"].where("missing_samples = 3").count() == 1
