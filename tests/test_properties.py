"""Property tests on seeded random frames."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from chronoweave.operators import clean, gaps, quality
from tests.helpers import frame, ts

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

steps_strategy = st.lists(st.sampled_from([10, 10, 10, 10, 20, 35, 61, 9.6, 10.7, 4]), min_size=3, max_size=40)


def _axis(spark, steps):
    t, rows = 0.0, []
    for i, s in enumerate(steps):
        rows.append((ts(t), float(i)))
        t += s
    return frame(spark, rows, "Timestamp timestamp_ntz, a double")


@SETTINGS
@given(steps=steps_strategy)
def test_fill_leaves_nothing_to_fill(spark, steps):
    df = _axis(spark, steps)
    filled, _ = gaps.gap_fill(df)
    assert gaps.gap_report(filled).where("missing_samples > 0").count() == 0
    # original rows are all kept
    assert df.join(filled, ["Timestamp", "a"], "left_anti").count() == 0


@SETTINGS
@given(vals=st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.floats(-5, 5))), min_size=1, max_size=30))
def test_unify_idempotent(spark, vals):
    df = frame(spark, [(ts(k), v) for k, v in vals], "Timestamp timestamp_ntz, a double")
    once = clean.unify_duplicates(df)
    twice = clean.unify_duplicates(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.count() == once.select("Timestamp").distinct().count()


@SETTINGS
@given(vals=st.lists(st.sampled_from([999999.0, -999999.0, 999998.0, 999998.5, 1.0, None]), min_size=1, max_size=30))
def test_classes_partition_rows(spark, vals):
    df = frame(spark, [(v,) for v in vals], "value double")
    c = quality.sentinel_classes(df).groupBy("class").count().collect()
    assert sum(r["count"] for r in c) == len(vals)
    assert {r["class"] for r in c} <= {"gap", "anomaly", "valid", "ignored"}


@SETTINGS
@given(iv=st.lists(st.tuples(st.integers(0, 300), st.integers(0, 40), st.sampled_from(["red", "orange"])),
                   min_size=1, max_size=25))
def test_merge_idempotent(spark, iv):
    df = frame(spark, [(ts(s), ts(s + w), c) for s, w, c in iv], "start timestamp_ntz, end timestamp_ntz, class string")
    once = quality.merge_intervals(df)
    twice = quality.merge_intervals(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
