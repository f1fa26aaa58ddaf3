import random

from pyspark.sql import functions as F

from chronoweave.operators import quality
from tests.helpers import frame, ts


def test_sentinel_classes_partition(spark):
    df = frame(spark, [(999999.0,), (-999999.0,), (999998.0,), (999998.5,), (None,)], "value double")
    got = [r["class"] for r in quality.sentinel_classes(df).collect()]
    assert got == ["gap", "anomaly", "valid", "ignored", "ignored"]


def test_bad_runs_intervals(spark):
    rows = [(ts(s), 1.0) for s in range(0, 200, 10)]
    rows = [(t, 999999.0 if i in (0, 1, 2, 5) else v) for i, (t, v) in enumerate(rows)]
    df = frame(spark, rows, "Timestamp timestamp_ntz, a double")
    out = quality.bad_runs(df, "Timestamp", ["a"]).orderBy("start").collect()
    assert [(r.start, r.end, r["class"]) for r in out] == [(ts(-5), ts(25), "red"), (ts(45), ts(55), "red")]


def _merge_ref(iv, order=("red", "orange")):
    """The sequential rule; equal starts by class place, then end (without known classes by end, then class)."""
    iv = sorted(iv, key=lambda x: (x[0], order.index(x[2]), x[1]) if order else x)
    out = [list(iv[0])]
    for s, e, c in iv[1:]:
        if s <= out[-1][1] and c == out[-1][2]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, c])
    return sorted(tuple(x) for x in out)


def _merge(spark, iv, classes=("red", "orange")):
    df = frame(spark, [(ts(s), ts(e), c) for s, e, c in iv], "start timestamp_ntz, end timestamp_ntz, class string")
    return sorted(((r.start - ts(0)).total_seconds(), (r.end - ts(0)).total_seconds(), r["class"])
                  for r in quality.merge_intervals(df, classes=classes).collect())


def test_merge_cases(spark):
    assert _merge(spark, [(0, 10, "red"), (5, 20, "red"), (8, 9, "orange")]) == [(0, 20, "red"), (8, 9, "orange")]
    assert len(_merge(spark, [(0, 30, "red"), (5, 6, "orange"), (10, 20, "red")])) == 3
    assert _merge(spark, [(0, 10, "red"), (10, 20, "red")]) == [(0, 20, "red")]


def test_merge_matches_sequential_rule(spark):
    rnd = random.Random(3)
    for _ in range(4):
        iv = []
        for _ in range(40):
            s = rnd.randrange(0, 500)
            iv.append((s, s + rnd.randrange(0, 40), rnd.choice(["red", "orange"])))
        iv += iv[:5]  # equal intervals
        ref = [(float(a), float(b), c) for a, b, c in _merge_ref(iv)]
        assert _merge(spark, iv) == ref
        ref = [(float(a), float(b), c) for a, b, c in _merge_ref(iv, None)]
        assert _merge(spark, iv, classes=None) == ref


def test_merge_breaks_ties_by_series_then_class(spark):
    iv = [("b", 0, 5, "red"), ("a", 0, 5, "orange"), ("a", 0, 9, "red")]
    df = frame(spark, [(s, ts(x), ts(y), c) for s, x, y, c in iv],
               "series string, start timestamp_ntz, end timestamp_ntz, class string")
    out = quality.merge_intervals(df, series=["a", "b"])  # red, orange, red: no two neighbours share a class
    assert out.count() == 3
    assert quality.merge_intervals(df, series=["b", "a"]).count() == 2


def test_marker_level_zero_without_valid(spark):
    df = frame(spark, [(ts(0), 999999.0)], "Timestamp timestamp_ntz, a double")
    assert quality.marker_points(df, "Timestamp", ["a"]).collect()[0].y == 0.0


def test_symmetric_range(spark):
    df = frame(spark, [(-3.0,), (2.0,)], "a double")
    r = quality.symmetric_range(df, ["a"]).collect()[0]
    assert (r.range_low, r.range_high) == (-3.0, 3.0)


def test_profile_matches_pandas(spark):
    import pandas as pd
    rnd = random.Random(5)
    vals = [float(rnd.randrange(0, 1000)) / 7 for _ in range(997)]
    df = frame(spark, [(v,) for v in vals], "a double")
    got = quality.profile(df, ["a"]).collect()[0]
    ref = pd.Series(vals).describe()
    for k, rk in (("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("mean", "mean"), ("std", "std")):
        assert abs(got[k] - ref[rk]) < 1e-9


def test_profile_ranks_no_more_than_its_target(spark):
    import pandas as pd
    rnd = random.Random(6)
    vals = [(rnd.gauss(0, 1) ** 3, float(rnd.randrange(5))) for _ in range(3000)] + [(None, None)] * 50 + [(1.5, 2.0)] * 4000
    df = frame(spark, vals, "a double, b double")
    got = {r["column"]: r for r in quality.profile(df, ["a", "b", "absent"], target_rows=20, fan=4).collect()}
    for name, col in (("a", [v[0] for v in vals]), ("b", [v[1] for v in vals])):
        ref = pd.Series(col).describe()
        assert got[name]["count"] == ref["count"]
        for k, rk in (("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("min", "min"), ("max", "max")):
            assert abs(got[name][k] - ref[rk]) < 1e-9
    for n in (300, 3000, 30000):  # the ranking input stays under the target as the table grows
        dv = spark.range(n).selectExpr("'x' AS column", "cast(id * 37 % 100003 AS double) AS value", "id % 3 + 1 AS __c")
        ranges = quality._wanted_ranges(dv, 20, 4)
        assert 1 <= len(ranges) <= 6 and max(r["rows"] for r in ranges) <= 20
        assert sum(r["rows"] for r in ranges) == quality._in_ranges(dv, spark, ranges).count()
    assert quality.profile(spark.createDataFrame([], "a double"), ["a"]).count() == 0


def test_merge_three_classes(spark):
    rnd = random.Random(9)
    iv = sorted({(s, s + rnd.randrange(0, 30), rnd.choice("abc")) for s in (rnd.randrange(0, 400) for _ in range(60))})
    ref = [(float(a), float(b), c) for a, b, c in _merge_ref(iv, ("a", "b", "c"))]
    assert _merge(spark, iv, classes=("a", "b", "c")) == ref


def test_merge_identical_intervals_deterministic(spark):
    # the same red gap seen by two series, next to orange runs (tie in sort order)
    iv = [(21, 23, "orange"), (24, 25, "red"), (24, 25, "red"), (25, 27, "orange"), (28, 29, "orange")]
    ref = [(21.0, 23.0, "orange"), (24.0, 25.0, "red"), (25.0, 27.0, "orange"), (28.0, 29.0, "orange")]
    for _ in range(3):
        assert _merge(spark, iv) == ref
        assert _merge(spark, iv, classes=None) == ref


def brute_runs(rows, res, margin=0.5):
    """Runs per (key, class) walked row by row; rows: (key, second, class)."""
    out = []
    for part in sorted({(k, c) for k, _, c in rows}):
        start = last = None
        for s in sorted(s for k, s, c in rows if (k, c) == part):
            if last is not None and s - last > res + margin:
                out.append((*part, start, last))
                start = None
            start = s if start is None else start
            last = s
        out.append((*part, start, last))
    return sorted(out)


def test_runs_and_merge_across_many_buckets_equal_a_walk(spark):
    import random

    from chronoweave.functions.ordered import time_buckets
    rnd = random.Random(5)
    rows, wide = [], []
    for key in "ab":
        for s in range(0, 40 * 86400, 3600):
            v = rnd.choice([1.0, 2.0, 999999.0, 999999.0, 999999.0, -999999.0])
            if 10 * 86400 < s < 31 * 86400 and key == "a":
                v = 999999.0  # one run through three weeks of buckets
            wide.append((key, ts(s), v))
            if abs(v) == 999999.0:
                rows.append((key, s, "red" if v > 0 else "orange"))
    df = frame(spark, wide, "k string, t timestamp_ntz, v double")
    walked = brute_runs(rows, 3600)
    for bucket in ("month", "day", time_buckets(df, "t", ["k"], target_rows=30)):
        got = quality.bad_runs(df, "t", ["v"], ["k"], bucket=bucket).collect()
        assert sorted((r["k"], r["class"], r["start"], r["end"]) for r in got) == sorted(
            (k, c, ts(a - 1800), ts(z + 1800)) for k, c, a, z in walked)
    iv = [(rnd.choice("ab"), a, a + rnd.choice([0, 50, 400, 9000, 200000]), rnd.choice(["red", "orange", "red"]))
          for a in (rnd.randrange(0, 900000) for _ in range(400))]
    merged = []
    for key in "ab":
        cur = None
        for _, a, z, c in sorted((i for i in iv if i[0] == key), key=lambda i: (i[1], ("red", "orange").index(i[3]), i[2])):
            if cur and cur[3] == c and a <= cur[2]:
                cur[2] = max(cur[2], z)
            else:
                cur = [key, a, z, c]
                merged.append(cur)
    ivs = frame(spark, [(k, ts(a), ts(z), c) for k, a, z, c in iv], "k string, start timestamp_ntz, end timestamp_ntz, class string")
    for bucket in ("day", "1 minute", time_buckets(ivs, "start", ["k"], target_rows=20)):
        got = quality.merge_intervals(ivs, ["k"], bucket=bucket).collect()
        assert sorted((r["k"], r["start"], r["end"], r["class"]) for r in got) == sorted((k, ts(a), ts(z), c) for k, a, z, c in merged)
