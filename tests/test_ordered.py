import random

from pyspark.sql import Window, functions as F

from chronoweave.functions.ordered import Buckets, ordered_columns, ordered_positions, time_buckets, with_bucket
from tests.helpers import frame, ts


def test_equal_to_global_window_with_empty_buckets(spark):
    rnd = random.Random(7)
    # three dense days, an empty day, then sparse rows; duplicate-free order key
    secs = sorted({rnd.randrange(0, 3 * 86400) for _ in range(400)} | {5 * 86400 + i for i in range(0, 50, 7)})
    rows = [(i, ts(s), rnd.choice(["a", "b"]), float(rnd.randrange(100))) for i, s in enumerate(secs)]
    df = frame(spark, rows, "id long, t timestamp_ntz, k string, v double")
    for keys in ([], ["k"]):
        got = ordered_columns(df, "t", order=["t", "id"], partition_by=keys,
                              lag={"p": "v"}, lead={"n": "v"}, cumsum={"c": F.lit(1).cast("bigint")},
                              cummax_before={"m": "v"})
        w = Window.partitionBy(*keys).orderBy("t", "id")
        ref = df.select("*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                        F.row_number().over(w).cast("bigint").alias("c"),
                        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_no_single_partition_window_over_rows(spark):
    df = frame(spark, [(ts(i * 3600), float(i)) for i in range(100)], "t timestamp_ntz, v double")
    got = ordered_columns(df, "t", lag={"p": "v"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the window over rows is partitioned by the time bucket
    assert "__cw_bucket" in plan


def same_as_global_window(df, bucket, keys, order):
    got = ordered_columns(df, "t", order=order, partition_by=keys, bucket=bucket, lag={"p": "t"}, lead={"n": "t"},
                          cumsum={"c": F.lit(1).cast("bigint")})
    w = Window.partitionBy(*keys).orderBy(*order)
    ref = df.select("*", F.lag("t").over(w).alias("p"), F.lead("t").over(w).alias("n"),
                    F.row_number().over(w).cast("bigint").alias("c"))
    if order == ["t"]:  # rows of one time stamp come in any order
        got, ref = got.drop("id"), ref.drop("id")
    return got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def dense_rows(spark):
    """Key "hot": 3000 rows inside one hour and a few elsewhere; "cold": 30 rows over 30 days; a null key, a null time."""
    rows = [(i, "hot", ts(i)) for i in range(3000)] + [(3000 + i, "cold", ts(i * 86400)) for i in range(30)]
    rows += [(4000 + i, "hot", ts(86400 * 40 * (i + 1))) for i in range(5)]
    rows += [(5000, None, ts(5)), (5001, None, ts(9)), (5002, "cold", None)]
    return frame(spark, rows, "id long, k string, t timestamp_ntz")


def test_only_the_dense_month_of_the_dense_key_is_refined(spark):
    df = dense_rows(spark)
    b = time_buckets(df, "t", ["k"], target_rows=500)
    widths = b.widths.collect()
    assert [(r["k"], r["__cw_width"]) for r in widths] == [("hot", 60_000_000)]
    cut, _ = with_bucket(df, "t", ["k"], b)
    per = {(r["k"], str(r["__cw_bucket"])): r["count"] for r in cut.groupBy("k", "__cw_bucket").count().collect()}
    assert max(per.values()) <= 500 and sum(k == "cold" for k, _ in per) == 2  # its month and the null time
    assert same_as_global_window(df, b, ["k"], ["t", "id"])
    assert same_as_global_window(df.drop("k"), time_buckets(df, "t", target_rows=500), [], ["t", "id"])


def test_sparse_tables_take_one_count_and_no_boundaries(spark):
    df = dense_rows(spark)
    tracker = spark.sparkContext.statusTracker()
    group = "count-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert time_buckets(df, "t", ["k"]) == Buckets(("k",))
        counting = len(tracker.getJobIdsForGroup(group))
        for known in ("month", "day", Buckets(("k",))):
            ordered_columns(df, "t", partition_by=["k"], bucket=known, lag={"p": "t"})
        assert len(tracker.getJobIdsForGroup(group)) == counting  # a given or stored bucket starts no job
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counting <= 4


def test_ties_are_split_where_their_order_is_free(spark):
    rows = [(i, "a", ts(7)) for i in range(900)] + [(1000 + i, "a", ts(i)) for i in range(20)]
    df = frame(spark, rows, "id long, k string, t timestamp_ntz")
    b = time_buckets(df, "t", ["k"], target_rows=100)
    cut, _ = with_bucket(df, "t", ["k"], b, tied=True)
    assert cut.groupBy("__cw_bucket").count().agg(F.max("count")).first()[0] < 300
    assert same_as_global_window(df, b, ["k"], ["t"])
    assert same_as_global_window(df, b, ["k"], ["t", "id"])


def test_positions_rank_only_wanted_buckets(spark):
    df = frame(spark, [(i, "a" if i % 3 else "b", ts(i * 3600)) for i in range(4000)], "id long, k string, t timestamp_ntz")
    ref = df.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("t"))).withColumn(
        "n", F.count("t").over(Window.partitionBy("k")))
    for b in ("month", time_buckets(df, "t", ["k"], target_rows=50)):
        got = ordered_positions(df, "t", order=["t"], partition_by=["k"], bucket=b, pos="p", total="n")
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0
        some = ordered_positions(df, "t", order=["t"], partition_by=["k"], bucket=b, pos="p", total="n",
                                 pick=lambda first, last, n: (last >= 100) & (first <= 120))
        kept = some.count()
        assert some.where("p between 100 and 120").count() == 42 and kept < (2000 if b == "month" else 300)


def test_fixed_width_bucket(spark):
    df = frame(spark, [(ts(i * 7),) for i in range(300)], "t timestamp_ntz")
    got = ordered_columns(df, "t", bucket="15 minutes", cumsum={"c": F.lit(1).cast("bigint")})
    assert sorted(r.c for r in got.collect()) == list(range(1, 301))


def test_fine_buckets_recursive_carry(spark):
    rnd = random.Random(11)
    secs = sorted({rnd.randrange(0, 20000) for _ in range(600)})
    rows = [(i, ts(s), rnd.choice(["a", "b"]), float(rnd.randrange(50))) for i, s in enumerate(secs)]
    df = frame(spark, rows, "id long, t timestamp_ntz, k string, v double")
    for keys in ([], ["k"]):
        got = ordered_columns(df, "t", order=["t", "id"], partition_by=keys, bucket="1 second",
                              lag={"p": "v"}, lead={"n": "v"}, cumsum={"c": F.lit(1).cast("bigint")},
                              cummax_before={"m": "v"})
        w = Window.partitionBy(*keys).orderBy("t", "id")
        ref = df.select("*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                        F.row_number().over(w).cast("bigint").alias("c"),
                        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_buckets_of_a_dense_day_grow_with_its_rows(spark):
    counts = []
    for n in (400, 4_000, 40_000):
        df = spark.range(n).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, 0, 0, id * {80_000 / n})"))
                                   .alias("t"))
        cut, _ = with_bucket(df, "t", [], time_buckets(df, "t", target_rows=500))
        b = cut.groupBy("__cw_bucket").count().agg(F.count("*"), F.max("count")).first()
        assert b[1] <= 500
        counts.append(b[0])
    assert counts[0] == 1 and counts[1] >= 8 and counts[2] >= 80


def test_a_dense_second_is_split(spark):
    df = spark.range(5000).select("id", (F.lit("2024-01-01").cast("timestamp_ntz")
                                         + F.expr("make_dt_interval(0, 0, 0, id * 0.0001)")).alias("t"))
    b = time_buckets(df, "t", target_rows=500)
    assert [r["__cw_width"] for r in b.widths.collect()] == [1000]
    got = ordered_columns(df, "t", bucket=b, lag={"p": "id"}, cumsum={"c": F.lit(1).cast("bigint")})
    assert all((r.p is None if r.id == 0 else r.p == r.id - 1) and r.c == r.id + 1 for r in got.collect())
