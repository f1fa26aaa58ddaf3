import os

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.ordered import Buckets
from chronoweave.plans.chart import series_query
from chronoweave.sources import files, store
from tests.helpers import frame, ts


def day_file(folder, name, start, n=50):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("Timestamp,a,b\n" + "".join(f"{ts(start + 60 * i)},{i},{i * 2.5}\n" for i in range(n)))


def test_built_once_then_rebuilt_when_an_input_changes(spark, tmp_path):
    src, path, calls = str(tmp_path / "in"), str(tmp_path / "out"), []
    inputs = [os.path.join(src, "*.csv")]

    def builder():
        calls.append(1)
        return files.scan_union(spark, files.select_files(spark, inputs))

    day_file(src, "a.csv", 0)
    first = store.build(spark, path, builder, inputs=inputs)
    assert (first.row_count, first.ts_min, first.ts_max) == (50, ts(0), ts(60 * 49))
    assert first.resolution_us == 60_000_000 and first.densest_month_rows == 50 and first.bucket == Buckets()
    assert store.build(spark, path, builder, inputs=inputs).version == first.version and len(calls) == 1
    day_file(src, "a.csv", 0, 30)  # the same file with other content
    second = store.build(spark, path, builder, inputs=inputs)
    assert second.row_count == 30 and second.table.count() == 30 and len(calls) == 2
    day_file(src, "b.csv", 86400)
    assert store.build(spark, path, builder, inputs=inputs).table.count() == 80
    assert store.stored(spark, path).row_count == 80
    assert len([f for f in os.listdir(path) if f.startswith("data-")]) == 1  # older versions are gone
    assert store.build(spark, path, builder).row_count == 80 and len(calls) == 3  # without inputs never stale


def test_an_empty_result_is_refused_and_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    none = frame(spark, [], "Timestamp timestamp_ntz, a double")
    with pytest.raises(ValueError):
        store.build(spark, path, lambda: none)
    assert store.stored(spark, path) is None
    some = frame(spark, [(ts(1), 1.0), (None, 2.0)], "Timestamp timestamp_ntz, a double")
    built = store.build(spark, path, lambda: some)
    assert built.row_count == 2 and built.ts_min == built.ts_max == ts(1) and built.resolution_us == 10_000_000


def test_a_version_without_its_sidecar_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "out")
    df = frame(spark, [(ts(i), float(i)) for i in range(5)], "Timestamp timestamp_ntz, a double")
    df.write.parquet(f"{path}/data-unfinished")
    assert store.stored(spark, path) is None
    assert store.build(spark, path, lambda: df).row_count == 5


def test_chart_reads_bounds_and_resolution_from_the_sidecar(spark, tmp_path):
    rows = [(ts(60 * i), 999999.0 if i % 7 == 0 else float(i)) for i in range(200)]
    known = store.build(spark, str(tmp_path / "out"), lambda: frame(spark, rows, "Timestamp timestamp_ntz, a double"))
    spark.sparkContext.setJobGroup("chart", "chart")
    try:
        c = series_query(known.table, ["a"], lo=ts(0), hi=ts(6000), n=20, known=known)
        boxes = c.boxes
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("chart")  # building the request starts no job
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all("/stats-" in f for f in c.bounds.inputFiles())
    plain = series_query(known.table, ["a"], lo=ts(0), hi=ts(6000), n=20)
    for a, b in ((c.bounds, plain.bounds), (boxes, plain.boxes), (c.points, plain.points)):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_headers_of_many_files_come_from_one_scan(spark, tmp_path):
    folder = str(tmp_path / "many files")
    os.makedirs(folder)
    for i in range(600):
        cols = ["Timestamp", "a", "b"] if i % 3 else ["b", "Timestamp", "c"]
        with open(os.path.join(folder, f"f{i:04d}.csv"), "w") as f:
            f.write(",".join(cols) + "\n" + ",".join(str(ts(i)) if c == "Timestamp" else str(i) for c in cols) + "\n")
    open(os.path.join(folder, "z-empty.csv"), "w").close()
    paths = files.select_files(spark, os.path.join(folder, "*.csv"))
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        groups = files._headers(spark, paths, ",")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) <= 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {h: len(p) for h, p in groups.items()} == {("Timestamp", "a", "b"): 400, ("b", "Timestamp", "c"): 200}
    df = files.scan_union(spark, paths)
    assert df.count() == 600 and df.agg(F.sum("b")).first()[0] == sum(range(600))
