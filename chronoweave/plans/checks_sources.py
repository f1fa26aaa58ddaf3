"""Registered queries for sources and timestamp/numeric repair.

Files are written from the driver tables into a fresh folder under the
shared checkpoint folder, then read back by the source operators.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from chronoweave.operators import clean
from chronoweave.plans import steps
from chronoweave.plans.checks_common import ORDERS_DAILY_SQL, r6, table
from chronoweave.plans.checks_gaps import _fill_sql, _gap_ctes
from chronoweave.plans.checks_meta import DICT, dictionary_rows
from chronoweave.session import checkpoint_dir
from chronoweave.sources import files, store


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def q_scan_union(spark, d):
    o = table(spark, d, "orders")
    base = _scratch(spark, "csv")
    early = o.where("o_orderdate < '1998-01-01'").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), "o_orderkey", "o_orderstatus",
        "o_totalprice")
    late = o.where("o_orderdate >= '1998-01-01'").select(
        "o_totalprice", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"))
    early.write.csv(os.path.join(base, "199x"), header=True)
    late.write.csv(os.path.join(base, "200x"), header=True)
    paths = files.select_files(spark, [os.path.join(base, "199x", "*.csv"), os.path.join(base, "200x", "*.csv")])
    return files.scan_union(spark, paths)


def dirty_orders(spark, d):
    """orders with text time and price: low-priority dates unreadable, pending prices 'NA'."""
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("bad"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("O_ORDERDATE"),
        F.when(F.col("o_orderstatus") == "P", F.lit("NA")).otherwise(F.col("o_totalprice").cast("string"))
         .alias("o_totalprice"))


def q_drop_invalid_ts(spark, d):
    return clean.drop_invalid_ts(dirty_orders(spark, d), "O_ORDERDATE").select("o_orderkey", "O_ORDERDATE")


def q_normalize_ts(spark, d):
    return clean.normalize_ts(dirty_orders(spark, d), "o_orderdate").select("o_orderkey", "o_orderdate")


def q_numeric_coerce(spark, d):
    return clean.numeric_coerce(dirty_orders(spark, d), ["o_totalprice", "no_such"]).select("o_orderkey", "o_totalprice")


def q_materialize_table(spark, d):
    e = table(spark, d, "events").select("ts", "event_type", "value")
    back = files.materialize(e, _scratch(spark, "events-table"), "ts")
    return back.groupBy("ts_month").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")) \
        .select("ts_month", "n", r6("value_sum"))


def _yearly_files(spark, d, name):
    """One CSV per order year, named after it, as monthly exports are."""
    base = _scratch(spark, name)
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
                                         "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    o.repartition("year").write.partitionBy("year").csv(os.path.join(base, "parts"), header=True)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(path(os.path.join(base, "parts", "year=*"))):
        year = folder.getPath().getName().split("=")[1]
        for i, part in enumerate(fs.globStatus(path(folder.getPath().toString() + "/part-*.csv"))):
            fs.rename(part.getPath(), path(os.path.join(base, f"orders_{year}_{i}.csv")))
    return base


def q_select_files(spark, d):
    """Files by pattern, without the years 1995 (a list of globs), then one year by filter."""
    base = _yearly_files(spark, d, "by-year")
    some = files.select_files(spark, [os.path.join(base, "orders_199[^5]*.csv"), os.path.join(base, "orders_20*.csv")])
    one = files.select_files(spark, os.path.join(base, "*.csv"), year_filter="1995", max_files=100)
    df = files.scan_union(spark, some + one, with_file=True)
    return df.select("Timestamp", "o_orderkey", r6("o_totalprice"), F.col("_source_file").substr(1, 11).alias("file"))


def q_raw_load(spark, d):
    """Cleaning switched off: all files as they are, unreadable times NULL."""
    base = _scratch(spark, "raw")
    dirty_orders(spark, d).withColumnRenamed("O_ORDERDATE", "Timestamp").write.csv(base, header=True)
    raw = files.raw_load(spark, files.select_files(spark, os.path.join(base, "*.csv")))
    out, _ = steps.run_steps(raw, {"run_enabled": False})
    return out.select("o_orderkey", "Timestamp", "o_totalprice")


def q_first_csv(spark, d):
    """The first CSV of a folder with one for each year; its first column holds times only, so it becomes a time column."""
    df, _ = files.read_first_csv(spark, _yearly_files(spark, d, "first"))
    return df.select("Timestamp", "o_orderkey")


def _dictionary_file(spark, d):
    """The event dictionary as one JSON object, keys in order of (code, key)."""
    base = _scratch(spark, "dictionary")
    pairs = F.array_sort(F.collect_list(F.struct("code", "key")))
    rows = dictionary_rows(spark, d).agg(F.to_json(F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(p["key"], p["code"])))).alias("value"))
    rows.write.text(base)
    return base


def q_event_dictionary(spark, d):
    return files.read_event_dictionary(spark, _dictionary_file(spark, d))


def q_event_groups_file(spark, d):
    """Grouped dictionary built from the dictionary file because it is absent, then read from its file."""
    path = _scratch(spark, "groups")
    source = _dictionary_file(spark, d)
    files.ensure_event_groups(spark, source, path)
    g = files.ensure_event_groups(spark, source, path)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return g.select("component", "name", *[text(c) for c in ("raw_columns", "raw_encoded", "from_to_columns", "from_to_encoded")])


FREQUENCY = "MG-LV-MSB_Frequency"
RUN_CONFIG = {
    "run_enabled": True,
    "available_functions": {name: {"enabled": name != "load_and_process_data"} for name in steps.STEP_ORDER},
}


def q_clean_pipeline(spark, d):
    """The whole cleaning run from CSV files, every step acting: unreadable times are dropped, a day's orders
    averaged, the fault value of every fifth day removed, missing days filled, the time column renamed."""
    base = _scratch(spark, "run")
    day = F.dayofmonth("o_orderdate")
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("bad"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("TIMESTAMP"), "o_totalprice",
        F.when(day % 5 == 0, F.lit(clean.DEFAULT_FAULT_SENTINELS[0])).otherwise(F.col("o_totalprice") - 7).alias(FREQUENCY))
    o.write.csv(base, header=True)
    raw = files.scan_union(spark, files.select_files(spark, os.path.join(base, "*.csv")), ts="TIMESTAMP")
    out, _ = steps.run_steps(raw, RUN_CONFIG, ts="TIMESTAMP")
    return clean.normalize_ts(out, "Timestamp").select("Timestamp", r6("o_totalprice"),
                                                       F.round(F.col(f"`{FREQUENCY}`"), 6).alias("frequency"))


def _daily_files(spark, base, orders, name):
    """A folder of CSV files with the day's mean order price."""
    days = orders.groupBy("o_orderdate").agg(F.avg("o_totalprice").alias("o_totalprice"))
    days.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), "o_totalprice").write.csv(
        os.path.join(base, name), header=True)


def _stored_orders(spark, d):
    """A stored dataset of CSV files that is built, found unchanged, and built anew after files were added."""
    base = _scratch(spark, "input")
    path, inputs, o, ran = _scratch(spark, "stored"), [os.path.join(base, "*", "*.csv")], table(spark, d, "orders"), []

    def builder():
        ran.append(1)
        return files.scan_union(spark, files.select_files(spark, inputs))

    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    _daily_files(spark, base, o.where(early), "early")
    first = store.build(spark, path, builder, inputs=inputs)
    if store.build(spark, path, builder, inputs=inputs).version != first.version:
        raise RuntimeError("an unchanged input was built again")
    _daily_files(spark, base, o.where(~early), "late")
    last = store.build(spark, path, builder, inputs=inputs)
    if len(ran) != 2:
        raise RuntimeError(f"the builder ran {len(ran)} times")
    return last


def q_stored_dataset(spark, d):
    return _stored_orders(spark, d).table.select("ts_month", "Timestamp", r6("o_totalprice"))


def q_stored_stats(spark, d):
    return _stored_orders(spark, d).stats.select("row_count", "ts_min", "ts_max", "resolution_us", "densest_month_rows")


def q_load_or_build(spark, d):
    """The catalog table, built at the first call and read at the second; the first two files by name only (O3)."""
    base = _yearly_files(spark, d, "first-files")
    name = f"cw_built_{uuid.uuid4().hex}"

    def builder():
        return files.scan_union(spark, files.select_files(spark, os.path.join(base, "*.csv"), max_files=2))

    files.load_or_build(spark, name, builder)
    return files.load_or_build(spark, name, lambda: None).select("Timestamp", "o_orderkey", r6("o_totalprice"))


def q_file_metrics(spark, d):
    """Counters of a selection of yearly files of which the first three of the nineties are taken."""
    base = _yearly_files(spark, d, "counted")
    return files.file_metrics(spark, os.path.join(base, "*.csv"), max_files=3, year_filter="_199").select(
        "step", F.regexp_replace("metric", "_[0-9]+[.]csv$", "").alias("metric"), "value")


QUERIES = {
    "file_metrics": q_file_metrics,
    "stored_dataset": q_stored_dataset,
    "stored_stats": q_stored_stats,
    "load_or_build": q_load_or_build,
    "select_files": q_select_files,
    "raw_load": q_raw_load,
    "first_csv": q_first_csv,
    "event_dictionary": q_event_dictionary,
    "event_groups_file": q_event_groups_file,
    "clean_pipeline": q_clean_pipeline,
    "scan_union": q_scan_union,
    "drop_invalid_ts": q_drop_invalid_ts,
    "normalize_ts": q_normalize_ts,
    "numeric_coerce": q_numeric_coerce,
    "materialize_table": q_materialize_table,
}

_RUN_SQL = """SELECT "Timestamp", o_totalprice, CASE WHEN abs(f + 327.679993) <= 1e-6 THEN NULL ELSE f END AS frequency FROM (
    SELECT o_orderdate AS "Timestamp", avg(o_totalprice) AS o_totalprice,
           avg(CASE WHEN day(o_orderdate) % 5 = 0 THEN CAST(-327.679993 AS DOUBLE) ELSE o_totalprice - 7 END) AS f
    FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)"""

ORACLE = {
    "file_metrics": """WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1),
        few AS (SELECT * FROM y WHERE y BETWEEN 1990 AND 1999 ORDER BY y LIMIT 3)
        SELECT 'select' AS step, 'files_found' AS metric, CAST((SELECT count(*) FROM y) AS DOUBLE) AS value
        UNION ALL SELECT 'select', 'files_selected', CAST((SELECT count(*) FROM few) AS DOUBLE)
        UNION ALL SELECT 'select', 'rows:orders_' || CAST(y AS VARCHAR), CAST(n AS DOUBLE) FROM few
        UNION ALL SELECT 'select', 'columns:orders_' || CAST(y AS VARCHAR), CAST(3 AS DOUBLE) FROM few""",
    "stored_dataset": """SELECT strftime(o_orderdate, '%Y-%m') AS ts_month, o_orderdate AS "Timestamp",
        round(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY o_orderdate""",
    "stored_stats": f"""WITH {_gap_ctes(ORDERS_DAILY_SQL, 'o_orderdate', [])}
        SELECT (SELECT count(*) FROM s) AS row_count, (SELECT min(o_orderdate) FROM s) AS ts_min,
               (SELECT max(o_orderdate) FROM s) AS ts_max, (SELECT res_us FROM r) AS resolution_us,
               (SELECT max(n) FROM (SELECT count(*) AS n FROM s GROUP BY strftime(o_orderdate, '%Y-%m'))) AS densest_month_rows""",
    "load_or_build": """SELECT o_orderdate AS "Timestamp", o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders
        WHERE year(o_orderdate) IN (SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY y LIMIT 2)""",
    "select_files": """SELECT o_orderdate AS "Timestamp", o_orderkey, round(o_totalprice, 6) AS o_totalprice,
        'orders_' || CAST(year(o_orderdate) AS VARCHAR) AS file FROM orders""",
    "raw_load": """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS "Timestamp",
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders""",
    "first_csv": """SELECT o_orderdate AS "Timestamp", o_orderkey FROM orders
        WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders)""",
    "event_dictionary": f"WITH {DICT} SELECT row_number() OVER (ORDER BY code, key) - 1 AS ord, key, code FROM k",
    "event_groups_file": f"""WITH {DICT} SELECT component, component AS name, raw_columns, raw_encoded,
        from_to_columns, from_to_encoded FROM grp""",
    "clean_pipeline": _fill_sql(_RUN_SQL, '"Timestamp"', [], ["o_totalprice", "frequency"]),
    "scan_union": """SELECT o_orderdate AS "Timestamp", o_orderkey,
        CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""",
    "drop_invalid_ts": """SELECT o_orderkey, o_orderdate AS "O_ORDERDATE" FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "normalize_ts": """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS o_orderdate
        FROM orders""",
    "numeric_coerce": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice
        FROM orders""",
    "materialize_table": """SELECT strftime(ts, '%Y-%m') AS ts_month, count(*) AS n, round(sum(value), 6) AS value_sum
        FROM events GROUP BY 1""",
}
