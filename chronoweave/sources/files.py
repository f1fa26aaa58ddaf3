"""File sources and sinks: CSV selection and header-aware union, raw load,
first-column-time CSV, build-once materialisation, event dictionary JSON.

S2 select_files, S3 scan_union, S4 raw_load, S5 read_first_csv,
S6 materialize / load_or_build, S8 sample_and_columns, S9 read_event_dictionary,
S10 write_event_groups, S11 cache_dataset.
"""

from __future__ import annotations

import csv
import os
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chronoweave.operators.clean import parse_ts, q, to_double
from chronoweave.operators.series import SAMPLE_ROWS

# The text tokens pandas' CSV reader treats as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything, on whichever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def select_files(spark: SparkSession, pattern, max_files: int | None = None,
                 year_filter: str | None = None) -> list[str]:
    """Files for a glob or a list of paths/globs, sorted by name.

    Keeps base names containing ``year_filter``; the first ``max_files`` of
    the name-sorted list (deterministic, unlike plain glob order).  The list
    is file metadata, listed by Spark (works for any Hadoop file system).
    """
    pats = [pattern] if isinstance(pattern, str) else list(pattern)
    listed = (spark.read.format("binaryFile").load(pats).select("path")
              .withColumn("name", F.element_at(F.split("path", "/"), -1)))
    if year_filter:
        listed = listed.where(F.col("name").contains(year_filter))
    paths = [r.path for r in listed.orderBy("name", "path").collect()]
    if not paths:
        raise FileNotFoundError(f"no file matches {pattern!r}")
    return paths[:max_files] if max_files else paths


def _headers(spark: SparkSession, paths: list[str], sep: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each header, in the given order, from one scan that keeps the first line of every file.

    A file's first line lies in the split that starts at byte 0 and has the
    lowest row id there.  A file without any line has no header and no rows.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"),
                                          F.col("_metadata.file_block_start").alias("start"),
                                          F.monotonically_increasing_id().alias("i")).where("start = 0")
    firsts = lines.groupBy("path").agg(F.min_by("value", "i").alias("line"))
    line = {_plain(unquote(r.path)): r.line for r in firsts.collect()}
    out: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        if _plain(p) in line:
            out.setdefault(tuple(c.strip() for c in next(csv.reader([line[_plain(p)]], delimiter=sep))), []).append(p)
    return out


def _plain(path: str) -> str:
    """A path in one spelling, whichever slashes and scheme a local file is named with."""
    head, sep, rest = path.partition(":/")
    return head + ":/" + rest.lstrip("/") if sep and "/" not in head else "file:/" + path.lstrip("/")


def scan_union(spark: SparkSession, paths: list[str], ts: str = "Timestamp", sep: str = ",",
               ts_format: str | None = None, infer: bool = True, with_file: bool = False) -> DataFrame:
    """Read CSV files whose headers differ, binding columns BY NAME.

    Files are grouped by header; each group is read with an all-string
    schema taken from its header, then the groups are unioned by name
    (missing columns NULL).  pandas' missing tokens become NULL.  ``ts`` is
    parsed to ``timestamp_ntz`` (failures NULL, rows kept); with ``infer``
    each other column becomes bigint or double when every non-missing value
    is such a number, boolean when every row holds true or false (any case),
    else stays text.  Types come from one aggregate pass over all rows.
    """
    groups = _headers(spark, paths, sep)
    if not groups:
        raise ValueError("the files hold no header line")
    frames = []
    for header, files in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        f = spark.read.csv(files, header=True, schema=schema, sep=sep, enforceSchema=True)
        if with_file:
            f = f.withColumn("_source_file", F.col("_metadata.file_name"))
        frames.append(f)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    df = df.withColumns({c: F.when(q(c).isin(*NA_TOKENS), F.lit(None)).otherwise(q(c))
                         for c in df.columns if c != "_source_file"})
    others = [c for c in df.columns if c not in (ts, "_source_file")]
    if infer and others:
        stats = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(others)],
                       *[F.count(q(c).try_cast("bigint")).alias(f"i{i}") for i, c in enumerate(others)],
                       *[F.count(to_double(q(c))).alias(f"d{i}") for i, c in enumerate(others)],
                       *[F.count_if(F.lower(q(c)).isin("true", "false")).alias(f"b{i}")
                         for i, c in enumerate(others)]).first()
        casts = {}
        for i, c in enumerate(others):
            n, ni, nd = stats[f"n{i}"], stats[f"i{i}"], stats[f"d{i}"]
            if n and ni == n:
                casts[c] = q(c).try_cast("bigint")
            elif n and stats[f"b{i}"] == stats["rows"]:
                casts[c] = q(c).cast("boolean")
            elif nd == n:
                v = to_double(q(c))
                casts[c] = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        df = df.withColumns(casts) if casts else df
    if ts in df.columns:
        df = df.withColumn(ts, parse_ts(q(ts), T.StringType(), ts_format))
    return df


def file_metrics(spark: SparkSession, pattern, max_files: int | None = None, year_filter: str | None = None,
                 sep: str = ",") -> DataFrame:
    """A10: (step, metric, value) of a file selection: files found and selected, rows and columns of each selected file.

    Headers come from one scan (``scan_union`` reads the same), rows from one
    scan for each header that decodes no column; one row a file is collected, as for the list itself.  A file without a byte
    is not listed by Spark and so not found.
    """
    found = select_files(spark, pattern)
    chosen = select_files(spark, pattern, max_files, year_filter) if max_files or year_filter else found
    name = lambda path: path.rsplit("/", 1)[-1]
    groups = _headers(spark, chosen, sep)
    wide = {_plain(p): len(header) for header, paths in groups.items() for p in paths}
    counts = [spark.read.csv(paths, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in header]), sep=sep)
              .groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
              for header, paths in groups.items()]
    rows = {_plain(unquote(r.path)): r.rows for r in (reduce(DataFrame.unionByName, counts).collect() if counts else [])}
    out = [("files_found", len(found)), ("files_selected", len(chosen))]
    for p in chosen:
        out += [(f"rows:{name(p)}", rows.get(_plain(p), 0)), (f"columns:{name(p)}", wide.get(_plain(p), 0))]
    return spark.createDataFrame([("select", m, float(v)) for m, v in out], "step string, metric string, value double")


def raw_load(spark: SparkSession, paths: list[str], ts: str = "Timestamp", **kw) -> DataFrame:
    """Cleaning disabled -> files concatenated, time parsed, nothing else."""
    return scan_union(spark, paths, ts, **kw)


def read_first_csv(spark: SparkSession, folder: str, sep: str = ",") -> tuple[DataFrame | None, str | None]:
    """First CSV of a folder (name order); column 0 becomes a time column
    only when every non-missing value parses.  Returns (df, file name) or (None, None)."""
    pattern = os.path.join(folder, "*.csv")
    if not path_exists(spark, pattern):
        return None, None
    paths = select_files(spark, pattern)
    df = scan_union(spark, paths[:1], ts="__none__", sep=sep)
    first = df.columns[0]
    parsed = parse_ts(q(first), T.StringType())
    src = q(first).cast("string")
    ok = df.agg((F.count(src) == F.count(parsed)).alias("ok")).first().ok
    if ok:
        df = df.withColumn(first, parsed)
    return df, os.path.basename(paths[0])


def _month(ts: str):
    return F.date_format(q(ts), "yyyy-MM").alias("ts_month")


def materialize(df: DataFrame, path: str, ts: str = "Timestamp", files_per_range: int | None = None) -> DataFrame:
    """S6 write: range-partition by time, sort inside tasks, write parquet
    partitioned by month; returns the table read back.

    Range partitioning (not hash by month) keeps a hot month from landing
    in one task; each task writes the months of its time range, sorted.
    """
    spark = df.sparkSession
    n = files_per_range or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.withColumn("ts_month", _month(ts)).repartitionByRange(n, q(ts)).sortWithinPartitions(q(ts))
    out.write.mode("overwrite").partitionBy("ts_month").parquet(path)
    return spark.read.parquet(path)


def load_or_build(spark: SparkSession, table_name: str, build, ts: str = "Timestamp") -> DataFrame:
    """Read the catalog table if it exists; else build it, refuse an empty
    result, and save it (parquet, month partitions, time-sorted files)."""
    if spark.catalog.tableExists(table_name):
        return spark.table(table_name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (build().withColumn("ts_month", _month(ts)).repartitionByRange(n, q(ts)).sortWithinPartitions(q(ts))
       .write.mode("errorifexists").format("parquet").partitionBy("ts_month").saveAsTable(table_name))
    if spark.table(table_name).isEmpty():  # the builder's plan ran once, in the write
        spark.sql(f"DROP TABLE {table_name}")
        raise ValueError(f"building {table_name!r} gave no rows")
    return spark.table(table_name)


def sample_and_columns(df: DataFrame, ts: str = "Timestamp", n: int = SAMPLE_ROWS) -> tuple[DataFrame, list[str]]:
    """First ``n`` rows in time order and the measurement column names."""
    return df.orderBy(q(ts)).limit(n), [c for c in df.columns if c not in (ts, "ts_month")]


def read_event_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """JSON object {key: code} -> (ord, key, code) in file order."""
    txt = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,bigint>")
    return (txt.select(F.posexplode(F.map_entries(m)).alias("ord", "e"))
            .select(F.col("ord").cast("bigint").alias("ord"), F.col("e.key").alias("key"),
                    F.col("e.value").alias("code")))


def write_event_groups(groups: DataFrame, path: str) -> None:
    """Grouped dictionary as JSON lines, one component per line, sorted."""
    groups.orderBy("component").write.mode("overwrite").json(path)


def ensure_event_groups(spark: SparkSession, dictionary_path: str, groups_path: str,
                        mode: str = "compact") -> DataFrame:
    """The grouped dictionary of an event dataset, built from its
    dictionary (required) and written only when it does not exist yet."""
    from chronoweave.operators.events import event_groups

    if path_exists(spark, groups_path):
        return spark.read.json(groups_path)  # there but unreadable is an error, never a reason to overwrite
    if not dictionary_path:
        raise ValueError("an event-encoded dataset needs its dictionary to build the grouped catalogue")
    write_event_groups(event_groups(read_event_dictionary(spark, dictionary_path), mode), groups_path)
    return spark.read.json(groups_path)


def cache_dataset(spark: SparkSession, table_name: str) -> DataFrame:
    """Keep a materialised table in executor memory for repeated chart queries."""
    spark.catalog.cacheTable(table_name)
    return spark.table(table_name)
