"""Registered queries for the chart side: quality views, runs, intervals, series ops."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.operators import gaps, quality, series
from chronoweave.plans.checks_common import EVENTS_MINUTE_SQL, events_minute, r6, table
from chronoweave.plans.checks_gaps import _gap_ctes
from chronoweave.session import cut_lineage, table_path
from chronoweave.sources import store

EV = ["event_type"]


def events_filled(spark, d):
    """events 1-minute means, values > 200 marked as anomalies, gaps filled."""
    em = events_minute(spark, d)
    em = em.withColumn("value", F.when(F.col("value") > 200, F.lit(quality.ANOMALY_VALUE))
                       .otherwise(F.col("value")))
    filled, _ = gaps.gap_fill(em, "ts", EV)
    # the cleaned series is materialised once, as a stored table is read by chart queries
    return cut_lineage(filled, "events-filled")


MARKED_SQL = (f"SELECT event_type, ts, CASE WHEN value > 200 THEN -999999.0 ELSE value END AS value "
              f"FROM ({EVENTS_MINUTE_SQL})")


def interval_ctes(src_sql: str, ts: str, keys: list[str], values: list[str] | str, clip: str = "true") -> str:
    """CTEs (runs and extrema of the rows that meet ``clip``) over a source series: f (filled), fr (resolution with fallback),
    bad (runs), merged (intervals), ext (overall extrema); keyed or single-axis."""
    kc = "".join(f"{k}, " for k in keys)
    pk = f"PARTITION BY {', '.join(keys)} " if keys else ""

    def part(*extra):
        cols = keys + list(extra)
        return f"PARTITION BY {', '.join(cols)} " if cols else ""

    values = [values] if isinstance(values, str) else list(values)
    vlist = ", ".join(values)
    order = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    fills = ", ".join("999999.0" for _ in values)
    hits = " UNION ALL ".join(
        f"""SELECT {''.join(f'f.{k}, ' for k in keys)}'{v}' AS series, {ts},
        CASE WHEN {v} = 999999.0 THEN 'red' ELSE 'orange' END AS class,
        res_us, res_us / 1e6 + 0.5 AS thr FROM f JOIN fr {{using}} WHERE {v} IN (999999.0, -999999.0) AND {clip}""" for v in values)
    valid = lambda agg, v: f"{agg}(CASE WHEN {v} BETWEEN -999998.0 AND 999998.0 THEN {v} END)"
    y_min = valid("min", values[0]) if len(values) == 1 else "least(" + ", ".join(valid("min", v) for v in values) + ")"
    y_max = valid("max", values[0]) if len(values) == 1 else "greatest(" + ", ".join(valid("max", v) for v in values) + ")"
    using = f"USING ({', '.join(keys)})" if keys else "ON true"
    hits = hits.replace("{using}", using)
    grp = ", ".join(keys) if keys else "()"
    kdist = f"(SELECT DISTINCT {', '.join(keys)} FROM f)" if keys else "(SELECT 1 AS one)"
    return f"""{_gap_ctes(src_sql, ts, keys)},
ins AS (SELECT {kc}prev_ts + to_microseconds(j * res_us) AS {ts} FROM
         (SELECT *, unnest(generate_series(1, missing_samples)) AS j FROM rep WHERE missing_samples > 0)),
f AS (SELECT {kc}{ts}, {vlist} FROM s UNION ALL SELECT {kc}{ts}, {fills} FROM ins),
fst AS (SELECT {kc}epoch_us({ts}) - epoch_us(lag({ts}) OVER ({pk}ORDER BY {ts})) AS su FROM f),
fc AS (SELECT {kc}su, count(*) AS n FROM fst WHERE su IS NOT NULL GROUP BY ALL),
fr AS (SELECT k.*, coalesce(m.su, 10000000) AS res_us FROM {kdist} k LEFT JOIN
        (SELECT {kc}su FROM (SELECT *, row_number() OVER ({pk}ORDER BY n DESC, su) AS rn FROM fc)
         WHERE rn = 1) m {using}),
h AS ({hits}),
hs AS (SELECT *, CASE WHEN prev IS NULL OR (epoch_us({ts}) - epoch_us(prev)) / 1e6 > thr THEN 1 ELSE 0 END AS st
        FROM (SELECT *, lag({ts}) OVER ({part('series', 'class')}ORDER BY {ts}) AS prev FROM h)),
hr AS (SELECT *, sum(st) OVER ({part('series', 'class')}ORDER BY {ts} ROWS UNBOUNDED PRECEDING) AS rid FROM hs),
bad AS (SELECT {kc}series, min({ts}) - to_microseconds(res_us // 2) AS start,
        max({ts}) + to_microseconds(res_us // 2) AS "end", class FROM hr GROUP BY {kc}series, class, rid, res_us),
mo AS (SELECT *, row_number() OVER ({pk}ORDER BY start, list_position({order}, series),
        CASE class WHEN 'red' THEN 1 ELSE 2 END, "end") AS o FROM bad),
mb AS (SELECT *, CASE WHEN lag(class) OVER w IS NULL OR lag(class) OVER w <> class THEN 1 ELSE 0 END AS chg
        FROM mo WINDOW w AS ({pk}ORDER BY o)),
mc AS (SELECT *, sum(chg) OVER ({pk}ORDER BY o ROWS UNBOUNDED PRECEDING) AS run FROM mb),
md AS (SELECT *, max("end") OVER ({part('run')}ORDER BY o
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM mc),
me AS (SELECT *, sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END)
        OVER ({pk}ORDER BY o ROWS UNBOUNDED PRECEDING) AS g FROM md),
merged AS (SELECT {kc}min(start) AS start, max("end") AS "end", min(class) AS class FROM me GROUP BY {kc}g),
ext AS (SELECT {kc}{y_min} AS y_min, {y_max} AS y_max FROM f WHERE {clip} GROUP BY {grp})"""


def filled_ctes() -> str:
    """CTEs ending in f(event_type, ts, value): the filled marked series."""
    return interval_ctes(MARKED_SQL, "ts", EV, "value")


MARKED_AXIS_SQL = ("SELECT o_orderdate, CASE WHEN o_totalprice > 250000 THEN -999999.0 ELSE o_totalprice END "
                   "AS o_totalprice, CASE WHEN o_count > 9 THEN -999999.0 ELSE o_count END AS o_count FROM "
                   "(SELECT o_orderdate, avg(o_totalprice) AS o_totalprice, CAST(count(*) AS DOUBLE) AS o_count "
                   "FROM orders GROUP BY 1)")
AXIS_SERIES = ["o_totalprice", "o_count"]


def orders_filled(spark, d):
    """Single axis, two series: daily mean order price (days above 250000 marked as
    anomalies) and daily order count (above 9 marked), gaps filled."""
    o = (table(spark, d, "orders").groupBy("o_orderdate")
         .agg(F.avg("o_totalprice").alias("o_totalprice"), F.count(F.lit(1)).cast("double").alias("o_count")))
    o = o.select("o_orderdate",
                 F.when(F.col("o_totalprice") > 250000, F.lit(quality.ANOMALY_VALUE))
                 .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                 F.when(F.col("o_count") > 9, F.lit(quality.ANOMALY_VALUE)).otherwise(F.col("o_count")).alias("o_count"))
    filled, _ = gaps.gap_fill(o, "o_orderdate")
    return cut_lineage(filled, "orders-filled")


def q_bad_runs_axis(spark, d):
    return quality.bad_runs(orders_filled(spark, d), "o_orderdate", AXIS_SERIES)


def q_merge_intervals_axis(spark, d):
    return quality.bad_intervals(orders_filled(spark, d), "o_orderdate", AXIS_SERIES)


def q_interval_boxes_axis(spark, d):
    f = orders_filled(spark, d)
    merged = quality.bad_intervals(f, "o_orderdate", AXIS_SERIES)
    ext = quality.overall_extrema(f, AXIS_SERIES)
    return quality.interval_boxes(merged, ext).select("start", "end", "class", r6("y_low"), r6("y_high"))


def q_marker_points_axis(spark, d):
    f = orders_filled(spark, d)
    return quality.marker_points(f, "o_orderdate", AXIS_SERIES).select(
        "series", "o_orderdate", "class", r6("y"))


def q_valid_values(spark, d):
    f = events_filled(spark, d)
    return quality.valid_values(f).select("event_type", "ts", r6("value"))


def q_sentinel_classes(spark, d):
    f = events_filled(spark, d)
    return quality.sentinel_classes(f).select("event_type", "ts", r6("value"), "class")


def q_series_extrema(spark, d):
    f = events_filled(spark, d)
    return quality.series_extrema(f, ["value", "missing"], EV).select("event_type", "series", r6("min"), r6("max"))


def q_marker_points(spark, d):
    f = events_filled(spark, d)
    return quality.marker_points(f, "ts", ["value"], EV).select("event_type", "series", "ts", "class", r6("y"))


def q_bad_runs(spark, d):
    return quality.bad_runs(events_filled(spark, d), "ts", ["value"], EV)


def q_merge_intervals(spark, d):
    return quality.bad_intervals(events_filled(spark, d), "ts", ["value"], EV)


def q_interval_boxes(spark, d):
    f = events_filled(spark, d)
    merged = quality.bad_intervals(f, "ts", ["value"], EV)
    ext = quality.overall_extrema(f, ["value"], EV)
    return quality.interval_boxes(merged, ext, EV).select("event_type", "start", "end", "class",
                                                           r6("y_low"), r6("y_high"))


def q_symmetric_range(spark, d):
    """Symmetric y-range of the selected series over the visible positional window."""
    e = table(spark, d, "events").select("event_id", "ts", "value", "user_id")
    w = series.positional_window(e, "ts", 100, order=["ts", "event_id"])
    return quality.symmetric_range(w, ["value", "user_id"])


def q_profile(spark, d):
    li = table(spark, d, "lineitem")
    p = quality.profile(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.select("column", "count", *[r6(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def q_table_info(spark, d):
    return quality.table_info(table(spark, d, "lineitem"))


def q_series_projection(spark, d):
    e = table(spark, d, "events")
    return series.series_projection(e, "ts", ["value", "no_such_col", "web::raw::user_id", "value"])


def q_selector_decode(spark, d):
    p = table(spark, d, "part")
    codes = p.select("p_partkey", F.explode(F.array(
        F.concat("p_brand", F.lit("::raw::"), "p_name"), F.col("p_name"),
        F.concat("p_brand", F.lit("::"), "p_name"))).alias("code"))
    return codes.select("p_partkey", "code", series.selector_decode(F.col("code")).alias("s")).select(
        "p_partkey", "code", "s.component", "s.mode", "s.column")


def q_time_range_clip(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    return series.time_range_clip(e, "ts", "2024-01-05", "2024-01-10")


def q_time_bounds(spark, d):
    return series.time_bounds(table(spark, d, "lineitem"), "l_shipdate")


def q_sorted_series(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return series.sorted_series(li, "l_shipdate", ["l_orderkey", "l_linenumber"])


def q_sample_head(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return series.sample_head(li, "l_shipdate", tie=["l_orderkey", "l_linenumber"])


def q_ts_label(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", series.ts_label(F.col("ts")).alias("label"))


def q_positional_window(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return series.positional_window(e, "ts", 100, order=["ts", "event_id"])


def q_minmax_downsample(spark, d):
    """Quantities per return flag and ship date: many rows are equal in all three, and each counts."""
    e = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("event_type"), F.col("l_shipdate").alias("ts"),
                                           F.col("l_quantity").alias("value"))
    return series.minmax_downsample(e, "ts", "value", 100, EV)


def q_lttb_downsample(spark, d):
    e = table(spark, d, "events").select("event_type", "ts", "value")
    return series.lttb_downsample(e, "ts", "value", 100, EV)


def lineitem_daily(spark, d):
    """Wide single-axis table: lineitem measures averaged per ship date."""
    from chronoweave.operators import clean
    li = table(spark, d, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    u = clean.unify_duplicates(li, "l_shipdate")
    return u.select("l_shipdate", *[r6(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])


def q_chart_points(spark, d):
    from chronoweave.plans.chart import series_query
    c = series_query(lineitem_daily(spark, d), ["l_quantity", "part::raw::l_tax", "no_such"], "l_shipdate",
                     "1995-01-01", "1996-12-31", n=100)
    return c.points


CHART_LO, CHART_HI = "1993-06-15", "1996-03-31"


def _chart(spark, d):
    from chronoweave.plans.chart import series_query
    return series_query(orders_filled(spark, d), [*AXIS_SERIES, "no_such"], "o_orderdate", CHART_LO, CHART_HI, n=100)


def q_chart_boxes(spark, d):
    return _chart(spark, d).boxes.select("start", "end", "class", r6("y_low"), r6("y_high"))


def _stored_chart(spark, d):
    """The same request on a stored dataset, whose sidecar knows bounds, resolution and densest month."""
    from chronoweave.plans.chart import series_query
    known = store.build(spark, table_path(spark, f"chart-{uuid.uuid4().hex}"), lambda: orders_filled(spark, d), ts="o_orderdate")
    return series_query(known.table, [*AXIS_SERIES, "no_such"], "o_orderdate", CHART_LO, CHART_HI, n=100, known=known)


def q_chart_bounds(spark, d):
    return _stored_chart(spark, d).bounds


def q_stored_chart_boxes(spark, d):
    return _stored_chart(spark, d).boxes.select("start", "end", "class", r6("y_low"), r6("y_high"))


QUERIES = {
    "chart_extrema": lambda s, d: _chart(s, d).extrema.select("series", r6("min"), r6("max")),
    "chart_overall": lambda s, d: _chart(s, d).overall.select(r6("y_min"), r6("y_max"), r6("marker_level")),
    "chart_markers": lambda s, d: _chart(s, d).markers.select("series", "o_orderdate", "class", r6("y")),
    "chart_boxes": q_chart_boxes,
    "chart_bounds": q_chart_bounds,
    "stored_chart_boxes": q_stored_chart_boxes,
    "bad_runs_axis": q_bad_runs_axis,
    "merge_intervals_axis": q_merge_intervals_axis,
    "interval_boxes_axis": q_interval_boxes_axis,
    "marker_points_axis": q_marker_points_axis,
    "chart_points": q_chart_points,
    "valid_values": q_valid_values,
    "sentinel_classes": q_sentinel_classes,
    "series_extrema": q_series_extrema,
    "marker_points": q_marker_points,
    "bad_runs": q_bad_runs,
    "merge_intervals": q_merge_intervals,
    "interval_boxes": q_interval_boxes,
    "symmetric_range": q_symmetric_range,
    "profile": q_profile,
    "table_info": q_table_info,
    "series_projection": q_series_projection,
    "selector_decode": q_selector_decode,
    "time_range_clip": q_time_range_clip,
    "time_bounds": q_time_bounds,
    "sorted_series": q_sorted_series,
    "sample_head": q_sample_head,
    "ts_label": q_ts_label,
    "positional_window": q_positional_window,
    "minmax_downsample": q_minmax_downsample,
    "lttb_downsample": q_lttb_downsample,
}


def _minmax_ctes(src: str, key: str, ts: str, n: int) -> str:
    """CTEs r (numbered valid rows) and picked (min and max row of each bucket, equal rows kept apart)."""
    return f"""v AS (SELECT {key}, {ts}, value FROM {src} WHERE value BETWEEN -999998.0 AND 999998.0),
        r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ts}, value) AS rn, count(*) OVER (PARTITION BY {key}) AS cnt FROM v),
        b AS (SELECT *, CASE WHEN cnt <= {n} THEN rn ELSE ((rn - 1) * {n // 2}) // cnt END AS bk FROM r),
        ends AS (SELECT {key}, arg_min(rn, (value, rn)) AS lo, arg_min(rn, (-value, rn)) AS hi FROM b GROUP BY {key}, bk),
        picked AS (SELECT r.* FROM r JOIN (SELECT {key}, lo AS rn FROM ends UNION SELECT {key}, hi FROM ends) USING ({key}, rn))"""


_F = f"WITH {filled_ctes()}\n"
_A = f"WITH {interval_ctes(MARKED_AXIS_SQL, 'o_orderdate', [], AXIS_SERIES)}\n"
_CLIP = f"o_orderdate BETWEEN TIMESTAMP '{CHART_LO}' AND TIMESTAMP '{CHART_HI}'"
_C = f"WITH {interval_ctes(MARKED_AXIS_SQL, 'o_orderdate', [], AXIS_SERIES, _CLIP)}\n"
_PROFILE_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

ORACLE = {
    "chart_extrema": _C + " UNION ALL ".join(
        f"""SELECT '{c}' AS series, round(min({c}), 6) AS "min", round(max({c}), 6) AS "max" FROM f
        WHERE {_CLIP} AND {c} BETWEEN -999998.0 AND 999998.0 HAVING count(*) > 0""" for c in AXIS_SERIES),
    "chart_overall": _C + "SELECT round(y_min, 6) AS y_min, round(y_max, 6) AS y_max, round(coalesce(y_min, 0.0), 6) AS marker_level FROM ext",
    "chart_markers": _C + "SELECT series, o_orderdate, class, round(coalesce(y_min, 0.0), 6) AS y FROM h CROSS JOIN ext",
    "chart_boxes": _C + """SELECT start, "end", class, round(y_min, 6) AS y_low, round(y_max, 6) AS y_high FROM merged CROSS JOIN ext""",
    "stored_chart_boxes": _C + """SELECT start, "end", class, round(y_min, 6) AS y_low, round(y_max, 6) AS y_high FROM merged CROSS JOIN ext""",
    "chart_bounds": _C + "SELECT min(o_orderdate) AS ts_min, max(o_orderdate) AS ts_max FROM f",
    "bad_runs_axis": _A + 'SELECT series, start, "end", class FROM bad',
    "merge_intervals_axis": _A + 'SELECT start, "end", class FROM merged',
    "interval_boxes_axis": _A + """SELECT start, "end", class, round(y_min, 6) AS y_low, round(y_max, 6) AS y_high
        FROM merged CROSS JOIN ext""",
    "marker_points_axis": _A + """SELECT series, o_orderdate, class, round(coalesce(y_min, 0.0), 6) AS y
        FROM h CROSS JOIN ext""",
    "chart_points": """WITH w AS (SELECT l_shipdate, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax
            FROM lineitem GROUP BY l_shipdate),
        lv AS (SELECT 'l_quantity' AS series, l_shipdate, l_quantity AS value FROM w
              UNION ALL SELECT 'l_tax', l_shipdate, l_tax FROM w),
        c AS (SELECT * FROM lv WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'
              AND value BETWEEN -999998.0 AND 999998.0),
        """ + _minmax_ctes("c", "series", "l_shipdate", 100) + " SELECT series, l_shipdate, value FROM picked",
    "valid_values": _F + "SELECT event_type, ts, round(value, 6) AS value FROM f WHERE value BETWEEN -999998.0 AND 999998.0",
    "sentinel_classes": _F + """SELECT event_type, ts, round(value, 6) AS value,
        CASE WHEN value = -999999.0 THEN 'anomaly' WHEN value = 999999.0 THEN 'gap'
             WHEN value BETWEEN -999998.0 AND 999998.0 THEN 'valid' ELSE 'ignored' END AS class FROM f""",
    "series_extrema": _F + """SELECT event_type, 'value' AS series, round(y_min, 6) AS "min", round(y_max, 6) AS "max"
        FROM ext WHERE y_min IS NOT NULL""",
    "marker_points": _F + """SELECT f.event_type, 'value' AS series, ts,
        CASE WHEN value = 999999.0 THEN 'red' ELSE 'orange' END AS class, round(coalesce(y_min, 0.0), 6) AS y
        FROM f JOIN ext USING (event_type) WHERE value IN (999999.0, -999999.0)""",
    "bad_runs": _F + 'SELECT event_type, series, start, "end", class FROM bad',
    "merge_intervals": _F + 'SELECT event_type, start, "end", class FROM merged',
    "interval_boxes": _F + """SELECT event_type, start, "end", class, round(y_min, 6) AS y_low, round(y_max, 6) AS y_high
        FROM merged LEFT JOIN ext USING (event_type)""",
    "symmetric_range": """WITH r AS (SELECT event_id, ts, value, user_id,
            row_number() OVER (ORDER BY ts, event_id) - 1 AS row_pos, count(*) OVER () AS n FROM events),
        p AS (SELECT *, greatest(200, n // 10) AS size FROM r),
        w AS (SELECT * FROM p WHERE row_pos >= least(100, greatest(0, n - size)) AND row_pos < least(100, greatest(0, n - size)) + size)
        SELECT -m AS range_low, m AS range_high FROM (
        SELECT greatest(abs(least(min(value), min(user_id))), abs(greatest(max(value), max(user_id)))) AS m FROM w)""",
    "profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c}), 6) AS "min", round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS "max" FROM lineitem""" for c in _PROFILE_COLS),
    "table_info": " UNION ALL ".join(
        f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", count({c}) AS non_null, '{t}' AS dtype FROM lineitem"""
        for i, (c, t) in enumerate([("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                                    ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                                    ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                                    ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")])),
    "series_projection": "SELECT ts, value, user_id FROM events",
    "selector_decode": """WITH c AS (
        SELECT p_partkey, p_brand || '::raw::' || p_name AS code FROM part
        UNION ALL SELECT p_partkey, p_name FROM part
        UNION ALL SELECT p_partkey, p_brand || '::' || p_name FROM part)
        SELECT p_partkey, code,
          CASE WHEN regexp_matches(code, '^(.*?)::(.*?)::(.*)$') THEN regexp_extract(code, '^(.*?)::(.*?)::(.*)$', 1) END AS component,
          CASE WHEN regexp_matches(code, '^(.*?)::(.*?)::(.*)$') THEN regexp_extract(code, '^(.*?)::(.*?)::(.*)$', 2) END AS mode,
          CASE WHEN regexp_matches(code, '^(.*?)::(.*?)::(.*)$') THEN regexp_extract(code, '^(.*?)::(.*?)::(.*)$', 3) ELSE code END AS "column"
        FROM c""",
    "time_range_clip": """SELECT event_id, ts, value FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 00:00:00'""",
    "time_bounds": "SELECT min(l_shipdate) AS ts_min, max(l_shipdate) AS ts_max FROM lineitem",
    "sorted_series": "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber",
    "sample_head": """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
        ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 5""",
    "ts_label": "SELECT event_id, strftime(ts, '%Y-%m-%d' || chr(10) || '%H:%M:%S') AS label FROM events",
    "positional_window": """WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_pos,
            count(*) OVER () AS n FROM events),
        p AS (SELECT *, greatest(200, n // 10) AS size FROM r),
        q AS (SELECT *, least(greatest(100, 0), greatest(0, n - size)) AS st FROM p)
        SELECT event_id, ts, row_pos FROM q WHERE row_pos >= st AND row_pos < st + size""",
    "minmax_downsample": f"WITH {_minmax_ctes('(SELECT l_returnflag AS event_type, l_shipdate AS ts, l_quantity AS value FROM lineitem)', 'event_type', 'ts', 100)} SELECT event_type, ts, value FROM picked",
    # candidates, then the pick of each bucket from the pick before it
    "lttb_downsample": f"""WITH RECURSIVE {_minmax_ctes('events', 'event_type', 'ts', 400)},
        cand AS (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY rn) - 1 AS idx,
                 count(*) OVER (PARTITION BY event_type) AS m,
                 CAST(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY event_type)) AS DOUBLE) AS x
                 FROM (SELECT event_type, ts, value, rn FROM picked
                       UNION SELECT event_type, ts, value, rn FROM r WHERE rn = 1 OR rn = cnt)),
        steps AS (SELECT event_type, m, unnest(generate_series(0, 97)) AS i FROM (SELECT DISTINCT event_type, m FROM cand WHERE m > 100)),
        edges AS (SELECT event_type, i, 1 + (i * (m - 2)) // 98 AS lo, 1 + ((i + 1) * (m - 2)) // 98 AS hi,
                  CASE WHEN i = 97 THEN m ELSE 1 + ((i + 2) * (m - 2)) // 98 END AS nhi FROM steps),
        ahead AS (SELECT e.event_type, e.i, any_value(lo) AS lo, any_value(hi) AS hi, avg(c.x) AS ax, avg(c.value) AS ay
                  FROM edges e JOIN cand c ON c.event_type = e.event_type AND c.idx >= e.hi AND c.idx < e.nhi GROUP BY e.event_type, e.i),
        pick AS (SELECT DISTINCT event_type, -1 AS i, CAST(0 AS BIGINT) AS idx FROM steps
                 UNION ALL
                 SELECT p.event_type, p.i + 1, arg_min(c.idx, (-abs((a.x - v.ax) * (c.value - a.value) - (a.x - c.x) * (v.ay - a.value)), c.idx))
                 FROM pick p JOIN cand a ON a.event_type = p.event_type AND a.idx = p.idx
                 JOIN ahead v ON v.event_type = p.event_type AND v.i = p.i + 1
                 JOIN cand c ON c.event_type = p.event_type AND c.idx >= v.lo AND c.idx < v.hi
                 GROUP BY p.event_type, p.i)
        SELECT event_type, ts, value FROM cand WHERE m <= 100 OR idx = m - 1
            OR (event_type, idx) IN (SELECT event_type, idx FROM pick)""",
}
