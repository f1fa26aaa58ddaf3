"""Registered queries for the cleaning chain and the time-axis operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import clean, gaps
from chronoweave.plans import steps
from chronoweave.plans.checks_common import (
    EVENTS_MINUTE_SQL, ORDERS_DAILY_SQL, events_minute, orders_daily, r6, table,
)

EV_KEYS = ["event_type"]


def q_unify_duplicates(spark, d):
    li = table(spark, d, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice",
                                            "l_discount", "l_tax")
    u = clean.unify_duplicates(li, "l_shipdate")
    return u.select("l_shipdate", *[r6(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])


def q_duplicate_report(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return clean.duplicate_report(o, "o_orderdate")


def q_sentinel_to_null(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return clean.sentinel_to_null(li, ["l_discount", "no_such_column"], [0.05], 1e-6)


def q_sentinel_counts(spark, d):
    li = table(spark, d, "lineitem")
    return clean.sentinel_report(li, ["l_discount", "l_tax", "no_such_column"], [0.05, 0.02], 1e-6)


def q_ts_delta(spark, d):
    return gaps.ts_delta(events_minute(spark, d).drop("value"), "ts", EV_KEYS)


def q_ts_delta_axis(spark, d):
    return gaps.ts_delta(orders_daily(spark, d).drop("o_totalprice"), "o_orderdate")


def q_resolution(spark, d):
    return gaps.resolution(events_minute(spark, d), "ts", EV_KEYS)


def q_resolution_axis(spark, d):
    return gaps.resolution(orders_daily(spark, d), "o_orderdate")


def customer_days(spark, d):
    """A series per customer: mean order price by day.  Customers with one order day have no resolution."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey", "o_orderdate").agg(F.avg("o_totalprice").alias("o_totalprice"))


def q_resolution_fallback(spark, d):
    return gaps.resolution_with_fallback(customer_days(spark, d), "o_orderdate", ["o_custkey"])


def q_gap_report(spark, d):
    return gaps.gap_report(events_minute(spark, d), "ts", EV_KEYS)


def q_gap_report_axis(spark, d):
    return gaps.gap_report(orders_daily(spark, d), "o_orderdate")


def q_gap_fill(spark, d):
    filled, _ = gaps.gap_fill(events_minute(spark, d), "ts", EV_KEYS)
    return filled.select("event_type", "ts", r6("value"))


def q_gap_fill_axis(spark, d):
    filled, _ = gaps.gap_fill(orders_daily(spark, d), "o_orderdate")
    return filled.select("o_orderdate", r6("o_totalprice"))


# Manifest of the flagship cleaning run: every step of the reference order
# listed, the file steps off (the input is already a table).
CLEAN_CONFIG = {
    "run_enabled": True,
    "available_functions": [
        {"merge_all_datasets": {"enabled": False}},
        {"load_and_process_data": {"enabled": False}},
        {"clean_and_unify_duplicates": {"enabled": True}},
        {"negative_freq_report": {"enabled": True}},
        {"rellenar_timestamps": {"enabled": True}},
        {"normalize_timestamp_column": {"enabled": True}},
    ],
}


def clean_run(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", "o_totalprice")
    out, ctx = steps.run_steps(o, CLEAN_CONFIG, ts="o_orderdate")
    return out, ctx, o


def q_clean_steps(spark, d):
    out, _, _ = clean_run(spark, d)
    return out.select("o_orderdate", r6("o_totalprice"))


def q_step_metrics(spark, d):
    out, ctx, raw = clean_run(spark, d)
    return steps.run_metrics(raw, out, ctx)


QUERIES = {
    "unify_duplicates": q_unify_duplicates,
    "duplicate_report": q_duplicate_report,
    "sentinel_to_null": q_sentinel_to_null,
    "sentinel_counts": q_sentinel_counts,
    "ts_delta": q_ts_delta,
    "ts_delta_axis": q_ts_delta_axis,
    "resolution": q_resolution,
    "resolution_axis": q_resolution_axis,
    "resolution_fallback": q_resolution_fallback,
    "gap_report": q_gap_report,
    "gap_report_axis": q_gap_report_axis,
    "gap_fill": q_gap_fill,
    "gap_fill_axis": q_gap_fill_axis,
    "clean_steps": q_clean_steps,
    "step_metrics": q_step_metrics,
}

# ---------------------------------------------------------------- oracle SQL


def _gap_ctes(src_sql: str, ts: str, keys: list[str]) -> str:
    """CTEs: s (series), st (steps), r (resolution mode), rep (gap report)."""
    pk = f"PARTITION BY {', '.join(keys)} " if keys else ""
    kc = "".join(f"{k}, " for k in keys)
    grp = ", ".join(keys + ["step_us"])
    join = f"JOIN r USING ({', '.join(keys)})" if keys else "CROSS JOIN r"
    rpk = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""
s AS ({src_sql}),
st AS (SELECT *, epoch_us({ts}) - epoch_us(prev_ts) AS step_us FROM
        (SELECT {kc}{ts}, lag({ts}) OVER ({pk}ORDER BY {ts}) AS prev_ts FROM s) WHERE prev_ts IS NOT NULL),
c AS (SELECT {grp}, count(*) AS n FROM st GROUP BY {grp}),
r AS (SELECT {kc}step_us AS res_us FROM
        (SELECT *, row_number() OVER ({rpk}ORDER BY n DESC, step_us) AS rn FROM c) WHERE rn = 1),
rep AS (SELECT {''.join(f'st.{k}, ' for k in keys)}prev_ts, {ts} AS curr_ts, step_us / 1e6 AS gap_seconds,
        greatest(0, CAST(floor((step_us / 1e6 + 0.5) / (res_us / 1e6)) AS BIGINT) - 1) AS missing_samples,
        res_us
        FROM st {join} WHERE abs(step_us / 1e6 - res_us / 1e6) > 0.5)"""


def _fill_sql(src_sql, ts, keys, value_cols):
    kc = "".join(f"{k}, " for k in keys)
    vals = ", ".join(f"round(999999.0, 6) AS {v}" for v in value_cols)
    vals_s = ", ".join(f"round({v}, 6) AS {v}" for v in value_cols)
    return f"""WITH {_gap_ctes(src_sql, ts, keys)},
ins AS (SELECT {kc}prev_ts + to_microseconds(j * res_us) AS {ts} FROM
         (SELECT *, unnest(generate_series(1, missing_samples)) AS j FROM rep WHERE missing_samples > 0))
SELECT {kc}{ts}, {vals_s} FROM s UNION ALL SELECT {kc}{ts}, {vals} FROM ins"""


ORACLE = {
    "unify_duplicates": """SELECT l_shipdate, round(avg(l_quantity), 6) AS l_quantity,
        round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount,
        round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY l_shipdate""",
    "duplicate_report": """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
        WHERE o_orderdate IN (SELECT o_orderdate FROM orders GROUP BY 1 HAVING count(*) > 1)""",
    "sentinel_to_null": """SELECT l_orderkey, l_linenumber,
        CASE WHEN abs(l_discount - 0.05) <= 1e-6 THEN NULL ELSE l_discount END AS l_discount, l_tax
        FROM lineitem""",
    "sentinel_counts": """SELECT * FROM (
        SELECT 'l_discount' AS "column", CAST(0.05 AS DOUBLE) AS sentinel, CAST(count_if(abs(l_discount - 0.05) <= 1e-6) AS BIGINT) AS replaced FROM lineitem
        UNION ALL SELECT 'l_discount', 0.02, CAST(count_if(abs(l_discount - 0.02) <= 1e-6) AS BIGINT) FROM lineitem
        UNION ALL SELECT 'l_tax', 0.05, CAST(count_if(abs(l_tax - 0.05) <= 1e-6) AS BIGINT) FROM lineitem
        UNION ALL SELECT 'l_tax', 0.02, CAST(count_if(abs(l_tax - 0.02) <= 1e-6) AS BIGINT) FROM lineitem)""",
    "ts_delta": f"""WITH s AS ({EVENTS_MINUTE_SQL})
        SELECT event_type, ts, prev_ts, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 AS delta_seconds FROM
        (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS prev_ts FROM s)""",
    "ts_delta_axis": f"""WITH s AS ({ORDERS_DAILY_SQL})
        SELECT o_orderdate, prev_ts, (epoch_us(o_orderdate) - epoch_us(prev_ts)) / 1e6 AS delta_seconds FROM
        (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderdate) AS prev_ts FROM s)""",
    "resolution": f"""WITH {_gap_ctes(EVENTS_MINUTE_SQL, 'ts', EV_KEYS)}
        SELECT event_type, res_us AS resolution_us, res_us / 1e6 AS resolution_seconds FROM r""",
    "resolution_axis": f"""WITH {_gap_ctes(ORDERS_DAILY_SQL, 'o_orderdate', [])}
        SELECT res_us AS resolution_us, res_us / 1e6 AS resolution_seconds FROM r""",
    "resolution_fallback": f"""WITH {_gap_ctes(
        "SELECT o_custkey, o_orderdate, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2",
        'o_orderdate', ['o_custkey'])}
        SELECT k.o_custkey, coalesce(res_us, 10000000) AS resolution_us,
               coalesce(res_us, 10000000) / 1e6 AS resolution_seconds,
               coalesce(res_us, 10000000) / 1e6 + 0.5 AS threshold_seconds
        FROM (SELECT DISTINCT o_custkey FROM s) k LEFT JOIN r USING (o_custkey)""",
    "gap_report": f"""WITH {_gap_ctes(EVENTS_MINUTE_SQL, 'ts', EV_KEYS)}
        SELECT event_type, prev_ts, curr_ts, gap_seconds, missing_samples FROM rep""",
    "gap_report_axis": f"""WITH {_gap_ctes(ORDERS_DAILY_SQL, 'o_orderdate', [])}
        SELECT prev_ts, curr_ts, gap_seconds, missing_samples FROM rep""",
    "gap_fill": _fill_sql(EVENTS_MINUTE_SQL, "ts", EV_KEYS, ["value"]),
    "gap_fill_axis": _fill_sql(ORDERS_DAILY_SQL, "o_orderdate", [], ["o_totalprice"]),
    "clean_steps": _fill_sql(ORDERS_DAILY_SQL, "o_orderdate", [], ["o_totalprice"]),
    "step_metrics": f"""WITH {_gap_ctes(ORDERS_DAILY_SQL, 'o_orderdate', [])}
        SELECT 'load' AS step, 'rows_in' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders
        UNION ALL SELECT 'load', 'rows_valid_ts', CAST(count(o_orderdate) AS DOUBLE) FROM orders
        UNION ALL SELECT 'unify', 'rows_with_duplicate_ts', CAST(coalesce(sum(CASE WHEN n > 1 THEN n ELSE 0 END), 0) AS DOUBLE)
            FROM (SELECT o_orderdate, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
        UNION ALL SELECT 'unify', 'distinct_ts', CAST(count(DISTINCT o_orderdate) AS DOUBLE) FROM orders
        UNION ALL SELECT 'fill', 'gaps', CAST(count(*) AS DOUBLE) FROM rep
        UNION ALL SELECT 'fill', 'rows_inserted', CAST(coalesce(sum(missing_samples), 0) AS DOUBLE) FROM rep
        UNION ALL SELECT 'final', 'rows_out', CAST((SELECT count(*) FROM s) + (SELECT coalesce(sum(missing_samples), 0) FROM rep) AS DOUBLE)""",
}
