"""The chart request as one plan: selector codes -> projection
-> time clip -> valid values -> extrema, markers, bad-data boxes, downsampled
points, time bounds.

The parquet scan reads only the time column and the selected measurements,
with the clip pushed into it and month folders pruned.  All outputs are lazy;
only counting the time buckets is a job of its own, and a stored dataset's
sidecar saves it.  Each output is small (<= n points per series, one row per
interval or series).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from chronoweave.functions.ordered import Buckets
from chronoweave.operators import gaps, quality, series
from chronoweave.operators.clean import q
from chronoweave.sources.store import Stored


@dataclass
class ChartData:
    points: DataFrame      # (series, ts, value): <= n per series
    extrema: DataFrame     # (series, min, max)
    overall: DataFrame     # (y_min, y_max, marker_level)
    markers: DataFrame     # (series, ts, class, y)
    bounds: DataFrame      # (ts_min, ts_max) of the unclipped table
    make_boxes: Callable[[], DataFrame]

    @cached_property
    def boxes(self) -> DataFrame:  # (start, end, class, y_low, y_high)
        return self.make_boxes()


def series_query(table: DataFrame, codes: list[str], ts: str = "Timestamp", lo=None, hi=None,
                 n: int = series.DEFAULT_POINTS, method: str = "minmax", known: Stored | None = None,
                 bucket: str | Buckets | None = None) -> ChartData:
    """``known``: the stored dataset ``table`` belongs to; its sidecar then gives bounds, resolution and time buckets
    without a job or a scan.  ``bucket`` names the buckets of the time axis otherwise (default: counted)."""
    bucket = bucket or (known.bucket if known else "auto")
    # clip first: the projection drops the month column that prunes folders
    visible = series.series_projection(series.time_range_clip(table, ts, lo, hi), ts, codes)
    cols = [c for c in visible.columns if c != ts]
    lng = quality.to_long(visible, ts, cols)
    down = series.minmax_downsample if method == "minmax" else series.lttb_downsample
    # a series has a row per time stamp at most, so the table's buckets hold for each
    points = down(quality.valid_values(lng), ts, "value", n, ["series"], bucket=bucket)
    overall = quality.overall_extrema(visible, cols)

    def boxes() -> DataFrame:
        # resolution of the whole table, runs of the visible rows (reference rule)
        res = known.resolution() if known else gaps.resolution_with_fallback(table.select(q(ts)), ts, bucket=bucket)
        return quality.interval_boxes(quality.bad_intervals(visible, ts, cols, res=res, bucket=bucket), overall)

    return ChartData(points=points, extrema=quality.series_extrema(visible, cols), overall=overall,
                     markers=quality.marker_points(visible, ts, cols), bounds=known.bounds() if known else series.time_bounds(table, ts),
                     make_boxes=boxes)
