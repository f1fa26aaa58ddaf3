"""Column expressions on ``timestamp_ntz`` time axes (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_SECOND = 1_000_000


def _c(c: str | Column) -> Column:
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def micros_between(start: str | Column, end: str | Column) -> Column:
    """``end - start`` in whole microseconds (bigint), whatever the session's zone."""
    return clock_micros(end) - clock_micros(start)


def clock_micros(ts: str | Column) -> Column:
    """Microseconds of the shown date and clock time since 1970-01-01, with no zone on the way."""
    t = _c(ts).cast("timestamp_ntz")
    day = F.unix_date(t.cast("date")).cast("bigint")
    second = (F.extract(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("bigint")
    minutes = (day * 24 + F.hour(t)) * 60 + F.minute(t)
    return minutes * F.lit(60_000_000) + second


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_SECOND))


def add_micros(ts: str | Column, micros: Column | int) -> Column:
    m = micros if isinstance(micros, Column) else F.lit(int(micros))
    return F.timestamp_add("MICROSECOND", m, _c(ts))


def to_ntz(c: str | Column) -> Column:
    return _c(c).cast("timestamp_ntz")


def seconds_to_micros(sec: Column) -> Column:
    """Seconds (double) to whole microseconds, rounded to nearest."""
    return F.round(sec * F.lit(float(MICROS_PER_SECOND))).cast("bigint")


CALENDAR_UNITS = ("day", "week", "month", "quarter", "year")
_DURATION_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
                   "hour": 3_600_000_000, "day": 86_400_000_000}


def duration_micros(text: str) -> int:
    """'15 minutes' -> 900000000; 'hour' -> 3600000000."""
    n, unit = text.split() if " " in text else (1, text)
    unit = unit.rstrip("s").lower()
    return int(float(n) * _DURATION_UNITS[unit])


def bucket_of(ts: str | Column, unit: str = "day") -> Column:
    """Monotone coarse bucket of a time column, used to split ordered windows.

    ``unit`` is a calendar unit (``date_trunc``, cast back to NTZ) or a fixed
    width such as ``"15 minutes"`` or ``"hour"`` (whole widths since 1970-01-01, bigint).
    """
    if unit == "day":
        return F.to_date(_c(ts))
    if unit in CALENDAR_UNITS:
        return F.date_trunc(unit, _c(ts)).cast("timestamp_ntz")
    width = duration_micros(unit)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(micros_between(epoch, ts) / F.lit(width)).cast("bigint")


def attach_scalars(big, one_row, cols: list[str]):
    """Add the columns of a table that holds at most one row (a global
    aggregate) to every row of ``big`` as ONE scalar subquery: computed
    once, shipped as a value, no join (NULLs when the table is empty)."""
    from pyspark.sql import functions as F

    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__one")).scalar()
    out = big.withColumn("__one", packed)
    return out.withColumns({c: F.col("__one")[c] for c in cols}).drop("__one")
