"""Column expressions shared by the operators (all JVM built-ins, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import LOCAL_TZ, LOCAL_TZ_ABBREVIATIONS, VENDOR_SUFFIX


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -------------------------------------------------------------------

def clean_ticker(c) -> Column:
    """trim, upper-case, keep only A-Z and 0-9 (``' bhp.ax '`` -> ``BHPAX``)."""
    return F.regexp_replace(F.upper(F.trim(col_(c))), "[^A-Z0-9]", "")


def vendor_symbol(ticker, suffix: str = VENDOR_SUFFIX) -> Column:
    return F.concat(col_(ticker), F.lit(suffix))


def to_text(c) -> Column:
    """Null stays null; binary decodes as UTF-8; everything else is cast to string."""
    return col_(c).cast("string")


# --- numbers ----------------------------------------------------------------

def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_ratio(num, den) -> Column:
    """num / den, null when den is 0 or null (never raises under ANSI)."""
    return F.try_divide(col_(num), col_(den))


def log10_positive(c) -> Column:
    """log10 of positive values; 0, negative and null give null."""
    c = col_(c)
    return F.when(c > 0, F.log10(c))


def exact_double_text(c) -> Column:
    """Engine-independent text that is the same only for equal doubles: hexadecimal digits and a power of two (``0x1.8p1``).

    Plain double -> string differs between engines (``1.2345678E7`` vs
    ``12345678.0``), and any rounding would give different values one text.
    Both zeros are ``0``, null and NaN have no text.
    """
    x = col_(c)
    return (F.when(F.isnan(x) | x.isNull(), F.lit(None)).when(x == 0, F.lit("0")).when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf")).otherwise(F.format_string("%a", x)))


# --- calendar ---------------------------------------------------------------

def monday0_weekday(d) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(col_(d))


def business_days_between(start, end) -> Column:
    """Number of Monday-Friday dates in [start, end] (closed form, no calendar array)."""
    start, end = col_(start), col_(end)
    n = F.datediff(end, start) + F.lit(1)
    wd = monday0_weekday(start)
    rem = n % 7
    stop = wd + rem
    head = F.greatest(F.lit(0), F.least(stop, F.lit(5)) - wd)
    tail = F.greatest(F.lit(0), F.least(stop, F.lit(12)) - F.greatest(wd, F.lit(7)))
    return F.when(n <= 0, F.lit(0)).otherwise((n / 7).cast("int") * 5 + head + tail)


def local_time(ts, tz: str = LOCAL_TZ) -> Column:
    """UTC instant (timestamp or timestamp_ntz holding UTC) as wall-clock time in ``tz``."""
    return F.from_utc_timestamp(col_(ts).cast("timestamp"), tz)


def _utc_offset(utc: Column, tz: str) -> Column:
    return F.unix_timestamp(F.from_utc_timestamp(utc, tz)) - F.unix_timestamp(utc)


def local_tz_abbreviation(ts, tz: str = LOCAL_TZ, abbreviations: dict | None = None) -> Column:
    """Daylight or standard abbreviation of ``tz`` at a UTC instant.

    Standard time is the zone's smaller offset of the year (January or July).
    """
    names = abbreviations or LOCAL_TZ_ABBREVIATIONS
    utc = col_(ts).cast("timestamp")
    year = F.trunc(utc.cast("date"), "year")
    standard = F.least(_utc_offset(year.cast("timestamp"), tz), _utc_offset(F.add_months(year, 6).cast("timestamp"), tz))
    return F.when(_utc_offset(utc, tz) > standard, F.lit(names["daylight"])).otherwise(F.lit(names["standard"]))


def coerce_timestamp(c) -> Column:
    """Timestamp from a timestamp or ISO-8601 text column; unparsable text becomes null."""
    return F.coalesce(F.try_to_timestamp(col_(c).cast("string")), col_(c).try_cast("timestamp"))


def iso_date(d) -> Column:
    return F.date_format(col_(d), "yyyy-MM-dd")
