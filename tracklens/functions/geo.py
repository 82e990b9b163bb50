"""Column builders for distance, time and rounding; no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_NM = 1852.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(s))


def hours_between(start_s: Column, end_s: Column) -> Column:
    """Signed hours between two columns of whole epoch seconds."""
    return (end_s - start_s) / F.lit(3600.0)


def knots(dist_m: Column, hours: Column) -> Column:
    """Mean speed; infinite if no time has passed."""
    return F.when(hours <= 0, F.lit(float("inf"))).otherwise(dist_m / METRES_PER_NM / F.nullif(hours, F.lit(0.0)))


def round_stable(x: Column, digits: int) -> Column:
    """Half-up rounding of non-negative doubles that SQL engines agree on."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def epoch_seconds(ts: Column) -> Column:
    """Wall-clock seconds since 1970 of a timestamp_ntz, whatever the session's zone is."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def format_ts(seconds: Column) -> Column:
    """dd/MM/yyyy HH:mm:ss of whole epoch seconds, built from parts so that no time zone enters."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(" ", F.date_format(day, "dd/MM/yyyy"), F.concat_ws(":", part(F.floor(rest / 3600)), part(F.floor(rest % 3600 / 60)), part(rest % 60)))


def strip(c: Column) -> Column:
    """Drop all leading and trailing white space, not only spaces."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))
