"""Anomaly events from segments: gaps with movement (A), draught changes (C), jumps (D), loiter candidates (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions import round_stable

PLACE = {"ts_start": "ts_s_prev", "ts_end": "ts_s", "lat_start": "lat_prev", "lon_start": "lon_prev", "lat_end": "lat", "lon_end": "lon"}


def _measures(kind: str) -> dict[str, Column]:
    return {
        "A": {"gap_hours": round_stable(F.col("hours"), 2), "dist_m": round_stable(F.col("dist_m"), 1), "speed_knots": round_stable(F.col("speed_knots"), 2)},
        "C": {"draught_before": F.col("draught_prev"), "draught_after": F.col("draught"), "change_pct": F.col("change_pct")},
        "D": {"speed_knots": round_stable(F.col("speed_knots"), 1), "dist_m": round_stable(F.col("dist_m"), 1), "hours": round_stable(F.col("hours"), 4)},
    }[kind]


FLAGS = {"A": "is_dark", "C": "is_draught", "D": "is_teleport"}
MEASURES = ("gap_hours", "dist_m", "speed_knots", "hours", "draught_before", "draught_after", "change_pct")


def _events(seg: DataFrame, kind: str) -> DataFrame:
    return seg.filter(FLAGS[kind]).select("mmsi", *(F.col(c).alias(k) for k, c in PLACE.items()), *(c.alias(k) for k, c in _measures(kind).items()))


def going_dark(seg: DataFrame) -> DataFrame:
    return _events(seg, "A")


def draught_change(seg: DataFrame) -> DataFrame:
    return _events(seg, "C")


def teleport(seg: DataFrame) -> DataFrame:
    return _events(seg, "D")


def all_events(seg: DataFrame) -> DataFrame:
    """The sparse union of A, C and D in one pass over the segments."""
    row = lambda k: F.when(F.col(FLAGS[k]), F.struct(F.lit(k).alias("anomaly"), *((_measures(k).get(m, F.lit(None))).cast("double").alias(m) for m in MEASURES)))
    found = F.explode(F.filter(F.array(*(row(k) for k in FLAGS)), lambda x: x.isNotNull()))
    return seg.filter(F.col("is_dark") | F.col("is_draught") | F.col("is_teleport")).select("mmsi", *(F.col(c).alias(k) for k, c in PLACE.items()), found.alias("e")).select("e.anomaly", "mmsi", *PLACE, *(F.col(f"e.{m}") for m in MEASURES))


def loiter_candidates(seg: DataFrame) -> DataFrame:
    """Slow pings (by derived speed) of vessels under way."""
    return seg.filter("is_loiter").select("mmsi", "lat", "lon", "ts_s")
