"""Consecutive pings of a vessel as one row each: the single lag window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.config import DEFAULT, Thresholds
from tracklens.functions import haversine_m, hours_between, knots, round_stable


def segments(points: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Every point with its predecessor (null for a vessel's first) and the detectors' verdicts.

    After down-sampling a vessel has at most 720 points a day, which bounds the
    window's partitions.
    """
    tie = [c for c in ("seq", "lat", "lon", "sog", "draught") if c in points.columns]
    w = Window.partitionBy("mmsi").orderBy("ts_s", *tie)
    back = lambda c: F.lag(c).over(w).alias(f"{c}_prev")
    return judge(points.select("*", back("ts_s"), back("lat"), back("lon"), back("draught")), t)


def judge(base: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Measures and verdicts of rows that hold a ping and the one before it (``*_prev``)."""
    measured = base.withColumns({"hours": hours_between(F.col("ts_s_prev"), F.col("ts_s")), "dist_m": haversine_m(F.col("lat_prev"), F.col("lon_prev"), F.col("lat"), F.col("lon"))})
    measured = measured.withColumn("speed_knots", knots(F.col("dist_m"), F.col("hours")))
    h, d, v, d1, d2 = (F.col(c) for c in ("hours", "dist_m", "speed_knots", "draught_prev", "draught"))
    draughts = (d1 > 0) & (d2 > 0) & ~F.isnan(d1) & ~F.isnan(d2)
    change = F.abs(d2 - d1) / F.nullif(d1, F.lit(0.0))
    flags = {
        "is_dark": (h > t.dark_gap_h) & (d > t.dark_min_dist_m) & (v > t.dark_min_knots),
        "is_draught": draughts & (h >= t.draught_gap_h) & (change > t.draught_change),
        "is_teleport": (h > 0) & (v > t.teleport_knots),
        "is_loiter": (h > 0) & (F.col("sog") > 0) & ~F.isnan("sog") & (v < t.loiter_knots),
    }
    return measured.withColumns({k: F.coalesce(x, F.lit(False)) for k, x in flags.items()}).withColumn("change_pct", F.when(draughts, round_stable(change * 100, 2)))


def segment_metrics(seg: DataFrame) -> DataFrame:
    """Measures of each consecutive pair."""
    return seg.filter(F.col("ts_s_prev").isNotNull()).select("mmsi", F.col("ts_s_prev").alias("ts_start"), F.col("ts_s").alias("ts_end"), "hours", "dist_m", F.when(F.col("hours") > 0, F.col("speed_knots")).alias("speed_knots"))


def first_last_ping(points: DataFrame) -> DataFrame:
    """First and last ping of each vessel; partial aggregation, no window."""
    tie = ["ts_s", *(c for c in ("seq",) if c in points.columns), "lat", "lon", "draught", "sog"]
    ends = points.groupBy("mmsi").agg(F.min(F.struct(*tie)).alias("first"), F.max(F.struct(*tie)).alias("last"))
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("boundary"), F.col(k).alias("p")) for k in ("first", "last"))))
    return ends.select("mmsi", both.alias("x")).select("mmsi", "x.boundary", "x.p.ts_s", "x.p.lat", "x.p.lon", "x.p.draught", "x.p.sog")
