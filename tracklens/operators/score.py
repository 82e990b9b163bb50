"""Vessel counts, the suspicion index and its ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.config import DEFAULT, Thresholds
from tracklens.functions import round_stable


def vessel_counts(seg: DataFrame) -> DataFrame:
    return seg.groupBy("mmsi").agg(F.count_if("is_dark").alias("A"), F.count_if("is_draught").alias("C"), F.count_if("is_teleport").alias("D"), F.count("*").alias("points"))


def vessel_scores(seg: DataFrame, b: DataFrame) -> DataFrame:
    """All vessels with a clean ping. One partial/final aggregation; measures are those of the rounded events."""
    gap = F.max(F.when(F.col("is_dark"), round_stable(F.col("hours"), 2)))
    jump = F.sum(F.when(F.col("is_teleport"), round_stable(F.col("dist_m"), 1).cast("decimal(18,1)")))
    per = seg.groupBy("mmsi").agg(
        F.count_if("is_dark").alias("A"), F.count_if("is_draught").alias("C"), F.count_if("is_teleport").alias("D"), F.count("*").alias("points"),
        F.coalesce(gap, F.lit(0.0)).alias("max_gap_hours"), (F.coalesce(jump.cast("double"), F.lit(0.0)) / 1852.0).alias("total_dist_nm"),
    )
    index = round_stable(F.col("max_gap_hours") / 2 + F.col("total_dist_nm") / 10 + F.col("C") * 15.0, 2)
    return per.join(b, "mmsi", "left").select("mmsi", "A", F.coalesce("B", F.lit(0)).cast("long").alias("B"), "C", "D", index.alias("DFSI"), "points", "max_gap_hours", "total_dist_nm")


def top_vessels(scores: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return scores.orderBy(F.desc("DFSI"), F.asc("mmsi")).limit(t.top_n)
