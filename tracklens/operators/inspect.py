"""Track, encounter and data-quality inspection queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vessel_track(points: DataFrame, mmsi: DataFrame, slow_knots: float = 1.0) -> DataFrame:
    """Points of the vessels in ``mmsi`` (one row each; a handful), coloured by speed."""
    colour = F.when(F.col("sog") < slow_knots, "red").otherwise("blue")
    return points.join(mmsi.select("mmsi"), "mmsi").withColumn("colour", colour)


def decimate(track: DataFrame, dots: int = 20) -> DataFrame:
    """The marks of a track: its start, its end, and about ``dots`` evenly spaced inner points."""
    tie = [c for c in ("seq", "lat", "lon") if c in track.columns]
    w = Window.partitionBy("mmsi")
    at = track.withColumns({"i": F.row_number().over(w.orderBy("ts_s", *tie)).cast("long") - 1, "n": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / dots))
    inner = (F.col("i") >= step) & (F.col("i") < F.col("n") - step) & (F.col("i") % step == 0)
    mark = F.when(F.col("i") == 0, "start").when(F.col("i") == F.col("n") - 1, "end").when(inner, "dot")
    return at.withColumn("mark", mark).filter(F.col("mark").isNotNull()).drop("n")


def event_colour(anomaly: Column) -> Column:
    return F.when(anomaly == "A", "red").when(anomaly == "D", "purple").otherwise("orange")


def track_overlay(events: DataFrame, mmsi: DataFrame) -> DataFrame:
    """The events of the vessels in ``mmsi`` for a map."""
    return events.join(mmsi.select("mmsi"), "mmsi").filter(F.col("lat_start").isNotNull()).withColumn("colour", event_colour(F.col("anomaly")))


def track_centroid(points: DataFrame) -> DataFrame:
    """Mean position of each vessel, from whole micro-degrees, so that the order of rows doesn't matter."""
    mean = lambda c: F.sum(F.round(F.col(c) * 1e6).cast("long")) / F.count("*") / 1e6
    return points.groupBy("mmsi").agg(mean("lat").alias("lat"), mean("lon").alias("lon"), F.count("*").alias("points"))


def longest_encounter(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("duration_h"), "mmsi1", "mmsi2", "ts_start").limit(1)


def encounter_segment(points: DataFrame, found: DataFrame) -> DataFrame:
    """Both vessels' pings within an encounter, ends included."""
    e = found.select(F.explode(F.array("mmsi1", "mmsi2")).alias("mmsi"), "ts_start", "ts_end")
    return points.join(e, "mmsi").filter(F.col("ts_s").between(F.col("ts_start"), F.col("ts_end"))).select("mmsi", "ts_s", "lat", "lon", "sog")


def segment_centre(segment: DataFrame, track: DataFrame) -> DataFrame:
    """Where to centre the map: the first point of the segment, else the middle of the track."""
    first = segment.orderBy("ts_s", "mmsi").limit(1).select(F.lit(0).alias("p"), "lat", "lon")
    w = Window.partitionBy("mmsi")
    mid = track.withColumns({"i": F.row_number().over(w.orderBy("ts_s")) - 1, "n": F.count("*").over(w)}).filter(F.col("i") == F.floor(F.col("n") / 2)).orderBy("mmsi").limit(1).select(F.lit(1).alias("p"), "lat", "lon")
    return first.unionByName(mid).orderBy("p").limit(1).select("lat", "lon")


def encounters_of(found: DataFrame, mmsi: str) -> DataFrame:
    return found.filter((F.col("mmsi1") == mmsi) | (F.col("mmsi2") == mmsi))


def sog_histogram(points: DataFrame) -> DataFrame:
    """Share of each speed in each vessel's pings."""
    n = points.groupBy("mmsi", "sog").agg(F.count("*").alias("n_rows"))
    return n.withColumn("percent", F.col("n_rows") * 100.0 / F.sum("n_rows").over(Window.partitionBy("mmsi"))).orderBy("mmsi", F.desc("n_rows"), "sog")


def daily_spread(points: DataFrame) -> DataFrame:
    """In how many days each vessel appears."""
    day = F.floor(F.col("ts_s") / 86400)
    return points.groupBy("mmsi").agg(F.countDistinct(day).alias("n_days"), F.count("*").alias("n_rows"))


def spread_summary(spread: DataFrame) -> DataFrame:
    return spread.agg(F.count("*").alias("vessels"), F.count_if(F.col("n_days") > 1).alias("multi_day"), F.max("n_days").alias("max_days"))


def stage_totals(**stages: DataFrame) -> DataFrame:
    """Rows and distinct vessels of each stage, one row a stage."""
    rows = [df.agg(F.lit(k).alias("stage"), F.count("*").alias("n_rows"), F.countDistinct("mmsi").alias("n_vessels")) for k, df in stages.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def first_jumps(events: DataFrame, n: int = 10) -> DataFrame:
    return events.filter(F.col("anomaly") == "D").orderBy("ts_start", "mmsi", "ts_end").limit(n)
