"""Projection of the driver's ``events`` table to raw pings, as FIXTURES.md defines it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions import computed, epoch_seconds, format_ts


def raw_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    k = F.col("event_id")
    every = lambda n: k % n == 0
    e = epoch_seconds(F.col("ts"))
    berth = F.expr("(user_id - user_id % 2) div 2")
    lat = (F.lit(51_500_000) + berth % 100 * 100_000 + k % 7 * 300 + F.when(F.col("event_type") == "error", 3_000_000).otherwise(0)).cast("double") / 1e6
    pings = events.select(
        k.alias("seq"),
        F.when(every(97), "111111111").when(every(193), "000000000").when(every(389), "12345").otherwise((F.lit(219_000_000) + F.col("user_id")).cast("string")).alias("mmsi"),
        (e - e % 3600).alias("ts_s"),
        F.when(every(101), "Class B").otherwise("Class A").alias("mobile"),
        F.when(every(103), " Tug ").when(every(107), "SAR").when(every(109), F.lit(None).cast("string")).when(every(113), "Towing long/wide").otherwise("Cargo").alias("ship_type"),
        F.when(every(127), F.lit(70.0)).when(every(131), F.lit(0.0)).otherwise(lat).alias("lat"),
        F.when(every(137), F.lit(0.0)).otherwise((F.lit(4_000_000) + berth % 50 * 400_000).cast("double") / 1e6).alias("lon"),
        F.when(every(139), F.lit(61.0)).when(every(149), F.lit(None).cast("double")).when(every(11), F.lit(0.0)).otherwise((1 + k % 9).cast("double") / 10.0).alias("sog"),
        F.when(every(13), F.lit(None).cast("double")).otherwise((50 + k % 5 * 2).cast("double") / 10.0).alias("draught"),
    )
    return computed(pings)


def faulty_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection as the text of a source file, with faults that only text can have."""
    every = lambda n: F.col("seq") % n == 0
    text = lambda n, fault, c: F.when(every(n), fault).otherwise(F.col(c).cast("string"))
    return raw_pings(spark, sf_dir).select(
        F.when(every(151), "not a time").otherwise(format_ts(F.col("ts_s"))).alias("# Timestamp"),
        F.col("mobile").alias("Type of mobile"),
        text(173, "111222333", "mmsi").alias("MMSI"),
        text(157, "north", "lat").alias("Latitude"),
        F.col("lon").cast("string").alias("Longitude"),
        F.lit("Under way").alias("Navigational status"),
        text(163, "fast", "sog").alias("SOG"),
        text(167, "deep", "draught").alias("Draught"),
        F.col("ship_type").alias("Ship type"),
    )


def drifting(cand: DataFrame) -> DataFrame:
    """Candidates by day, all moved north by 0.01 degrees a day, so that pairs which stay together drift."""
    day = F.floor(F.col("ts_s") / 86400)
    north = (day % 32).cast("double") / 100.0
    return cand.groupBy("mmsi", (day * 86400).alias("ts_s"), north.alias("north")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")).select("mmsi", (F.col("lat") + F.col("north")).alias("lat"), "lon", "ts_s")
