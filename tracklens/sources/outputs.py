"""Readers of what the job wrote: typed frames from its Parquet and CSV folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions import epoch_seconds

EVENTS = "anomaly string, mmsi string, ts_start string, ts_end string, lat_start double, lon_start double, lat_end double, lon_end double, gap_hours double, dist_m double, speed_knots double, hours double, draught_before double, draught_after double, change_pct double"
ENCOUNTERS = "mmsi1 string, mmsi2 string, ts_start string, ts_end string, duration_h double"
COUNTS = "mmsi string, B long"
SCORES = "mmsi string, A long, B long, C long, D long, DFSI double, points long, max_gap_hours double, total_dist_nm double"


def _seconds(df: DataFrame) -> DataFrame:
    at = lambda c: epoch_seconds(F.to_timestamp(c, "dd/MM/yyyy HH:mm:ss").cast("timestamp_ntz"))
    return df.withColumns({c: at(F.col(c)) for c in ("ts_start", "ts_end") if c in df.columns})


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _seconds(spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path))


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """Clean pings, with their day as a partition column."""
    return spark.read.parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Anomaly events, times as epoch seconds."""
    return _csv(spark, path, EVENTS)


def read_encounters(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ENCOUNTERS)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, COUNTS)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, SCORES)
