"""Sinks: partitioned Parquet, single-header CSV, GeoJSON lines and run metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clean(points: DataFrame, path: str, *, max_records: int | None = None) -> None:
    """Parquet by day; ``max_records`` bounds the rows of a file."""
    dated = points.withColumn("event_date", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_s") / 86400).cast("int")))
    writer = dated.write.mode("overwrite").partitionBy("event_date")
    (writer.option("maxRecordsPerFile", max_records) if max_records else writer).parquet(path)


def write_csv(df: DataFrame, path: str, *, single: bool = True) -> None:
    """CSV with a header; one file if ``single``, for results of a size fit for a report."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def merge_events(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are null."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def point_features(df: DataFrame, *properties: str) -> DataFrame:
    """A GeoJSON point feature per row, as text, for any map renderer."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_metadata(spark: SparkSession, path: str, meta: dict) -> None:
    """A JSON file at any path that Spark's file systems reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(meta, indent=2), "utf-8"))
    out.close()
