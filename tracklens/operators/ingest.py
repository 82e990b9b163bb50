"""Validation, reason-coded rejects, and two-minute down-sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.config import DEFAULT, Thresholds
from tracklens.functions import computed, strip


def rules(df: DataFrame, t: Thresholds = DEFAULT) -> dict[str, Column]:
    """Reason -> predicate that holds for a good row; a null is a failure."""
    mmsi, lat, lon, sog = (F.col(c) for c in ("mmsi", "lat", "lon", "sog"))
    prefix = reduce(lambda a, b: a | b, (mmsi.startswith(p) for p in t.dirty_prefixes))
    sog_bad = F.col("sog_bad") if "sog_bad" in df.columns else F.lit(False)
    named = {
        "mmsi_format": mmsi.rlike(r"\A[1-9][0-9]{8}\z"),
        "mmsi_dirty": ~mmsi.isin(*t.dirty_mmsi),
        "mmsi_prefix": ~prefix,
        "timestamp": F.col("ts_s").isNotNull(),
        "mobile_type": strip(F.col("mobile")) == t.mobile_type,
        "ship_type": ~F.lower(strip(F.coalesce(F.col("ship_type"), F.lit("")))).isin(*t.excluded_ship_types),
        "position_missing": lat.isNotNull() & lon.isNotNull(),
        "position_zero": (lat != 0) & (lon != 0),
        "position_area": lat.between(t.lat_min, t.lat_max) & lon.between(t.lon_min, t.lon_max),
        "sog": ~sog_bad & (sog.isNull() | F.isnan(sog) | (sog <= t.max_sog)),
    }
    return named


def is_valid(df: DataFrame, t: Thresholds = DEFAULT) -> Column:
    return reduce(lambda a, b: a & b, (v for k, v in rules(df, t).items() if k != "position_missing"))  # a null isn't in any area


def clean_pings(df: DataFrame, t: Thresholds = DEFAULT, *, limit: int | None = None) -> DataFrame:
    """Valid rows with the six columns in use; missing SOG and draught are 0.0. ``limit`` caps the accepted rows (for trials)."""
    keep = [c for c in ("seq", "src_file", "src_order") if c in df.columns]
    good = df.filter(is_valid(df, t)).select(*keep, "mmsi", "ts_s", "lat", "lon", F.coalesce("sog", F.lit(0.0)).alias("sog"), F.coalesce("draught", F.lit(0.0)).alias("draught"))
    return good if limit is None else good.limit(limit)


def rejects(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Bad rows with ``reason``, the first rule that fails."""
    good = F.lit(None).cast("string")
    reason = reduce(lambda acc, kv: F.when(kv[1], acc).otherwise(kv[0]), reversed(rules(df, t).items()), good)
    return computed(df.withColumn("reason", reason)).filter(F.col("reason").isNotNull())


def rejects_by_reason(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return rejects(df, t).groupBy("reason").agg(F.count("*").alias("n_rows"))


def quarantined_draught(parsed: DataFrame) -> DataFrame:
    """Number of rows whose draught text was no number (they stay, with draught missing)."""
    return parsed.agg(F.count_if("draught_bad").alias("n_rows"))


def bucket(t: Thresholds = DEFAULT) -> Column:
    return F.floor(F.col("ts_s") / t.bucket_seconds)


def downsample(points: DataFrame, *, order: list[str] | None = None, scope: str = "global", t: Thresholds = DEFAULT) -> DataFrame:
    """The first ping of each vessel and two-minute bucket.

    The key is fine, so that no vessel makes a large partition, and Spark keeps only
    the first row of each key before the shuffle (WindowGroupLimit). ``scope='file'``
    takes buckets by input file, in file order.
    """
    keys = [F.col("mmsi"), bucket(t)]
    if scope == "file":
        keys, order = [F.col("src_file"), *keys], ["src_order"]
    order = order or (["ts_s", "seq"] if "seq" in points.columns else ["ts_s", "lat", "lon", "sog", "draught"])
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return points.withColumn("_rn", first).filter("_rn = 1").drop("_rn")
