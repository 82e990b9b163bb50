"""CSV source of raw position reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.functions import computed, epoch_seconds, strip

#: The header names of the source files.
COLUMNS = {
    "# Timestamp": "timestamp_str",
    "Type of mobile": "mobile",
    "MMSI": "mmsi",
    "Latitude": "lat_text",
    "Longitude": "lon_text",
    "SOG": "sog_text",
    "Draught": "draught_text",
    "Ship type": "ship_type",
}


def read_ais(spark: SparkSession, glob: str | list[str], *, file_order: bool = False, columns: list[str] | None = None) -> DataFrame:
    """All-string scan of header CSVs, projected to the eight columns in use.

    Header names are read from the first file unless ``columns`` gives them, and a
    glob without a match raises. ``file_order`` adds ``src_file`` and ``src_order``
    for first-in-file downsampling.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    raw = reader.csv(glob)
    picked = [F.col(f"`{name}`").cast("string").alias(alias) for name, alias in COLUMNS.items()]
    if file_order:
        picked += [F.col("_metadata.file_path").alias("src_file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("src_order")]
    return raw.select(*picked)


def parse(raw: DataFrame, *, lenient_ts: bool = False) -> DataFrame:
    """Typed pings; text that can't be converted becomes null, and ``*_bad`` tells it from missing text.

    ``lenient_ts`` takes the digits by position, whatever the separators are.
    """
    text = F.col("timestamp_str")
    if lenient_ts:
        cut = lambda at, n: F.substring(text, at, n)
        text = F.concat(cut(1, 2), F.lit("/"), cut(4, 2), F.lit("/"), cut(7, 4), F.lit(" "), cut(12, 2), F.lit(":"), cut(15, 2), F.lit(":"), cut(18, 2))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    ts = F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz")
    keep = [c for c in ("src_file", "src_order") if c in raw.columns]
    typed = raw.select(
        strip(F.col("mmsi")).alias("mmsi"),
        "timestamp_str",
        epoch_seconds(ts).alias("ts_s"),
        strip(F.col("mobile")).alias("mobile"),
        "ship_type",
        number("lat_text").alias("lat"),
        number("lon_text").alias("lon"),
        number("sog_text").alias("sog"),
        number("draught_text").alias("draught"),
        (~blank("sog_text") & number("sog_text").isNull()).alias("sog_bad"),
        (~blank("draught_text") & number("draught_text").isNull()).alias("draught_bad"),
        *keep,
    )
    return computed(typed)
