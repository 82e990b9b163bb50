"""The whole batch job: CSV in, events, encounters, scores and metadata out."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tracklens.config import DEFAULT, Thresholds
from tracklens.functions import format_ts
from tracklens.operators import detect, encounters, ingest, score
from tracklens.operators.segments import segments
from tracklens.sources import ais, outputs, sinks


def readable(df: DataFrame) -> DataFrame:
    """Epoch seconds as dd/MM/yyyy HH:mm:ss, for reports."""
    return df.withColumns({c: format_ts(df[c]) for c in ("ts_start", "ts_end") if c in df.columns})


def run_pipeline(spark: SparkSession, glob: str, out: str, *, mode: str = "presence", scope: str = "global", lenient_ts: bool = False, columns: list[str] | None = None, limit: int | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """Run all stages; returns the scores as read back.

    Each stage that has more than one consumer is written once as Parquet and read
    again, so that a lost executor costs one stage at most. ``limit`` caps the accepted pings.
    """
    began, clock = datetime.now(timezone.utc), time.time()
    raw = ais.parse(ais.read_ais(spark, glob, file_order=scope == "file", columns=columns), lenient_ts=lenient_ts)
    points = ingest.downsample(ingest.clean_pings(raw, t, limit=limit), scope=scope, t=t).drop("src_file", "src_order")
    sinks.write_clean(points, f"{out}/clean_pings")
    points = outputs.read_clean(spark, f"{out}/clean_pings").drop("event_date")
    sinks.write_parquet(segments(points, t), f"{out}/segments")
    seg = spark.read.parquet(f"{out}/segments")
    sinks.write_csv(readable(detect.all_events(seg)), f"{out}/all_anomaly_events")
    detected = time.time()
    cand = detect.loiter_candidates(seg)
    sinks.write_parquet(encounters.encounters(cand, mode, t), f"{out}/encounters")
    found = spark.read.parquet(f"{out}/encounters")
    sinks.write_csv(readable(found.drop("alive")), f"{out}/loitering_events")
    b = encounters.b_counts(found)
    sinks.write_csv(b, f"{out}/loitering_aggregates")
    loitered = time.time()
    sinks.write_parquet(score.vessel_scores(seg, b), f"{out}/scores")
    scores = spark.read.parquet(f"{out}/scores")
    sinks.write_csv(scores.orderBy(scores.DFSI.desc(), "mmsi"), f"{out}/vessel_scores")
    sinks.write_csv(score.top_vessels(scores, t), f"{out}/top_vessels")
    sinks.write_metadata(spark, f"{out}/run_metadata.json", {
        "run_start": began.isoformat(), "data_glob": glob, "num_workers": spark.sparkContext.defaultParallelism, "num_shards": raw.rdd.getNumPartitions(),
        "detect_seconds": round(detected - clock, 2), "loiter_seconds": round(loitered - detected, 2), "run_end": datetime.now(timezone.utc).isoformat(),
        "total_seconds": round(time.time() - clock, 2), "vessels_scored": scores.count(),
    })
    return scores
