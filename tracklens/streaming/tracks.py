"""Detectors A, C and D over a stream of clean pings: the last ping of each vessel is the state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklens.config import DEFAULT, Thresholds
from tracklens.operators.detect import all_events
from tracklens.operators.ingest import bucket

PING = "mmsi string, ts_s long, lat double, lon double, sog double, draught double"
PAIR = PING + ", ts_s_prev long, lat_prev double, lon_prev double, draught_prev double"
STATE = "ts_s long, lat double, lon double, draught double"


def downsample_stream(pings: DataFrame, delay: str = "10 minutes", t: Thresholds = DEFAULT) -> DataFrame:
    """The first ping to arrive of each vessel and two-minute bucket; state is dropped behind the watermark."""
    timed = pings.withColumns({"event_time": F.timestamp_seconds("ts_s"), "bucket": bucket(t)})
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["mmsi", "bucket"]).drop("event_time", "bucket")


def _pairs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["ts_s", "lat", "lon"], kind="stable")
    last: tuple[Any, ...] | None = state.get if state.exists else None
    out = []
    for r in rows.itertuples(index=False):
        if last is not None and r.ts_s < last[0]:
            continue  # late: its pair with the ping before it is gone
        out.append((key[0], r.ts_s, r.lat, r.lon, r.sog, r.draught, *(last or (None,) * 4)))
        last = (int(r.ts_s), float(r.lat), float(r.lon), float(r.draught))
    if last is not None:
        state.update(last)
    names = [c.split()[0] for c in PAIR.split(", ")]
    yield pd.DataFrame(out, columns=names).astype({"ts_s_prev": "Int64"})


def stream_segments(pings: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Consecutive pings as they arrive, judged by the same rules as in batch."""
    from tracklens.operators.segments import judge

    paired = pings.select(*(c.split()[0] for c in PING.split(", "))).groupBy("mmsi").applyInPandasWithState(_pairs, PAIR, STATE, "append", GroupStateTimeout.NoTimeout)
    return judge(paired, t)


def stream_events(pings: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return all_events(stream_segments(pings, t))
