"""Thresholds of the track pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # The published thresholds, needed for equal results.
    dirty_mmsi: tuple[str, ...] = ("000000000", "111111111", "123456789")
    dirty_prefixes: tuple[str, ...] = ("111",)
    mobile_type: str = "Class A"
    excluded_ship_types: tuple[str, ...] = ("tug", "towing", "sar")
    lat_min: float = 51.0
    lat_max: float = 66.0
    lon_min: float = -5.0
    lon_max: float = 30.0
    max_sog: float = 60.0
    bucket_seconds: int = 120
    dark_gap_h: float = 4.0
    dark_min_dist_m: float = 1852.0
    dark_min_knots: float = 0.5
    draught_gap_h: float = 2.0
    draught_change: float = 0.05
    teleport_knots: float = 60.0
    loiter_knots: float = 1.0
    loiter_dist_m: float = 500.0
    loiter_hours: float = 2.0
    grid_deg: float = 0.02
    drift_m: float = 500.0
    session_timeout_h: float = 0.33
    top_n: int = 10


DEFAULT = Thresholds()
