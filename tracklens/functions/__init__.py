from tracklens.functions.geo import epoch_seconds, format_ts, haversine_m, hours_between, knots, round_stable, strip
from tracklens.functions.plan import computed

__all__ = ["computed", "epoch_seconds", "format_ts", "haversine_m", "hours_between", "knots", "round_stable", "strip"]
