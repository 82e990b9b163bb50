"""The engine's queries over the driver's tables, each with a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions import haversine_m, hours_between, knots, round_stable
from tracklens.operators import detect, encounters, ingest, inspect, score
from tracklens.operators.segments import first_last_ping, segment_metrics, segments
from tracklens.plans.pipeline import readable, run_pipeline
from tracklens.sources import ais, outputs, sinks
from tracklens.sources.fixture import drifting, faulty_pings, raw_pings
from tracklens.sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]


def _clean(s: SparkSession, d: str) -> DataFrame:
    return ingest.clean_pings(raw_pings(s, d))


def _points(s: SparkSession, d: str) -> DataFrame:
    return ingest.downsample(_clean(s, d))


def _seg(s: SparkSession, d: str) -> DataFrame:
    return segments(_points(s, d))


def _cand(s: SparkSession, d: str) -> DataFrame:
    return detect.loiter_candidates(_seg(s, d))


def _found(s: SparkSession, d: str, mode: str = "presence") -> DataFrame:
    return encounters.encounters(_cand(s, d), mode)


def _scores(s: SparkSession, d: str) -> DataFrame:
    seg = _seg(s, d)
    return score.vessel_scores(seg, encounters.b_counts(encounters.encounters(detect.loiter_candidates(seg))))


def _top1(s: SparkSession, d: str) -> DataFrame:
    return score.top_vessels(_scores(s, d)).orderBy(F.desc("DFSI"), "mmsi").limit(1)


def _geo(s: SparkSession, d: str) -> DataFrame:
    """The scalar functions over every ping and a fixed place."""
    p = raw_pings(s, d).select("seq", "ts_s", "lat", "lon", "sog")
    dist, h = haversine_m(F.lit(55.0), F.lit(10.0), F.col("lat"), F.col("lon")), hours_between(F.lit(1704067200), F.col("ts_s"))
    return p.select("seq", dist.alias("dist_m"), h.alias("hours"), round_stable(knots(dist, h + 1), 2).alias("speed_knots"), F.floor(F.col("ts_s") / 120).alias("bucket"), round_stable(dist / 1852.0, 3).alias("dist_nm"))


def _pipeline_totals(s: SparkSession, d: str) -> DataFrame:
    clean, points, seg = _clean(s, d), _points(s, d), _seg(s, d)
    return inspect.stage_totals(clean=clean, points=points, events=detect.all_events(seg), candidates=detect.loiter_candidates(seg), scored=_scores(s, d))


def _csv(s: SparkSession, d: str) -> str:
    """The faulty projection as CSV files in the shared folder, as a source that was found."""
    path = scratch(s, "csv")
    faulty_pings(s, d).write.option("header", True).csv(path)
    return f"{path}/*.csv"


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return ais.parse(ais.read_ais(s, _csv(s, d)))


def _csv_events(s: SparkSession, d: str) -> DataFrame:
    """Events of CSV input, written as CSV and read back."""
    path = scratch(s, "events")
    sinks.write_csv(readable(detect.all_events(segments(ingest.downsample(ingest.clean_pings(_parsed(s, d)))))), path)
    return outputs.read_events(s, path)


def _job_scores(s: SparkSession, d: str) -> DataFrame:
    """The whole job over CSV files; its score file read back."""
    out = scratch(s, "job")
    run_pipeline(s, _csv(s, d), out)
    return outputs.read_scores(s, f"{out}/vessel_scores")


def _merged(s: SparkSession, d: str) -> DataFrame:
    seg = _seg(s, d)
    of = lambda k, df: df.withColumn("anomaly", F.lit(k))
    return sinks.merge_events(of("A", detect.going_dark(seg)), of("C", detect.draught_change(seg)), of("D", detect.teleport(seg)))


def _longest_points(s: SparkSession, d: str) -> DataFrame:
    return inspect.encounter_segment(_points(s, d), inspect.longest_encounter(_found(s, d)))


QUERIES: dict[str, Query] = {
    "geo_functions": _geo,
    "clean_pings": _clean,
    "rejects_by_reason": lambda s, d: ingest.rejects_by_reason(raw_pings(s, d)),
    "downsample_2min": _points,
    "segments_metrics": lambda s, d: segment_metrics(_seg(s, d)),
    "going_dark": lambda s, d: detect.going_dark(_seg(s, d)),
    "draught_change": lambda s, d: detect.draught_change(_seg(s, d)),
    "teleport": lambda s, d: detect.teleport(_seg(s, d)),
    "all_events": lambda s, d: detect.all_events(_seg(s, d)),
    "first_last_ping": lambda s, d: first_last_ping(_points(s, d)),
    "loiter_candidates": _cand,
    "close_pairs": lambda s, d: encounters.close_sightings(_cand(s, d)).select("mmsi1", "mmsi2", "ts_s"),
    "joint_presence": lambda s, d: encounters.joint_presence(_cand(s, d)),
    "encounters": _found,
    "b_counts": lambda s, d: encounters.b_counts(_found(s, d)),
    "encounters_drift": lambda s, d: encounters.encounters(drifting(_cand(s, d)), "drift"),
    "vessel_counts": lambda s, d: score.vessel_counts(_seg(s, d)),
    "vessel_scores": _scores,
    "top_vessels": lambda s, d: score.top_vessels(_scores(s, d)),
    "daily_file_spread": lambda s, d: inspect.daily_spread(_clean(s, d)),
    "spread_summary": lambda s, d: inspect.spread_summary(inspect.daily_spread(_clean(s, d))),
    "sog_histogram": lambda s, d: inspect.sog_histogram(_points(s, d)),
    "stage_totals": _pipeline_totals,
    "top_vessel_track": lambda s, d: inspect.decimate(inspect.vessel_track(_clean(s, d), _top1(s, d))),
    "track_overlay": lambda s, d: inspect.track_overlay(detect.all_events(_seg(s, d)), _top1(s, d)),
    "track_centroid": lambda s, d: inspect.track_centroid(_points(s, d)),
    "longest_encounter": lambda s, d: inspect.longest_encounter(_found(s, d)).drop("alive"),
    "longest_encounter_segment": _longest_points,
    "segment_centre": lambda s, d: inspect.segment_centre(_longest_points(s, d), _points(s, d)),
    "encounters_of_vessel": lambda s, d: inspect.encounters_of(_found(s, d), "219000016").drop("alive"),
    "first_jumps": lambda s, d: inspect.first_jumps(detect.all_events(_seg(s, d))),
    "merged_events": _merged,
    "map_features": lambda s, d: sinks.point_features(_cand(s, d), "mmsi", "ts_s"),
    "csv_clean_pings": lambda s, d: ingest.clean_pings(_parsed(s, d)),
    "csv_rejects_by_reason": lambda s, d: ingest.rejects_by_reason(_parsed(s, d)),
    "csv_quarantined_draught": lambda s, d: ingest.quarantined_draught(_parsed(s, d)),
    "csv_events": _csv_events,
    "job_scores": _job_scores,
}

_HAV = "2 * 6371000e0 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return _HAV.format(a=a, b=b, c=c, d=d)


def _r(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n} + 0.5e0) / 1e{n}"


_CTE = {
    "raw": """SELECT event_id AS seq,
      CASE WHEN event_id % 97 = 0 THEN '111111111' WHEN event_id % 193 = 0 THEN '000000000' WHEN event_id % 389 = 0 THEN '12345' ELSE CAST(219000000 + user_id AS VARCHAR) END AS mmsi,
      CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 3600 AS ts_s,
      CASE WHEN event_id % 101 = 0 THEN 'Class B' ELSE 'Class A' END AS mobile,
      CASE WHEN event_id % 103 = 0 THEN ' Tug ' WHEN event_id % 107 = 0 THEN 'SAR' WHEN event_id % 109 = 0 THEN NULL WHEN event_id % 113 = 0 THEN 'Towing long/wide' ELSE 'Cargo' END AS ship_type,
      CASE WHEN event_id % 127 = 0 THEN 70e0 WHEN event_id % 131 = 0 THEN 0e0 ELSE CAST(51500000 + (user_id - user_id % 2) // 2 % 100 * 100000 + event_id % 7 * 300 + CASE WHEN event_type = 'error' THEN 3000000 ELSE 0 END AS DOUBLE) / 1e6 END AS lat,
      CASE WHEN event_id % 137 = 0 THEN 0e0 ELSE CAST(4000000 + (user_id - user_id % 2) // 2 % 50 * 400000 AS DOUBLE) / 1e6 END AS lon,
      CASE WHEN event_id % 139 = 0 THEN 61e0 WHEN event_id % 149 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0e0 ELSE CAST(1 + event_id % 9 AS DOUBLE) / 1e1 END AS sog,
      CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(50 + event_id % 5 * 2 AS DOUBLE) / 1e1 END AS draught FROM events""",
    "judged": """SELECT *, CASE WHEN NOT regexp_full_match(mmsi, '[1-9][0-9]{8}') THEN 'mmsi_format' WHEN mmsi IN ('000000000', '111111111', '123456789') THEN 'mmsi_dirty'
      WHEN starts_with(mmsi, '111') THEN 'mmsi_prefix' WHEN mobile <> 'Class A' THEN 'mobile_type' WHEN lower(trim(coalesce(ship_type, ''))) IN ('tug', 'towing', 'sar') THEN 'ship_type'
      WHEN lat = 0 OR lon = 0 THEN 'position_zero' WHEN NOT (lat BETWEEN 51 AND 66 AND lon BETWEEN -5 AND 30) THEN 'position_area' WHEN sog > 60 THEN 'sog' END AS reason FROM raw""",
    "clean": "SELECT seq, mmsi, ts_s, lat, lon, coalesce(sog, 0e0) AS sog, coalesce(draught, 0e0) AS draught FROM judged WHERE reason IS NULL",
    "points": "SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY mmsi, ts_s // 120 ORDER BY ts_s, seq) = 1",
    "lagged": "SELECT *, lag(ts_s) OVER w AS ts0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(draught) OVER w AS d0 FROM points WINDOW w AS (PARTITION BY mmsi ORDER BY ts_s, seq)",
    "measured": f"SELECT *, (ts_s - ts0) / 3600e0 AS h, {_hav('lat0', 'lon0', 'lat', 'lon')} AS dist FROM lagged",
    "sped": "SELECT *, CASE WHEN h > 0 THEN dist / 1852e0 / h END AS v FROM measured",
    "seg": """SELECT *, coalesce(h > 4 AND dist > 1852 AND v > 0.5e0, false) AS fa, coalesce(d0 > 0 AND draught > 0 AND h >= 2 AND abs(draught - d0) / nullif(d0, 0) > 0.05e0, false) AS fc,
      coalesce(h > 0 AND v > 60, false) AS fd, coalesce(h > 0 AND sog > 0 AND v < 1, false) AS fb FROM sped""",
    "ev_a": f"SELECT mmsi, ts0 AS ts_start, ts_s AS ts_end, lat0 AS lat_start, lon0 AS lon_start, lat AS lat_end, lon AS lon_end, {_r('h', 2)} AS gap_hours, {_r('dist', 1)} AS dist_m, {_r('v', 2)} AS speed_knots FROM seg WHERE fa",
    "ev_c": f"SELECT mmsi, ts0 AS ts_start, ts_s AS ts_end, lat0 AS lat_start, lon0 AS lon_start, lat AS lat_end, lon AS lon_end, d0 AS draught_before, draught AS draught_after, {_r('abs(draught - d0) / d0 * 100', 2)} AS change_pct FROM seg WHERE fc",
    "ev_d": f"SELECT mmsi, ts0 AS ts_start, ts_s AS ts_end, lat0 AS lat_start, lon0 AS lon_start, lat AS lat_end, lon AS lon_end, {_r('v', 1)} AS speed_knots, {_r('dist', 1)} AS dist_m, {_r('h', 4)} AS hours FROM seg WHERE fd",
    "ev": """SELECT 'A' AS anomaly, mmsi, ts_start, ts_end, lat_start, lon_start, lat_end, lon_end, gap_hours, dist_m, speed_knots, CAST(NULL AS DOUBLE) AS hours, CAST(NULL AS DOUBLE) AS draught_before, CAST(NULL AS DOUBLE) AS draught_after, CAST(NULL AS DOUBLE) AS change_pct FROM ev_a
      UNION ALL SELECT 'C', mmsi, ts_start, ts_end, lat_start, lon_start, lat_end, lon_end, NULL, NULL, NULL, NULL, draught_before, draught_after, change_pct FROM ev_c
      UNION ALL SELECT 'D', mmsi, ts_start, ts_end, lat_start, lon_start, lat_end, lon_end, NULL, dist_m, speed_knots, hours, NULL, NULL, NULL FROM ev_d""",
    "cand": "SELECT mmsi, lat, lon, ts_s FROM seg WHERE fb",
    "sight": f"SELECT DISTINCT a.mmsi AS mmsi1, b.mmsi AS mmsi2, a.ts_s, a.lat, a.lon FROM cand a JOIN cand b ON a.ts_s = b.ts_s AND a.mmsi < b.mmsi AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500",
    "jp": f"SELECT p.mmsi1, p.mmsi2, a.ts_s, bool_or({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500) AS is_close FROM (SELECT DISTINCT mmsi1, mmsi2 FROM sight) p JOIN cand a ON a.mmsi = p.mmsi1 JOIN cand b ON b.mmsi = p.mmsi2 AND b.ts_s = a.ts_s GROUP BY ALL",
    "grouped": "SELECT *, sum(CASE WHEN is_close THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi1, mmsi2 ORDER BY ts_s ROWS UNBOUNDED PRECEDING) AS grp FROM jp",
    "streak": "SELECT *, min(ts_s) OVER (PARTITION BY mmsi1, mmsi2, grp) AS s0 FROM (SELECT *, max(grp) OVER (PARTITION BY mmsi1, mmsi2) AS last_grp FROM grouped) WHERE is_close",
    "enc": f"SELECT mmsi1, mmsi2, min(s0) AS ts_start, min(ts_s) AS ts_end, {_r('(min(ts_s) - min(s0)) / 3600e0', 2)} AS duration_h, bool_or(grp = last_grp) AS alive FROM streak WHERE ts_s - s0 > 7200 GROUP BY mmsi1, mmsi2, grp",
    "b": "SELECT mmsi, count(*) AS B FROM (SELECT mmsi1 AS mmsi FROM enc WHERE alive UNION ALL SELECT mmsi2 FROM enc WHERE alive) GROUP BY mmsi",
    "per": f"""SELECT mmsi, count(*) FILTER (fa) AS A, count(*) FILTER (fc) AS C, count(*) FILTER (fd) AS D, count(*) AS points, coalesce(max({_r('h', 2)}) FILTER (fa), 0e0) AS max_gap_hours,
      coalesce(CAST(sum(CAST(CASE WHEN fd THEN {_r('dist', 1)} END AS DECIMAL(18, 1))) AS DOUBLE), 0e0) / 1852e0 AS total_dist_nm FROM seg GROUP BY mmsi""",
    "scores": f"SELECT per.mmsi, A, coalesce(B, 0) AS B, C, D, {_r('max_gap_hours / 2 + total_dist_nm / 10 + C * 15e0', 2)} AS DFSI, points, max_gap_hours, total_dist_nm FROM per LEFT JOIN b ON per.mmsi = b.mmsi",
    "top1": "SELECT mmsi FROM scores ORDER BY DFSI DESC, mmsi LIMIT 1",
    "longest": "SELECT mmsi1, mmsi2, ts_start, ts_end, duration_h FROM enc ORDER BY duration_h DESC, mmsi1, mmsi2, ts_start LIMIT 1",
    "snaps": "SELECT ts_s, lag(ts_s) OVER (ORDER BY ts_s) AS prev_snap FROM (SELECT ts_s FROM cand GROUP BY ts_s HAVING count(*) >= 2)",
    "dseen": "SELECT s.*, prev_snap, lag(s.ts_s) OVER (PARTITION BY mmsi1, mmsi2 ORDER BY s.ts_s) AS last_seen FROM sight s LEFT JOIN snaps ON s.ts_s = snaps.ts_s",
    "disl": "SELECT *, sum(CASE WHEN prev_snap - last_seen > 0.33e0 * 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi1, mmsi2 ORDER BY ts_s ROWS UNBOUNDED PRECEDING) AS grp FROM dseen",
    "dfirst": "SELECT *, first_value(ts_s) OVER w AS s0, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0 FROM disl WINDOW w AS (PARTITION BY mmsi1, mmsi2, grp ORDER BY ts_s)",
    "drift": f"SELECT *, max({_hav('lat0', 'lon0', 'lat', 'lon')}) OVER (PARTITION BY mmsi1, mmsi2, grp ORDER BY ts_s ROWS UNBOUNDED PRECEDING) AS drift FROM dfirst",
}


def _sql(body: str, **other: str) -> str:
    """The chain of relations, with ``other`` in place of some, and a query over it."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in (_CTE | other).items()) + f"\n{body}"


#: Text faults of the CSV input, and the two rules that only they break.
_FAULTY = f"""SELECT seq, CASE WHEN seq % 173 = 0 THEN '111222333' ELSE mmsi END AS mmsi, CASE WHEN seq % 151 <> 0 THEN ts_s END AS ts_s, mobile, ship_type, CASE WHEN seq % 157 <> 0 THEN lat END AS lat, lon,
  CASE WHEN seq % 163 <> 0 THEN sog ELSE 99e0 END AS sog, CASE WHEN seq % 167 <> 0 THEN draught END AS draught, seq % 167 = 0 AS draught_bad FROM ({_CTE["raw"]})"""
_CSV = {
    "raw": _FAULTY,
    "judged": _CTE["judged"].replace("WHEN mobile <>", "WHEN ts_s IS NULL THEN 'timestamp' WHEN mobile <>").replace("WHEN lat = 0", "WHEN lat IS NULL THEN 'position_missing' WHEN lat = 0"),
    "points": _CTE["points"].replace("ts_s, seq", "ts_s, lat, lon, sog, draught"),  # files have no number of a row
}
_DAILY = f"""SELECT mmsi, min(lat) + CAST(ts_s // 86400 % 32 AS DOUBLE) / 1e2 AS lat, min(lon) AS lon, ts_s // 86400 * 86400 AS ts_s FROM ({_CTE["cand"]}) GROUP BY mmsi, ts_s // 86400"""
_LONGEST_POINTS = "SELECT p.mmsi, ts_s, lat, lon, sog FROM points p JOIN (SELECT unnest([mmsi1, mmsi2]) AS mmsi, ts_start, ts_end FROM longest) e ON p.mmsi = e.mmsi AND ts_s BETWEEN ts_start AND ts_end"


_DECIMATED = """SELECT seq, t.mmsi, ts_s, lat, lon, sog, draught, CASE WHEN sog < 1 THEN 'red' ELSE 'blue' END AS colour, i,
  CASE WHEN i = 0 THEN 'start' WHEN i = n - 1 THEN 'end' ELSE 'dot' END AS mark
  FROM (SELECT c.*, row_number() OVER (ORDER BY ts_s, seq) - 1 AS i, count(*) OVER () AS n FROM clean c JOIN top1 ON c.mmsi = top1.mmsi) t
  WHERE i = 0 OR i = n - 1 OR (i >= greatest(1, n // 20) AND i < n - greatest(1, n // 20) AND i % greatest(1, n // 20) = 0)"""


def _totals(name: str, table: str) -> str:
    return f"SELECT '{name}' AS stage, count(*) AS n_rows, count(DISTINCT mmsi) AS n_vessels FROM {table}"


ORACLE: dict[str, str] = {
    "geo_functions": _sql(f"""SELECT seq, dist AS dist_m, h AS hours, {_r('CASE WHEN h + 1 > 0 THEN dist / 1852e0 / (h + 1) ELSE 1e0 / 0 END', 2)} AS speed_knots, ts_s // 120 AS bucket, {_r('dist / 1852e0', 3)} AS dist_nm
      FROM (SELECT *, {_hav('55e0', '10e0', 'lat', 'lon')} AS dist, (ts_s - 1704067200) / 3600e0 AS h FROM raw)"""),
    "clean_pings": _sql("SELECT * FROM clean"),
    "rejects_by_reason": _sql("SELECT reason, count(*) AS n_rows FROM judged WHERE reason IS NOT NULL GROUP BY reason"),
    "downsample_2min": _sql("SELECT * FROM points"),
    "segments_metrics": _sql("SELECT mmsi, ts0 AS ts_start, ts_s AS ts_end, h AS hours, dist AS dist_m, v AS speed_knots FROM seg WHERE ts0 IS NOT NULL"),
    "going_dark": _sql("SELECT * FROM ev_a"),
    "draught_change": _sql("SELECT * FROM ev_c"),
    "teleport": _sql("SELECT * FROM ev_d"),
    "all_events": _sql("SELECT * FROM ev"),
    "first_last_ping": _sql("""SELECT mmsi, boundary, ts_s, lat, lon, draught, sog FROM (
      SELECT *, 'first' AS boundary FROM points QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts_s, seq) = 1
      UNION ALL SELECT *, 'last' FROM points QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts_s DESC, seq DESC) = 1)"""),
    "loiter_candidates": _sql("SELECT * FROM cand"),
    "close_pairs": _sql("SELECT mmsi1, mmsi2, ts_s FROM sight"),
    "joint_presence": _sql("SELECT * FROM jp"),
    "encounters": _sql("SELECT * FROM enc"),
    "b_counts": _sql("SELECT * FROM b"),
    "encounters_drift": _sql(f"SELECT mmsi1, mmsi2, min(s0) AS ts_start, min(ts_s) AS ts_end, {_r('(min(ts_s) - min(s0)) / 3600e0', 2)} AS duration_h, true AS alive FROM drift WHERE ts_s - s0 > 7200 AND drift > 500 GROUP BY mmsi1, mmsi2, grp", cand=_DAILY),
    "vessel_counts": _sql("SELECT mmsi, A, C, D, points FROM per"),
    "vessel_scores": _sql("SELECT * FROM scores"),
    "top_vessels": _sql("SELECT * FROM scores ORDER BY DFSI DESC, mmsi LIMIT 10"),
    "daily_file_spread": _sql("SELECT mmsi, count(DISTINCT ts_s // 86400) AS n_days, count(*) AS n_rows FROM clean GROUP BY mmsi"),
    "spread_summary": _sql("SELECT count(*) AS vessels, count(*) FILTER (n_days > 1) AS multi_day, max(n_days) AS max_days FROM (SELECT mmsi, count(DISTINCT ts_s // 86400) AS n_days FROM clean GROUP BY mmsi)"),
    "sog_histogram": _sql("SELECT mmsi, sog, n_rows, n_rows * 100e0 / sum(n_rows) OVER (PARTITION BY mmsi) AS percent FROM (SELECT mmsi, sog, count(*) AS n_rows FROM points GROUP BY mmsi, sog)"),
    "stage_totals": _sql(" UNION ALL ".join(_totals(*x) for x in (("clean", "clean"), ("points", "points"), ("events", "ev"), ("candidates", "cand"), ("scored", "scores")))),
    "top_vessel_track": _sql(_DECIMATED),
    "track_overlay": _sql("SELECT ev.*, CASE anomaly WHEN 'A' THEN 'red' WHEN 'D' THEN 'purple' ELSE 'orange' END AS colour FROM ev JOIN top1 ON ev.mmsi = top1.mmsi WHERE lat_start IS NOT NULL"),
    "track_centroid": _sql("SELECT mmsi, CAST(sum(CAST(round(lat * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS lat, CAST(sum(CAST(round(lon * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS lon, count(*) AS points FROM points GROUP BY mmsi"),
    "longest_encounter": _sql("SELECT * FROM longest"),
    "longest_encounter_segment": _sql(_LONGEST_POINTS),
    "segment_centre": _sql(f"""SELECT lat, lon FROM (SELECT * FROM (SELECT 0 AS p, lat, lon FROM ({_LONGEST_POINTS}) ORDER BY ts_s, mmsi LIMIT 1)
      UNION ALL SELECT * FROM (SELECT 1, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts_s) - 1 AS i, count(*) OVER (PARTITION BY mmsi) AS n FROM points) WHERE i = n // 2 ORDER BY mmsi LIMIT 1)) ORDER BY p LIMIT 1"""),
    "encounters_of_vessel": _sql("SELECT mmsi1, mmsi2, ts_start, ts_end, duration_h FROM enc WHERE mmsi1 = '219000016' OR mmsi2 = 'VESSEL'"),
    "first_jumps": _sql("SELECT * FROM ev WHERE anomaly = 'D' ORDER BY ts_start, mmsi, ts_end LIMIT 10"),
    "merged_events": _sql("SELECT * FROM ev"),
    "map_features": _sql("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat || ']},"properties":{"mmsi":"' || mmsi || '","ts_s":' || ts_s || '}}' AS feature FROM cand"""),
    "csv_clean_pings": _sql("SELECT mmsi, ts_s, lat, lon, sog, draught FROM clean", **_CSV),
    "csv_rejects_by_reason": _sql("SELECT reason, count(*) AS n_rows FROM judged WHERE reason IS NOT NULL GROUP BY reason", **_CSV),
    "csv_quarantined_draught": _sql("SELECT count(*) FILTER (draught_bad) AS n_rows FROM raw", **_CSV),
    "csv_events": _sql("SELECT * FROM ev", **_CSV),
    "job_scores": _sql("SELECT * FROM scores", **_CSV),
}
