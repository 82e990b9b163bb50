import json

import pytest

from tracklens.plans.pipeline import run_pipeline
from tracklens.sources import ais, outputs
from tracklens.operators import ingest, detect
from tracklens.streaming.tracks import downsample_stream, stream_events

HEAD = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,SOG,Draught,Ship type\n"
ROWS = [
    "10/12/2025 08:00:00,Class A,219000001,55.0,10.0,x,0.5,5.0,Cargo",
    "10/12/2025 08:01:00,Class A,219000001,55.9,10.0,x,0.5,5.0,Cargo",
    "10/12/2025 13:30:00,Class A,219000001,55.5,10.5,x,0.5,7.0,Cargo",
    "10/12/2025 13:30:00,Class A,219000002,55.5,10.5,x,,deep,",
    "10-12-2025 13:40:00,Class A,219000003,55.5,10.5,x,1,,",
    "10/12/2025 13:40:00,Class A,219000003,55.5,ten,x,1,,",
    "10/12/2025 13:40:00,Class A,219000003,55.5,10.5,x,fast,,",
    "10/12/2025 13:40:00,Class A,219000003,55.5",
]


@pytest.fixture()
def csv(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEAD + "\n".join(ROWS) + "\n")
    return str(tmp_path / "in" / "*.csv")


@pytest.mark.parametrize("scope", ["global", "file"])
def test_end_to_end(spark, csv, tmp_path, scope):
    out = str(tmp_path / "out")
    rows = {r.mmsi: r for r in run_pipeline(spark, csv, out, scope=scope).collect()}
    assert set(rows) == {"219000001", "219000002"}
    r = rows["219000001"]
    assert (r.A, r.C, r.D, r.points, r.max_gap_hours, r.DFSI) == (1, 1, 0, 2, 5.5, 17.75)
    assert outputs.read_clean(spark, f"{out}/clean_pings").count() == 3
    assert sorted(map(str, outputs.read_scores(spark, f"{out}/vessel_scores").collect())) == sorted(map(str, rows.values()))
    assert outputs.read_counts(spark, f"{out}/loitering_aggregates").count() == 0 == outputs.read_encounters(spark, f"{out}/loitering_events").count()
    typed = {e.anomaly: e for e in outputs.read_events(spark, f"{out}/all_anomaly_events").collect()}
    assert (typed["A"].ts_end - typed["A"].ts_start, typed["A"].gap_hours, typed["C"].draught_after) == (19800, 5.5, 7.0)
    events = spark.read.option("header", True).csv(f"{out}/all_anomaly_events").collect()
    assert sorted(e.anomaly for e in events) == ["A", "C"] and events[0].ts_start == "10/12/2025 08:00:00"
    with open(f"{out}/run_metadata.json") as f:
        assert json.load(f)["vessels_scored"] == 2


def test_rejects_and_quarantine(spark, csv):
    parsed = ais.parse(ais.read_ais(spark, csv))
    assert {r.reason: r.n_rows for r in ingest.rejects_by_reason(parsed).collect()} == {"timestamp": 1, "position_missing": 2, "sog": 1}
    assert ingest.quarantined_draught(parsed).first()[0] == 1
    lenient = ais.parse(ais.read_ais(spark, csv), lenient_ts=True)
    assert "timestamp" not in {r.reason for r in ingest.rejects(lenient).collect()}


def test_no_match_raises(spark, tmp_path):
    with pytest.raises(Exception):
        ais.read_ais(spark, str(tmp_path / "none" / "*.csv")).count()


def test_stream_equals_batch(spark, tmp_path):
    schema = "mmsi string, ts_s long, lat double, lon double, sog double, draught double"
    rows = [("219%06d" % (i % 4), 1765353600 + i * 3000, 55.0 + (i * 5 % 7) / 10, 10.0, 5.0, 5.0 + i % 3) for i in range(80)]
    src = str(tmp_path / "src")
    for part in (rows[:40], rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    from tracklens.operators.segments import segments

    want = sorted(map(str, (tuple(r) for r in detect.all_events(segments(spark.createDataFrame(rows, schema))).collect())))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_events(stream).writeStream.format("memory").queryName("ev").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, (tuple(r) for r in spark.table("ev").collect()))) == want and want
    q = downsample_stream(stream).writeStream.format("memory").queryName("ds").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ds").count() == 80
