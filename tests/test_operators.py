import pytest
from pyspark.sql import functions as F

from tracklens.functions import format_ts, haversine_m, hours_between, knots, round_stable
from tracklens.operators import detect, encounters, ingest, inspect, score
from tracklens.operators.segments import first_last_ping, segments

RAW = "mmsi string, ts_s long, mobile string, ship_type string, lat double, lon double, sog double, draught double"
PING = "mmsi string, ts_s long, lat double, lon double, sog double, draught double"
CAND = "mmsi string, lat double, lon double, ts_s long"
T0 = 1765353600  # 10/12/2025 08:00:00
H = 3600


def one(df):
    return df.first()[0]


def test_scalars(spark):
    d = spark.range(1)
    hav = lambda *c: one(d.select(haversine_m(*map(F.lit, c))))
    assert hav(55.0, 10.0, 55.0, 10.0) == 0.0
    assert hav(55.676, 12.568, 55.607, 12.988) == pytest.approx(27451.053227305485, abs=1e-6)
    assert hav(55.0, 10.0, 60.0, 20.0) == pytest.approx(814561.0566315451, abs=1e-6)
    assert one(d.select(hours_between(F.lit(T0), F.lit(T0 + 4 * H)))) == 4.0
    assert one(d.select(knots(F.lit(1852.0), F.lit(1.0)))) == 1.0
    assert one(d.select(knots(F.lit(1852.0), F.lit(0.0)))) == float("inf")
    assert one(d.select(round_stable(F.lit(0.125), 2))) == 0.13
    assert one(d.select(format_ts(F.lit(T0 + 61)))) == "10/12/2025 08:01:01"


GOOD = ("219000001", T0, "Class A", "Cargo", 55.0, 10.0, 5.0, 5.0)


def changed(**kw):
    names = [c.split()[0] for c in RAW.split(", ")]
    return tuple(kw.get(n, v) for n, v in zip(names, GOOD, strict=True))


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        (GOOD, None),
        (changed(mmsi="000000000"), "mmsi_format"),
        (changed(mmsi="123456789"), "mmsi_dirty"),
        (changed(mmsi="111456789"), "mmsi_prefix"),
        (changed(mmsi="219000001\n"), "mmsi_format"),
        (changed(mmsi=None), "mmsi_format"),
        (changed(ts_s=None), "timestamp"),
        (changed(mobile="Class B"), "mobile_type"),
        (changed(mobile="\tClass A "), None),
        (changed(mobile="class a"), "mobile_type"),
        (changed(ship_type=" TUG\t"), "ship_type"),
        (changed(ship_type="Towing long/wide"), None),
        (changed(ship_type=None), None),
        (changed(lat=None), "position_missing"),
        (changed(lon=0.0), "position_zero"),
        (changed(lat=float("nan")), "position_area"),
        (changed(lat=51.0, lon=-5.0), None),
        (changed(lat=66.0, lon=30.0), None),
        (changed(lat=66.01), "position_area"),
        (changed(sog=60.0), None),
        (changed(sog=60.1), "sog"),
        (changed(sog=-1.0), None),
        (changed(sog=None), None),
        (changed(sog=float("nan")), None),
    ],
)
def test_validity(spark, row, reason):
    df = spark.createDataFrame([row], RAW)
    assert ingest.clean_pings(df).count() == (reason is None)
    got = ingest.rejects(df).select("reason").collect()
    assert [r.reason for r in got] == ([reason] if reason else [])


def pings(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else 5.0, r[5] if len(r) > 5 else 0.0) for r in rows], PING)


def test_downsample_keeps_first_of_bucket(spark):
    df = pings(spark, [("a", T0, 55.0, 10.0), ("a", T0 + 90, 55.1, 10.0), ("a", T0 + 120, 55.2, 10.0), ("b", T0 + 90, 56.0, 10.0)])
    assert sorted((r.mmsi, r.lat) for r in ingest.downsample(df).collect()) == [("a", 55.0), ("a", 55.2), ("b", 56.0)]


def seg(spark, *rows):
    return segments(pings(spark, [("a", *r) for r in rows]))


def test_going_dark(spark):
    e = detect.going_dark(seg(spark, (T0, 55.0, 10.0), (T0 + 5 * H, 55.1, 10.1))).collect()
    assert [(r.gap_hours, r.dist_m, r.speed_knots) for r in e] == [(5.0, 12814.8, 1.38)]
    assert detect.going_dark(seg(spark, (T0, 55.0, 10.0), (T0 + 5 * H, 55.0, 10.0))).count() == 0
    assert detect.going_dark(seg(spark, (T0, 55.0, 10.0), (T0 + 4 * H, 55.1, 10.1))).count() == 0
    assert detect.going_dark(seg(spark, (T0, 55.0, 10.0), (T0 + 4 * H + 1, 55.1, 10.1))).count() == 1
    short = seg(spark, (T0, 55.0, 10.0), (T0 + H, 55.5, 10.5))
    assert detect.all_events(short).count() == 0


def test_draught_change(spark):
    e = detect.draught_change(seg(spark, (T0, 55.0, 10.0, 5.0, 10.0), (T0 + 4 * H, 55.0, 10.0, 5.0, 7.0))).collect()
    assert [r.change_pct for r in e] == [30.0]
    hit = lambda d1, d2, gap: detect.draught_change(seg(spark, (T0, 55.0, 10.0, 5.0, d1), (T0 + gap, 55.0, 10.0, 5.0, d2))).count()
    assert hit(10.0, 7.0, 2 * H) == 1 and hit(10.0, 7.0, 2 * H - 1) == 0
    assert hit(10.0, 10.5, 2 * H) == 0 and hit(0.0, 7.0, 2 * H) == 0 and hit(float("nan"), 7.0, 2 * H) == 0


def test_teleport(spark):
    e = detect.teleport(seg(spark, (T0, 55.0, 10.0), (T0 + 60, 60.0, 20.0))).collect()
    assert [(r.speed_knots, r.dist_m, r.hours) for r in e] == [(26389.7, 814561.1, 0.0167)]
    assert detect.teleport(seg(spark, (T0, 55.0, 10.0), (T0, 60.0, 20.0))).count() == 0


def test_loiter_candidates(spark):
    e = detect.loiter_candidates(seg(spark, (T0, 55.0, 10.0, 0.5), (T0 + H, 55.0, 10.0, 5.0))).collect()
    assert [r.ts_s for r in e] == [T0 + H]
    for sog in (0.0, float("nan")):
        assert detect.loiter_candidates(seg(spark, (T0, 55.0, 10.0, 0.5), (T0 + H, 55.0, 10.0, sog))).count() == 0


def test_first_last(spark):
    df = pings(spark, [("a", T0, 55.0, 10.0), ("a", T0 + H, 56.0, 10.0), ("b", T0, 57.0, 10.0)])
    assert sorted((r.mmsi, r.boundary, r.lat) for r in first_last_ping(df).collect()) == [("a", "first", 55.0), ("a", "last", 56.0), ("b", "first", 57.0), ("b", "last", 57.0)]


A, B = "111111112", "222222223"


def met(spark, *rows, mode="presence"):
    return encounters.run_loiter(spark.createDataFrame(list(rows), CAND), mode)


def test_encounter_and_counts(spark):
    far = int(2.0833 * H)
    rows = [(v, 55.0, 10.0, t) for v in (A, B) for t in (T0, T0 + 7500)]
    found, b = met(spark, *rows)
    assert [(r.mmsi1, r.mmsi2, r.duration_h) for r in found.collect()] == [(A, B, 2.08)]
    assert sorted(map(tuple, b.collect())) == [(A, 1), (B, 1)]
    assert far  # two sightings suffice, however long both were absent in between
    assert met(spark, *[(v, 55.0, 10.0, t) for v in (A, B) for t in (T0, T0 + 2 * H)])[0].count() == 0


def test_joint_sighting_apart_ends_a_streak(spark):
    rows = [(v, 55.0, 10.0, t) for v in (A, B) for t in (T0, T0 + 7500)]
    apart = [(A, 55.0, 10.0, T0 + 9000), (B, 55.5, 10.0, T0 + 9000)]
    found, b = met(spark, *rows, *apart)
    assert found.count() == 1 and b.count() == 0
    alone = [(A, 55.0, 10.0, T0 + 3600)]
    assert met(spark, *rows, *alone)[0].count() == 1
    between = [(A, 55.0, 10.0, T0 + 3600), (B, 55.5, 10.0, T0 + 3600)]
    assert met(spark, *rows, *between)[0].count() == 0


def sequential(cand, dist):
    """A plain model of the streak rules, one snapshot after the other."""
    streaks, events = {}, []
    for ts in sorted({c[3] for c in cand}):
        snap = sorted((c for c in cand if c[3] == ts), key=lambda c: c[0])
        close = {(a[0], b[0]) for a in snap for b in snap if a[0] < b[0] and dist(a, b) <= 500}
        here = {c[0] for c in snap}
        for p in close | {p for p in streaks if p[0] in here and p[1] in here}:
            if p not in close:
                del streaks[p]
            elif p not in streaks:
                streaks[p] = [ts, False]
            elif not streaks[p][1] and ts - streaks[p][0] > 7200:
                streaks[p][1] = True
                events.append((*p, streaks[p][0], ts))
    counts = {}
    for p, (_, flagged) in streaks.items():
        for v in p if flagged else ():
            counts[v] = counts.get(v, 0) + 1
    return sorted(events), counts


def test_streaks_equal_a_sequential_model(spark):
    import math
    import random

    rng = random.Random(4)

    def dist(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(s))

    cand = []
    for t in range(60):
        for v in range(6):
            if rng.random() < 0.8:
                cand.append((f"21900000{v}", 55.0 + rng.choice((0, 0, 0, 0.0042, 0.0049)), 10.0, T0 + t * 900))
    found, b = met(spark, *cand)
    events, counts = sequential(cand, dist)
    assert events
    assert sorted((r.mmsi1, r.mmsi2, r.ts_start, r.ts_end) for r in found.collect()) == events
    assert dict(map(tuple, b.collect())) == counts


def test_distance_is_inclusive_and_cells_lose_nothing(spark):
    rows = [(A, 55.0199, 10.0199, T0), (B, 55.0201, 10.0201, T0), ("333333334", 55.0199, 10.03, T0)]
    got = encounters.close_sightings(spark.createDataFrame(rows, CAND)).collect()
    assert {(r.mmsi1, r.mmsi2) for r in got} == {(A, B)}


def test_scores(spark):
    s = segments(pings(spark, [("219000001", T0, 55.0, 10.0, 0.5, 5.0), ("219000001", T0 + 19800, 55.5, 10.5, 0.5, 7.0), ("219000002", T0, 55.0, 10.0)]))
    b = encounters.b_counts(encounters.encounters(detect.loiter_candidates(s)))
    rows = {r.mmsi: r for r in score.top_vessels(score.vessel_scores(s, b)).collect()}
    r = rows["219000001"]
    assert (r.A, r.B, r.C, r.D, r.points, r.max_gap_hours, r.DFSI) == (1, 0, 1, 0, 2, 5.5, 17.75)
    assert rows["219000002"].DFSI == 0.0


def test_partitions_do_not_matter(spark):
    rows = [("219%06d" % (i % 5), T0 + i * 9000, 55.0 + (i * 7 % 13) / 10, 10.0, 5.0, 5.0 + i % 3) for i in range(200)]
    want = None
    for n in (1, 3, 16):
        got = sorted(map(str, detect.all_events(segments(pings(spark, rows).repartition(n))).collect()))
        want = want or got
        assert got == want and got


def test_decimate_marks(spark):
    track = pings(spark, [("a", T0 + i * 120, 55.0, 10.0) for i in range(50)])
    marks = {r.i: r.mark for r in inspect.decimate(track).collect()}
    assert marks == {0: "start", 49: "end"} | {i: "dot" for i in range(2, 48, 2)}


def sequential_drift(cand, dist):
    """A plain model of the drift mode: a pair unseen for too long at the snapshot before starts anew, and must move."""
    streaks, events, before = {}, [], None
    for ts in sorted({c[3] for c in cand}):
        snap = {c[0]: c for c in cand if c[3] == ts}
        if len(snap) < 2:
            continue
        for p in [p for p, s in streaks.items() if before - s["last"] > 0.33 * H]:
            del streaks[p]
        for a, b in ((a, b) for a in snap for b in snap if a < b and dist(snap[a], snap[b]) <= 500):
            s = streaks.setdefault((a, b), {"start": ts, "place": snap[a], "moved": 0, "done": False})
            s["last"], s["moved"] = ts, max(s["moved"], dist(s["place"], snap[a]))
            if not s["done"] and ts - s["start"] > 2 * H and s["moved"] > 500:
                s["done"] = True
                events.append((a, b, s["start"], ts))
        before = ts
    return sorted(events)


def test_drift_equals_a_sequential_model(spark):
    import math
    import random

    rng = random.Random(5)

    def dist(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(s))

    cand = []
    for t in range(120):
        for v in range(6):
            if rng.random() < 0.85 and not 50 < t < 53:
                cand.append((f"21900000{v}", 55.0 + v // 2 * 0.5 + (t // 4 % 9) * 0.001 * (v // 2) + rng.choice((0, 0, 0.003)), 10.0, T0 + t * 900))
    found, _ = met(spark, *cand, mode="drift")
    want = sequential_drift(cand, dist)
    assert len(want) > 1
    assert sorted((r.mmsi1, r.mmsi2, r.ts_start, r.ts_end) for r in found.collect()) == want


def test_no_method_is_too_large_to_be_compiled(spark):
    from tracklens.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        for name in ("clean_pings", "rejects_by_reason", "downsample_2min", "all_events", "encounters", "vessel_scores"):
            plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
            stages = debug.codegenStringSeq(plan).iterator()
            while stages.hasNext():
                assert stages.next()._3().maxMethodCodeSize() < 8000, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_cap_counts_accepted_rows(spark):
    rows = [("000000000" if i % 2 else "219000001", T0 + i, 55.0, 10.0, 1.0, 1.0) for i in range(40)]
    df = pings(spark, rows).selectExpr("*", "'Class A' as mobile", "'Cargo' as ship_type")
    assert ingest.clean_pings(df, limit=15).count() == 15 and ingest.clean_pings(df).count() == 20
