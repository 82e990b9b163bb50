"""Vessel pairs that stay close: spatial pairs, joint presence, streaks and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.config import DEFAULT, Thresholds
from tracklens.functions import haversine_m, round_stable


def _distance(a: str, b: str) -> Column:
    return haversine_m(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))


def close_sightings(cand: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Pairs (mmsi1 < mmsi2) at most ``loiter_dist_m`` apart in the same second.

    An equi-join on second and grid cell; one side also looks at the eight cells
    around its own. A cell is at least 904 m wide below 66 degrees, so no pair is lost.
    """
    cell = lambda c: F.floor(F.col(c) / t.grid_deg)
    near = [F.struct((cell("lat") + i).alias("y"), (cell("lon") + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    a = cand.withColumn("at", F.explode(F.array(*near))).select("*", F.col("at.y").alias("gy"), F.col("at.x").alias("gx")).drop("at").alias("a")
    b = cand.withColumns({"gy": cell("lat"), "gx": cell("lon")}).alias("b")
    same = (F.col("a.ts_s") == F.col("b.ts_s")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.mmsi") < F.col("b.mmsi"))
    return a.join(b, same & (_distance("a", "b") <= t.loiter_dist_m)).select(F.col("a.mmsi").alias("mmsi1"), F.col("b.mmsi").alias("mmsi2"), F.col("a.ts_s").alias("ts_s"), F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon")).dropDuplicates(["mmsi1", "mmsi2", "ts_s"])


def joint_presence(cand: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """For pairs that were ever close: every second in which both are candidates, and whether they are close."""
    pairs = close_sightings(cand, t).select("mmsi1", "mmsi2").distinct().alias("p")
    a, b = cand.alias("a"), cand.alias("b")
    both = pairs.join(a, F.col("p.mmsi1") == F.col("a.mmsi")).join(b, (F.col("p.mmsi2") == F.col("b.mmsi")) & (F.col("a.ts_s") == F.col("b.ts_s")))
    return both.groupBy("p.mmsi1", "p.mmsi2", "a.ts_s").agg(F.bool_or(_distance("a", "b") <= t.loiter_dist_m).alias("is_close"))


def _streaks(cand: DataFrame, t: Thresholds) -> DataFrame:
    pair = Window.partitionBy("mmsi1", "mmsi2")
    breaks = F.sum(F.when(F.col("is_close"), 0).otherwise(1)).over(pair.orderBy("ts_s").rowsBetween(Window.unboundedPreceding, 0))
    jp = joint_presence(cand, t).withColumn("grp", breaks).withColumn("last_grp", F.max("grp").over(pair)).filter("is_close")
    start = jp.withColumn("start_s", F.min("ts_s").over(Window.partitionBy("mmsi1", "mmsi2", "grp")))
    crossed = F.col("ts_s") - F.col("start_s") > t.loiter_hours * 3600
    return start.groupBy("mmsi1", "mmsi2", "grp").agg(F.min("start_s").alias("ts_start"), F.min(F.when(crossed, F.col("ts_s"))).alias("ts_end"), F.max(F.col("grp") == F.col("last_grp")).alias("alive"))


def _drift_streaks(cand: DataFrame, t: Thresholds) -> DataFrame:
    close = close_sightings(cand, t)
    snaps = cand.groupBy("ts_s").agg(F.count("*").alias("n")).filter("n >= 2").select("ts_s", F.floor(F.col("ts_s") / 86400).alias("day"))
    # The snapshot before each one: by day, and over one row a day for the first of a day.
    days = snaps.groupBy("day").agg(F.max("ts_s").alias("last_s")).withColumn("before_s", F.lag("last_s").over(Window.orderBy("day"))).select("day", "before_s")
    snaps = snaps.join(days, "day").select("ts_s", F.coalesce(F.lag("ts_s").over(Window.partitionBy("day").orderBy("ts_s")), "before_s").alias("prev_snap"))
    pair = Window.partitionBy("mmsi1", "mmsi2").orderBy("ts_s")
    seen = close.join(snaps, "ts_s", "left").withColumn("last_seen", F.lag("ts_s").over(pair))
    cut = F.when(F.col("prev_snap") - F.col("last_seen") > t.session_timeout_h * 3600, 1).otherwise(0)
    seen = seen.withColumn("grp", F.sum(cut).over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("mmsi1", "mmsi2", "grp").orderBy("ts_s")
    first = lambda c: F.first(c).over(island)
    seen = seen.withColumns({"start_s": first("ts_s"), "lat0": first("lat"), "lon0": first("lon")})
    drift = F.max(haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))).over(island.rowsBetween(Window.unboundedPreceding, 0))
    seen = seen.withColumn("drift", drift)
    crossed = (F.col("ts_s") - F.col("start_s") > t.loiter_hours * 3600) & (F.col("drift") > t.drift_m)
    return seen.groupBy("mmsi1", "mmsi2", "grp").agg(F.min("start_s").alias("ts_start"), F.min(F.when(crossed, F.col("ts_s"))).alias("ts_end"), F.lit(True).alias("alive"))


def encounters(cand: DataFrame, mode: str = "presence", t: Thresholds = DEFAULT) -> DataFrame:
    """One row per streak that lasted over ``loiter_hours``, ending where it first did.

    ``presence``: a streak ends when both are present and not close; ``drift``: when
    the pair is unseen for ``session_timeout_h``, and it must also have moved.
    ``alive`` tells whether the streak counts towards B.
    """
    found = {"presence": _streaks, "drift": _drift_streaks}[mode](cand, t).filter(F.col("ts_end").isNotNull())
    return found.select("mmsi1", "mmsi2", "ts_start", "ts_end", round_stable((F.col("ts_end") - F.col("ts_start")) / 3600.0, 2).alias("duration_h"), "alive")


def b_counts(found: DataFrame) -> DataFrame:
    """Number of counted encounters of each vessel."""
    return found.filter("alive").select(F.explode(F.array("mmsi1", "mmsi2")).alias("mmsi")).groupBy("mmsi").agg(F.count("*").alias("B"))


def run_loiter(cand: DataFrame, mode: str = "presence", t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Events and counts from candidates alone."""
    found = encounters(cand, mode, t)
    return found.drop("alive"), b_counts(found)
