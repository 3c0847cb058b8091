"""What is told about segments: event counts with zeros, and boundary locations filled from the last fix before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import asof


def event_summary(ranges: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """(subject, seg_idx, name, count): each asked name for each segment, 0 where there were none."""
    every = ranges.select("subject", "seg_idx", F.explode(F.array(*map(F.lit, sorted(set(names))))).alias("name"))
    zero = F.lit(0).cast("bigint")
    return every.join(counts, ["subject", "seg_idx", "name"], "left").withColumn("count", F.coalesce("count", zero))


def boundary_locations(ranges: DataFrame, firsts: DataFrame, lasts: DataFrame, signals: DataFrame, names: list[str]) -> DataFrame:
    """(subject, seg_idx, start_lat, start_lon, end_lat, end_lon) of ranges (subject, seg_idx, start, end): the segment's
    first and last location (subject, seg_idx, loc_lat, loc_lon); where that is missing or (0, 0), the last fix at or
    before the boundary; else (0, 0). All boundaries are looked up in one as-of pass."""
    edges = ranges.select("subject", F.col("start").alias("timestamp")).unionByName(ranges.select("subject", F.col("end").alias("timestamp")))
    near = asof.locations_at(signals, edges, names).select("subject", "timestamp", "loc_lat", "loc_lon")

    def side(own: DataFrame, at: str, name: str) -> DataFrame:
        own = own.select("subject", "seg_idx", F.col("loc_lat").alias("_lat"), F.col("loc_lon").alias("_lon")).where("_lat <> 0 OR _lon <> 0")
        met = ranges.select("subject", "seg_idx", F.col(at).alias("timestamp")).join(own, ["subject", "seg_idx"], "left").join(near, ["subject", "timestamp"], "left")
        zero = F.lit(0.0)
        return met.select("subject", "seg_idx", F.coalesce("_lat", "loc_lat", zero).alias(f"{name}_lat"), F.coalesce("_lon", "loc_lon", zero).alias(f"{name}_lon"))

    return side(firsts, "start", "start").join(side(lasts, "end", "end"), ["subject", "seg_idx"])


def daily(ranges: DataFrame, activity: DataFrame, edges: DataFrame, firsts: DataFrame, lasts: DataFrame, signals: DataFrame, names: list[str]) -> DataFrame:
    """(subject, seg_idx, day, n_segments, active_s, start_lat, start_lon, end_lat, end_lon) for each day (ranges, with
    day). The location at a day's start is that of its first segment's start, or else the first one of the day, or else
    the last fix before it; at its end likewise. activity: (subject, day, n_segments, active_s); edges: (subject, day,
    start_lat, start_lon, end_lat, end_lon) of the day's first and last segments; firsts and lasts: (subject, seg_idx,
    loc_lat, loc_lon) of the day's signals."""
    filled = boundary_locations(ranges, firsts, lasts, signals, names)
    out = ranges.select("subject", "seg_idx", "day").join(filled, ["subject", "seg_idx"])
    zero = F.lit(0).cast("bigint")
    out = out.join(activity.select("subject", "day", "n_segments", "active_s"), ["subject", "day"], "left")
    own = edges.select("subject", "day", *[F.col(f"{a}_{b}").alias(f"_{a}_{b}") for a in ("start", "end") for b in ("lat", "lon")])
    out = out.join(own, ["subject", "day"], "left")
    there = lambda a: (F.col(f"_{a}_lat") != 0) | (F.col(f"_{a}_lon") != 0)
    pick = lambda a, b: F.when(there(a), F.col(f"_{a}_{b}")).otherwise(F.col(f"{a}_{b}")).alias(f"{a}_{b}")
    return out.select("subject", "seg_idx", "day", F.coalesce("n_segments", zero).alias("n_segments"), F.coalesce("active_s", zero).alias("active_s"), *[pick(a, b) for a in ("start", "end") for b in ("lat", "lon")])


def day_edges(segments: DataFrame, places: DataFrame, days: DataFrame) -> DataFrame:
    """(subject, day, start_lat, ...): where the day's first segment starts and its last one ends; segments (subject,
    seg_idx, start_us, end_us), places (subject, seg_idx, start_lat, ...). The end of an open segment is not a place."""
    met = segments.join(places, ["subject", "seg_idx"]).join(F.broadcast(days), (F.col("start_us") < F.col("day_end")) & (F.coalesce("end_us", "day_end") > F.col("day_start")))  # at most 33 days
    first, last = F.struct("start_lat", "start_lon"), F.when(F.col("end_us").isNotNull(), F.struct("end_lat", "end_lon"))
    found = met.groupBy("subject", "day").agg(F.min_by(first, "start_us").alias("f"), F.max_by(F.coalesce(last, F.struct(F.lit(0.0).alias("end_lat"), F.lit(0.0).alias("end_lon"))), "start_us").alias("l"))
    return found.select("subject", "day", "f.*", "l.*")
