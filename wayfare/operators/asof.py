"""As-of lookup of locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.geo import has_fix
from wayfare.operators import dedup
from wayfare.schema import LOCATION

FLOOR_DAYS = 3650


def locations_at(signals: DataFrame, probes: DataFrame, names: list[str]) -> DataFrame:
    """probes (subject, timestamp) with the last fix at or before each: loc_*, loc_ts; null if there is none within ten
    years. One sorted pass over fixes and probes of a subject, linear in both. Rows without a fix are left out before
    the deduplication."""
    fixes = dedup.first_of(signals.where(F.col("name").isin(names) & has_fix()), ["subject", "timestamp"], ["cloud_event_id"])
    fix = F.struct(*LOCATION, F.col("timestamp").alias("loc_ts"))
    rows = fixes.select("subject", "timestamp", fix.alias("fix"), F.lit(0).alias("side"))
    asked = probes.select("subject", "timestamp").distinct().select("subject", "timestamp", F.lit(None).cast(rows.schema["fix"].dataType).alias("fix"), F.lit(1).alias("side"))
    w = W.partitionBy("subject").orderBy("timestamp", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.unionByName(asked).withColumn("fix", F.last("fix", ignorenulls=True).over(w)).where("side = 1")
    near = F.col("fix.loc_ts") >= F.col("timestamp") - F.expr(f"INTERVAL '{FLOOR_DAYS}' DAY")
    return found.withColumn("fix", F.when(near, F.col("fix"))).select("subject", "timestamp", "fix.*")


def location_at(signals: DataFrame, subject: str, us: int, names: list[str]) -> DataFrame:
    """The same for one point of one subject: a filter and a top row."""
    rows = signals.where((F.col("subject") == subject) & F.col("name").isin(names) & has_fix() & (F.col("timestamp") <= F.timestamp_micros(F.lit(us))))
    return rows.orderBy(F.desc("timestamp"), "cloud_event_id").limit(1).select("subject", "timestamp", *LOCATION)
