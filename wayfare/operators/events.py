"""Listing, counting and summing up events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.filters import EventFilter
from wayfare.functions.timing import between
from wayfare.operators import dedup
from wayfare.operators.aggregate import in_first_range, within


def listing(events: DataFrame, start: int, end: int, where: EventFilter | None = None) -> DataFrame:
    """Newest first, deduplicated, tags as JSON."""
    rows = dedup.events(events.where(between("timestamp", start, end)))
    rows = rows.where(where.on()) if where else rows
    return rows.withColumn("tags", F.to_json("tags")).orderBy(F.desc("timestamp"), "subject", "name", "source")


def counts(events: DataFrame, start: int, end: int, names: list[str] | None = None) -> DataFrame:
    rows = events.where(between("timestamp", start, end))
    rows = rows if not names else rows.where(F.col("name").isin(names))
    return rows.select(*dedup.EVENT_KEY).distinct().groupBy("subject", "name").agg(F.count("*").alias("count"))


def counts_by_range(events: DataFrame, ranges: DataFrame, names: list[str] | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """(subject, seg_idx, name, count); each event counts in the first range that holds it. Only events within bounds (see
    by_range) are read."""
    rows = within(events if not names else events.where(F.col("name").isin(names)), ranges, bounds)
    keys = rows.select(*dedup.EVENT_KEY).distinct()
    return in_first_range(keys, ranges, dedup.EVENT_KEY).groupBy("subject", "seg_idx", "name").agg(F.count("*").alias("count"))


def summaries(events: DataFrame) -> DataFrame:
    rows = events.select(*dedup.EVENT_KEY).distinct()
    return rows.groupBy("subject", "name").agg(F.count("*").alias("count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
