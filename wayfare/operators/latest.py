"""Latest values, names and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import has_fix
from wayfare.operators import dedup
from wayfare.schema import LOCATION

EPOCH = F.timestamp_micros  # of 0: what stands for no time


def all_latest(signals: DataFrame, names: list[str] | None = None, source: str | None = None) -> DataFrame:
    """(subject, name, timestamp, value_number, value_string, loc_*, loc_ts): the newest value, and, apart from it, the
    newest fix. Fixes are picked after deduplication."""
    rows = dedup.signals(signals, names, source)
    value = F.max_by(F.struct("value_number", "value_string"), "timestamp")
    fix = F.when(has_fix(), F.struct(*LOCATION))
    fix_time = F.when(has_fix(), F.col("timestamp"))
    out = rows.groupBy("subject", "name").agg(F.max("timestamp").alias("timestamp"), value.alias("v"), F.max_by(fix, fix_time).alias("p"), F.max(fix_time).alias("loc_ts"))
    return out.select("subject", "name", "timestamp", "v.*", *[F.coalesce(F.col("p")[c], F.lit(0.0)).alias(c) for c in LOCATION], "loc_ts")


def locations(signals: DataFrame, names: list[str], source: str | None = None) -> DataFrame:
    """The newest fix of each name, stamped with its own time; names without one are absent."""
    found = all_latest(signals, names, source).where(F.col("loc_ts").isNotNull())
    return found.withColumn("timestamp", F.col("loc_ts"))


def last_seen(signals: DataFrame, source: str | None = None) -> DataFrame:
    """(subject, name='lastSeen', timestamp) over all names."""
    rows = signals if source is None else signals.where(F.col("source") == source)
    return rows.groupBy("subject").agg(F.max("timestamp").alias("timestamp")).select("subject", F.lit("lastSeen").alias("name"), "timestamp")


def names(signals: DataFrame, source: str | None = None, known: list[str] | None = None) -> DataFrame:
    rows = signals if source is None else signals.where(F.col("source") == source)
    rows = rows if known is None else rows.where(F.col("name").isin(known))
    return rows.select("subject", "name").distinct()


def summaries(signals: DataFrame, source: str | None = None) -> DataFrame:
    """(subject, name, count, first_seen, last_seen) of distinct times: the key of the deduplication."""
    rows = signals if source is None else signals.where(F.col("source") == source)
    return rows.select(*dedup.SIGNAL_KEY).distinct().groupBy("subject", "name").agg(F.count("*").alias("count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def snapshot(signals: DataFrame, source: str | None = None) -> DataFrame:
    """(subject, name, kind, timestamp, value): the location if there is a fix, else a string that isn't empty, else the
    number. A location has the time of its fix."""
    place = F.concat_ws(",", F.col("loc_lat").cast("string"), F.col("loc_lon").cast("string"))
    found = all_latest(signals, source=source)
    kind = lambda name, when, value: F.struct(F.lit(name).alias("kind"), F.col(when).alias("timestamp"), value.alias("value"))
    text: Column = F.when(F.col("value_string") != "", kind("string", "timestamp", F.col("value_string")))
    pick = F.when(has_fix(), kind("location", "loc_ts", place)).otherwise(text.otherwise(kind("number", "timestamp", F.col("value_number").cast("string"))))
    return found.select("subject", "name", pick.alias("x")).select("subject", "name", "x.*")


def data_summary(signal_summaries: DataFrame, event_summaries: DataFrame, subjects: DataFrame, now: Column) -> DataFrame:
    """(subject, n_signals, n_events, first_seen, last_seen); a subject without data was first seen now and last in 1900."""
    both = signal_summaries.withColumn("s", F.col("count")).withColumn("e", F.lit(0)).unionByName(event_summaries.withColumn("s", F.lit(0)).withColumn("e", F.col("count")))
    sums = both.groupBy("subject").agg(F.sum("s").alias("n_signals"), F.sum("e").alias("n_events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    out = subjects.select("subject").distinct().join(sums, "subject", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("subject", F.coalesce("n_signals", zero).alias("n_signals"), F.coalesce("n_events", zero).alias("n_events"), F.coalesce("first_seen", now).alias("first_seen"), F.coalesce("last_seen", F.lit("1900-01-01 00:00:00").cast("timestamp")).alias("last_seen"))


def allowed(rows: DataFrame, privileges: DataFrame, held: list[str], one: bool = False) -> DataFrame:
    """rows of which the signal's privileges are all held (or at least one of them); privileges: (name, needs array). An
    unknown name is denied."""
    mine = F.array(*map(F.lit, held)) if held else F.array().cast("array<string>")
    enough = F.size(F.array_intersect("needs", mine)) > 0 if one else F.size(F.array_except("needs", mine)) == 0
    return rows.join(privileges.where(enough).select("name"), "name", "left_semi")
