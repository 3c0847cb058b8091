"""One row for each logical key. Filters stand below the window, where the scan can use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIGNAL_KEY = ["subject", "name", "timestamp"]
EVENT_KEY = ["subject", "timestamp", "name", "source"]


def first_of(df: DataFrame, key: list, order: list) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def signals(df: DataFrame, names: list[str] | None = None, source: str | None = None) -> DataFrame:
    """The smallest cloud_event_id of each (subject, name, timestamp). A source filter must come before: afterwards
    another source might have won."""
    if source is not None:
        df = df.where(F.col("source") == source)
    if names is not None:
        df = df.where(F.col("name").isin(sorted(set(names))))
    return first_of(df, SIGNAL_KEY, ["cloud_event_id"])


def signals_by_sum(df: DataFrame) -> DataFrame:
    """The same by a partial aggregate, which sends one row for each key and task: better where repeats are many."""
    rest = [c for c in df.columns if c not in SIGNAL_KEY]
    best = df.groupBy(*SIGNAL_KEY).agg(F.min_by(F.struct(*rest), "cloud_event_id").alias("_r"))
    return best.select(*SIGNAL_KEY, "_r.*").select(*df.columns)


def events(df: DataFrame) -> DataFrame:
    """The source is part of the key."""
    return first_of(df, EVENT_KEY, ["cloud_event_id"])


def raw(df: DataFrame) -> DataFrame:
    """The earliest of each (subject, second, type, source, id)."""
    return first_of(df, ["subject", F.date_trunc("second", "time"), "type", "source", "id"], ["time"])
