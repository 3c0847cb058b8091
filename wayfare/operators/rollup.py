"""Rollups of signals and events: recomputed, folded in step by step, split by a watermark, compared and pruned.

A fold must always equal the recomputation. Tables are DataFrames here; writers replace partitions of subject_bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import has_fix
from wayfare.functions.timing import at
from wayfare.operators import dedup, events as ev, latest
from wayfare.schema import LOCATION

KEY = ["subject", "name"]
VALUES = ["timestamp", "value_number", "value_string"]
PLACE = [*LOCATION, "loc_ts"]
COLUMNS = [*KEY, *VALUES, *PLACE, "count", "first_seen", "last_seen"]


def full(signals: DataFrame) -> DataFrame:
    """One row for each (subject, name): latest value, latest fix, number of distinct times, first and last time."""
    rows = dedup.signals(signals)
    fix_time = F.when(has_fix(), F.col("timestamp"))
    out = rows.groupBy(*KEY).agg(
        F.max_by(F.struct(*VALUES), "timestamp").alias("v"),
        F.max_by(F.when(has_fix(), F.struct(*LOCATION, F.col("timestamp").alias("loc_ts"))), fix_time).alias("p"),
        F.count("*").alias("count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    places = [F.coalesce(F.col("p")[c], F.lit(0.0)).alias(c) for c in LOCATION]
    return out.select(*KEY, "v.*", *places, F.col("p")["loc_ts"].alias("loc_ts"), "count", "first_seen", "last_seen")


def of_events(events: DataFrame) -> DataFrame:
    return ev.summaries(events)


def new_keys(batch: DataFrame, base: DataFrame) -> DataFrame:
    """The batch's (subject, name, timestamp) that the base doesn't hold: what the counts grow by."""
    return batch.select(*dedup.SIGNAL_KEY).distinct().join(base.select(*dedup.SIGNAL_KEY).distinct(), dedup.SIGNAL_KEY, "left_anti")


def fold(stored: DataFrame, batch: DataFrame, base: DataFrame) -> DataFrame:
    """The rollup with a batch: `base` are the signals before it. Rows at times that the base holds under a smaller or
    equal id change nothing; where the batch has the smaller id, it replaces a row, and that (subject, name) is computed
    again; all others are new, and are merged in. Only the batch's own keys are looked up in the base."""
    own = dedup.signals(batch)
    held = base.join(own.select(*dedup.SIGNAL_KEY), dedup.SIGNAL_KEY, "left_semi").groupBy(*dedup.SIGNAL_KEY).agg(F.min("cloud_event_id").alias("_held"))
    met = own.join(held, dedup.SIGNAL_KEY, "left")
    replaced = met.where(F.col("_held") > F.col("cloud_event_id")).select(*KEY).distinct()
    now = merge(stored, full(met.where("_held IS NULL").select(*batch.columns)))
    again = full(base.select(*batch.columns).unionByName(batch).join(replaced, KEY, "left_semi"))
    return now.join(replaced, KEY, "left_anti").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def _pick(a: str, b: str, by: str, columns: list[str]) -> list[Column]:
    """columns of b where its `by` is later or equal, or there is no a."""
    newer = F.col(f"{a}.{by}").isNull() | (F.col(f"{b}.{by}") >= F.col(f"{a}.{by}"))
    newer = F.coalesce(newer, F.lit(False)) & F.col(f"{b}.{by}").isNotNull()
    return [F.when(newer, F.col(f"{b}.{c}")).otherwise(F.col(f"{a}.{c}")).alias(c) for c in columns]


def merge(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Two rollups of disjoint signals (or counts that don't overlap) as one."""
    a, b = stored.alias("a"), more.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY], "full")
    either = lambda c, f: f(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)  # noqa: E731  least and greatest skip nulls
    places = [F.coalesce(x, F.lit(0.0)).alias(c) if c != "loc_ts" else x for x, c in zip(_pick("a", "b", "loc_ts", PLACE), PLACE, strict=True)]
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY], *_pick("a", "b", "timestamp", VALUES), *places,
        (F.coalesce("a.count", zero) + F.coalesce("b.count", zero)).alias("count"), either("first_seen", F.least), either("last_seen", F.greatest),
    )


def below(signals: DataFrame, us: int) -> DataFrame:
    return signals.where(F.col("timestamp") < at(us))


def advance(stored: DataFrame, signals: DataFrame, old: int, new: int) -> DataFrame:
    """The daily fold: a rollup of all before `old` with what lies from there to `new`."""
    return merge(stored, full(signals.where((F.col("timestamp") >= at(old)) & (F.col("timestamp") < at(new)))))


def repaired(stored: DataFrame, signals: DataFrame, late: DataFrame, us: int) -> DataFrame:
    """The rollup with the late subjects recomputed from what lies before the watermark."""
    own = late.select("subject").distinct()
    again = full(below(signals.join(own, "subject", "left_semi"), us))
    return stored.join(own, "subject", "left_anti").unionByName(again.select(*stored.columns))


def flushed(stored: DataFrame, signals: DataFrame, dirty: DataFrame) -> DataFrame:
    """The rollup with the dirty subjects (subject) computed again from all signals."""
    own = dirty.select("subject").distinct()
    again = full(signals.join(own, "subject", "left_semi"))
    return stored.join(own, "subject", "left_anti").unionByName(again.select(*stored.columns))


def late_subjects(batch: DataFrame, us: int) -> DataFrame:
    """Subjects of a batch with rows from before the watermark: what `repaired` has to compute again."""
    return batch.where(F.col("timestamp") < at(us)).select("subject").distinct()


def boundary_us(now: int, watermark: int, delay: int = 12_600_000_000) -> int | None:
    """The next watermark: the last midnight (UTC) that is `delay` microseconds past, if it is later than the old one."""
    midnight = (now - delay) // 86_400_000_000 * 86_400_000_000
    return midnight if midnight > watermark else None


def sound(rollup: DataFrame) -> bool:
    """Whether there is one row for each key: asked before a rebuilt rollup takes the place of another."""
    row = cardinality(rollup).first()
    return row["n_rows"] == row["n_keys"]


def served_summaries(stored: DataFrame, signals: DataFrame, us: int) -> DataFrame:
    """(subject, name, count, first_seen, last_seen): the rollup below the watermark, and the tail from it."""
    tail = latest.summaries(signals.where(F.col("timestamp") >= at(us)))
    both = stored.select(*KEY, "count", "first_seen", "last_seen").unionByName(tail)
    return both.groupBy(*KEY).agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def diff(live: DataFrame, shadow: DataFrame) -> DataFrame:
    """(subject, name, status): missing_live, missing_shadow or mismatch; equal rows are left out."""
    a, b = live.alias("a"), shadow.alias("b")
    rest = [c for c in live.columns if c not in KEY]
    unequal = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in rest])
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY], "full")
    status = F.when(F.col("a.subject").isNull(), "missing_live").when(F.col("b.subject").isNull(), "missing_shadow").when(unequal, "mismatch")
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY], status.alias("status")).where("status IS NOT NULL")


def compared(rollup: DataFrame, cache: DataFrame) -> DataFrame:
    """(subject, name, status) of a cache against the rollup by time: match, cache_newer, mismatch or cache_miss."""
    both = rollup.select(*KEY, F.col("timestamp").alias("own")).join(cache.select(*KEY, F.col("timestamp").alias("held")), KEY, "left")
    status = F.when(F.col("held").isNull(), "cache_miss").when(F.col("held") == F.col("own"), "match").when(F.col("held") > F.col("own"), "cache_newer").otherwise("mismatch")
    return both.select(*KEY, status.alias("status"))


def cardinality(rollup: DataFrame) -> DataFrame:
    """(n_rows, n_keys, dup_keys, dup_rows): a sound rollup has no duplicates."""
    keys = rollup.groupBy(*KEY).agg(F.count("*").alias("n"))
    more = F.col("n") > 1
    return keys.agg(*[F.coalesce(f, F.lit(0).cast("bigint")).alias(a) for f, a in ((F.sum("n"), "n_rows"), (F.count("*"), "n_keys"), (F.sum(F.when(more, 1)), "dup_keys"), (F.sum(F.when(more, F.col("n"))), "dup_rows"))])


def inserted(base: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's rows that the base doesn't hold by (subject, cloud_event_id, name, timestamp). The base is read only
    in the batch's range of times."""
    key = ["subject", "cloud_event_id", "name", "timestamp"]
    low, high = batch.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    if low is None:
        return batch
    held = base.where((F.col("timestamp") >= at(low)) & (F.col("timestamp") <= at(high)))
    return batch.dropDuplicates(key).join(held.select(*key).distinct(), key, "left_anti")


def pruned(signals: DataFrame, rollup: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Signals from the cutoff on, and the rollup without rows that were last seen before it and have none left."""
    kept = signals.where(F.col("timestamp") >= at(cutoff))
    old = rollup.where(F.col("last_seen") < at(cutoff)).join(kept.select(*KEY).distinct(), KEY, "left_anti").select(*KEY)
    return kept, rollup.join(old, KEY, "left_anti")


def latest_fold(rows: DataFrame) -> DataFrame:
    """Last writer wins by (time, then smaller id), for values and for fixes apart: what a cache of latest values holds."""
    first = F.struct(F.unix_micros("timestamp").alias("t"), "value_number", "value_string", "timestamp")
    ranked = dedup.signals(rows)
    fix = F.when(has_fix(), F.struct(*LOCATION, F.col("timestamp").alias("loc_ts")))
    out = ranked.groupBy(*KEY).agg(F.max_by(first, "timestamp").alias("v"), F.max_by(fix, F.when(has_fix(), F.col("timestamp"))).alias("p"))
    return out.select(*KEY, F.col("v.timestamp").alias("timestamp"), "v.value_number", "v.value_string", *[F.coalesce(F.col("p")[c], F.lit(0.0)).alias(c) for c in LOCATION], F.col("p")["loc_ts"].alias("loc_ts"))
