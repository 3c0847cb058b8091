"""Detection of usage, idling, refuelling and charging, for all subjects at once.

Every step is a window or a sum by subject; the scans for refuelling and charging, which look at a varying number of
samples, run on the samples of one subject in the query's range (of at most 32 days).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.timing import at, between
from wayfare.operators import dedup

SECOND = 1_000_000
LOOKBACK = 30 * 86_400 * SECOND  # how long before a range transitions are looked for
SEGMENT = ["subject", "start_us", "end_us", "duration_s", "ongoing", "started_before"]
REFUEL_WINDOW, REFUEL_SEARCH = 300 * SECOND, 1800 * SECOND
CHARGE_SMOOTH, CHARGE_ODOMETER, CHARGE_GAP = 11, 0.5, 7200 * SECOND


@dataclass(frozen=True)
class Config:
    """The defaults. None: the detector's own."""

    max_gap: int = 300
    min_duration: int | None = None
    signal_count: int = 10
    distinct_count: int = 2
    max_idle: float = 1000
    min_increase: float | None = None
    window: int = 60

    def __post_init__(self):
        for value, low, high in ((self.max_gap, 60, 3600), (self.min_duration, 60, 3600), (self.signal_count, 1, 3600), (self.max_idle, 0, 3000), (self.min_increase, 1, 100)):
            if value is not None and not low <= value <= high:
                raise ValueError(f"{value} isn't from {low} to {high}")

    def shortest(self, default: int = 240) -> int:
        return default if self.min_duration is None else self.min_duration


def _clipped(ranges: DataFrame, start: int, end: int, shortest: int) -> DataFrame:
    """Ranges (start_us, end_us) cut to the query's; one that is too short stays if it began before and was long enough."""
    seconds = lambda a, b: F.floor((F.col(b) - F.col(a)) / SECOND)
    out = ranges.withColumn("_full", seconds("start_us", "end_us")).withColumn("_early", F.col("start_us") < start)
    out = out.withColumn("start_us", F.greatest("start_us", F.lit(start))).withColumn("end_us", F.least("end_us", F.lit(end)))
    out = out.where("end_us > start_us").withColumn("duration_s", seconds("start_us", "end_us"))
    return out.where((F.col("duration_s") >= shortest) | (F.col("_early") & (F.col("_full") >= shortest))).drop("_full", "_early")


def _closed(ranges: DataFrame, start: int) -> DataFrame:
    return ranges.withColumn("ongoing", F.lit(False)).withColumn("started_before", F.col("start_us") <= start).select(*SEGMENT)


def merged(ranges: DataFrame, gap: int) -> DataFrame:
    """Ranges (subject, start_us, end_us) joined where the next begins at most `gap` microseconds after all before ended."""
    w = W.partitionBy("subject").orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_us") - F.col("_reach") <= gap, 0).otherwise(1)).over(w)
    out = ranges.withColumn("_reach", reach).withColumn("_island", island)
    return out.groupBy("subject", "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_island")


def active_windows(signals: DataFrame, start: int, end: int, config: Config) -> DataFrame:
    """(subject, window_us, n, n_names) of epoch-aligned windows with enough readings of enough names."""
    rows = signals.where(between("timestamp", start, end)).select(*dedup.SIGNAL_KEY).distinct()
    width = config.window * SECOND
    us = F.unix_micros("timestamp")
    out = rows.groupBy("subject", (us - F.pmod(us, F.lit(width))).alias("window_us")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))
    return out.where((F.col("n") >= config.signal_count) & (F.col("n_names") >= config.distinct_count))


def cusum(windows: DataFrame, mean: float = 1.0, slack: float = 0.5) -> DataFrame:
    """windows with the statistic max(0, S + n - mean - slack), which is the running sum less its least value so far (or 0)."""
    w = W.partitionBy("subject").orderBy("window_us").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = windows.withColumn("_sum", F.sum(F.col("n") - (mean + slack)).over(w))
    return out.withColumn("cusum", F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(w))).drop("_sum")


def _from_windows(windows: DataFrame, start: int, end: int, config: Config, now: int) -> DataFrame:
    ranges = windows.select("subject", F.col("window_us").alias("start_us"), F.least(F.col("window_us") + config.window * SECOND, F.lit(end)).alias("end_us"))
    out = _clipped(merged(ranges, config.max_gap * SECOND), start, end, config.shortest())
    last = F.row_number().over(W.partitionBy("subject").orderBy(F.desc("start_us"))) == 1
    live = (end - F.col("end_us") <= config.max_gap * SECOND) & F.lit(now - end <= config.max_gap * SECOND)
    out = out.withColumn("ongoing", last & live).withColumn("end_us", F.when(~F.col("ongoing"), F.col("end_us")))
    out = out.withColumn("duration_s", F.when(F.col("ongoing"), F.floor((end - F.col("start_us")) / SECOND)).otherwise(F.col("duration_s")))
    return out.where(~F.col("ongoing") | (F.col("duration_s") >= config.shortest())).withColumn("started_before", F.col("start_us") <= start).select(*SEGMENT)


def frequency(signals: DataFrame, start: int, end: int, config: Config, now: int) -> DataFrame:
    return _from_windows(active_windows(signals, start - config.max_gap * SECOND, end, config), start, end, config, now)


def change_point(signals: DataFrame, start: int, end: int, config: Config, now: int, threshold: float = 5.0) -> DataFrame:
    windows = cusum(active_windows(signals, start - config.max_gap * SECOND, end, config))
    return _from_windows(windows.where(F.col("cusum") > threshold), start, end, config, now)


def state_changes(samples: DataFrame, start: int, end: int, lookback: int) -> DataFrame:
    """(subject, timestamp, state, previous) of samples (subject, timestamp, value): transitions from `lookback` before
    start to end. The state before the first of them is that of the last sample before, whenever it was (0 if there is
    none): of those older samples one row a subject is kept by a sum, and only the newer ones are ordered. If nothing
    changed and the last state is 1, the first reading from `lookback` before start on counts as the change."""
    floor = at(start - lookback)
    known = samples.where(F.col("value").isNotNull())
    older = known.where(F.col("timestamp") < floor).groupBy("subject").agg(F.max("timestamp").alias("timestamp"), F.max_by("value", "timestamp").alias("value"))
    newer = known.where((F.col("timestamp") >= floor) & (F.col("timestamp") < at(end))).select("subject", "timestamp", "value")
    w = W.partitionBy("subject").orderBy("timestamp")
    rows = newer.withColumn("_inside", F.lit(True)).unionByName(older.withColumn("_inside", F.lit(False)))
    rows = rows.withColumn("previous", F.coalesce(F.lag("value").over(w), F.lit(0.0))).withColumnRenamed("value", "state")
    rows = rows.withColumn("_changed", F.col("_inside") & (F.col("state") != F.col("previous")))
    first = F.col("_inside") & ~F.coalesce(F.lag("_inside").over(w), F.lit(False))
    rows = rows.withColumn("_first", first).withColumn("_any", F.max("_changed").over(W.partitionBy("subject")))
    steady = F.col("_first") & ~F.col("_any") & (F.col("state") == 1)
    return rows.where(F.col("_changed") | steady).select("subject", "timestamp", "state", F.when(steady, 0.0).otherwise(F.col("previous")).alias("previous"))


def ignition(samples: DataFrame, start: int, end: int, config: Config) -> DataFrame:
    """Segments from ON to OFF of samples (subject, timestamp, value 0/1). An OFF with an ON less than max_gap later is
    noise. An open segment lasts to the end and is ongoing."""
    changes = state_changes(samples, start, end, LOOKBACK)
    later = W.partitionBy("subject").orderBy("timestamp").rowsBetween(1, W.unboundedFollowing)
    us = F.unix_micros("timestamp")
    kept = changes.withColumn("us", us).withColumn("_on", F.min(F.when(F.col("state") == 1, us)).over(later))
    kept = kept.where((F.col("state") == 1) | (F.col("state") == 0) & (F.col("_on").isNull() | (F.col("_on") - F.col("us") >= config.max_gap * SECOND)))
    w = W.partitionBy("subject").orderBy("us")
    # a segment is the ONs since the last OFF that was kept
    turn = kept.withColumn("_offs", F.coalesce(F.sum(F.when(F.col("state") == 0, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    on = F.min(F.when((F.col("state") == 1) & (F.col("previous") != 1), F.col("us")))
    runs = turn.groupBy("subject", "_offs").agg(on.alias("start_us"), F.max(F.when(F.col("state") == 0, F.col("us"))).alias("end_us")).where("start_us IS NOT NULL")
    runs = runs.withColumn("ongoing", F.col("end_us").isNull())
    runs = runs.withColumn("duration_s", F.floor((F.coalesce("end_us", F.lit(end)) - F.col("start_us")) / SECOND)).where(F.col("duration_s") >= config.shortest())
    return runs.where((F.col("end_us") > start) | F.col("ongoing")).withColumn("started_before", F.col("start_us") < start).select(*SEGMENT)


def idle_runs(samples: DataFrame, start: int, end: int, config: Config) -> DataFrame:
    """(subject, start_us, end_us) of runs of samples (subject, timestamp, value) above 0 and at most max_idle; another
    sample, or a gap of more than max_gap, ends a run."""
    w = W.partitionBy("subject").orderBy("timestamp")
    us = F.unix_micros("timestamp")
    idle = (F.col("value") > 0) & (F.col("value") <= config.max_idle)
    rows = samples.where(between("timestamp", start - config.max_gap * SECOND, end)).withColumn("idle", idle).withColumn("us", us)
    same = F.lag("idle").over(w) & (F.col("us") - F.lag("us").over(w) <= config.max_gap * SECOND)
    rows = rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return rows.where("idle").groupBy("subject", "_run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us")).drop("_run")


def idling(samples: DataFrame, speeds: DataFrame, start: int, end: int, config: Config) -> DataFrame:
    """Idle runs within the range in which no speed above 0 was read; speeds (subject, timestamp, value)."""
    runs = _closed(_clipped(idle_runs(samples, start, end, config), start, end, config.shortest()), start)
    moving = speeds.where(between("timestamp", start, end)).where("value > 0").select("subject", F.to_date("timestamp").alias("_day"), F.unix_micros("timestamp").alias("_us"))
    days = runs.withColumn("_day", F.explode(F.expr("sequence(to_date(timestamp_micros(start_us)), to_date(timestamp_micros(end_us)))")))
    met = days.join(moving, ["subject", "_day"]).where("_us >= start_us AND _us < end_us").select("subject", "start_us").distinct()
    return runs.join(met, ["subject", "start_us"], "left_anti").select(*SEGMENT)


def _level_at(ts: np.ndarray, value: np.ndarray, when: np.ndarray) -> np.ndarray:
    """The last level at or before each time; 0 before the first."""
    i = np.searchsorted(ts, when, "right") - 1
    return np.where(i >= 0, value[np.maximum(i, 0)], 0.0)


def _rises(ts: np.ndarray, value: np.ndarray, start: int, end: int, rise: float, shortest: int) -> Iterator[tuple[int, int]]:
    """Trough to peak around each whole minute from which the level grows by more than `rise` per cent in five minutes."""
    minute = 60 * SECOND
    times = np.arange(-(-start // minute) * minute, end - REFUEL_WINDOW + 1, minute)
    before, after = _level_at(ts, value, times), _level_at(ts, value, times + REFUEL_WINDOW)
    for t in times[(before >= 1e-6) & ((after - before) > rise / 100 * np.maximum(before, 1e-6))].tolist():
        low = max(0, int(np.searchsorted(ts, t, "right")) - 1)
        falls = np.flatnonzero(np.diff(value[: low + 1][::-1]) >= 0)  # going back, where it stops to fall
        low = low - (int(falls[0]) if len(falls) else low)
        t += REFUEL_WINDOW
        lo, hi = np.searchsorted(ts, t, "left"), np.searchsorted(ts, t + REFUEL_SEARCH, "right")
        if lo >= hi:
            continue
        ahead = value[lo:hi]
        drops = np.flatnonzero(ahead[1:] < ahead[:-1] - 1.0)
        top = int(drops[0]) if len(drops) else len(ahead) - 1 - int(np.argmax(ahead[::-1]))
        if ts[lo + top] > ts[low] and ahead[top] - value[low] >= 20:
            a, b = max(int(ts[low]), start), min(int(ts[lo + top]), end)
            if (b - a) // SECOND >= shortest:
                yield a, b


def _segments(ranges: list[tuple[int, int]], subject: str) -> pd.DataFrame:
    subjects = pd.Series([subject] * len(ranges), dtype=object)
    return pd.DataFrame({"subject": subjects, "start_us": np.array([r[0] for r in ranges], np.int64), "end_us": np.array([r[1] for r in ranges], np.int64)})


def refuel(samples: DataFrame, start: int, end: int, config: Config) -> DataFrame:
    """Refuelling by samples (subject, timestamp, value) of the fuel level."""
    rise, shortest = config.min_increase or 30, config.shortest()
    rows = samples.where(between("timestamp", start - REFUEL_WINDOW, end + REFUEL_SEARCH)).select("subject", F.unix_micros("timestamp").alias("us"), "value")

    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("us")
        found = list(_rises(rows.us.to_numpy(), rows.value.to_numpy(), start, end, rise, shortest)) if len(rows) > 1 else []
        return _segments(found, key[0])

    found = rows.groupBy("subject").applyInPandas(find, "subject string, start_us long, end_us long")
    return _closed(_clipped(merged(found, 0), start, end, shortest), start)


def _ends(ts: np.ndarray, value: np.ndarray, a: int, b: int) -> tuple[float, float] | None:
    """The first and last level from a to b, both inside."""
    lo, hi = np.searchsorted(ts, a, "left"), np.searchsorted(ts, b, "right")
    return (value[lo], value[hi - 1]) if lo < hi else None


def _climbs(ts: np.ndarray, value: np.ndarray, rise: float, shortest: int) -> list[tuple[int, int]]:
    """Trough to peak of the smoothed level; plateaus go with the direction before them."""
    half = CHARGE_SMOOTH // 2
    smooth = np.lib.stride_tricks.sliding_window_view(value, CHARGE_SMOOTH).sum(1) / CHARGE_SMOOTH
    ts = ts[half : len(ts) - half]
    turns = np.flatnonzero(np.diff(smooth))
    up = np.diff(smooth)[turns] > 0
    out = []
    for run in np.split(np.arange(len(turns)), np.flatnonzero(np.diff(up)) + 1):
        if len(run) and up[run[0]]:
            low = 0 if run[0] == 0 else turns[run[0]]
            top = turns[run[-1]] + 1
            if smooth[top] - smooth[low] >= rise and (ts[top] - ts[low]) // SECOND >= shortest:
                out.append((int(ts[low]), int(ts[top])))
    return out


def recharge(samples: DataFrame, odometer: DataFrame, start: int, end: int, config: Config) -> DataFrame:
    """Charging by samples (subject, timestamp, value) of the state of charge while the odometer stands."""
    rise, shortest = config.min_increase or 1.0, config.shortest(60)
    rows = lambda df: df.where(between("timestamp", start, end)).select("subject", F.unix_micros("timestamp").alias("us"), "value")

    def find(key: tuple, soc: pd.DataFrame, odo: pd.DataFrame) -> pd.DataFrame:
        soc, odo = soc.sort_values("us"), odo.sort_values("us")
        s, o = (soc.us.to_numpy(), soc.value.to_numpy()), (odo.us.to_numpy(), odo.value.to_numpy())
        if len(soc) < CHARGE_SMOOTH + 2:
            return _segments([], key[0])
        out: list[tuple[int, int]] = []
        for a, b in _climbs(*s, rise, shortest):
            level, way = _ends(*s, a, b), _ends(*o, a, b)
            if level is None or level[1] <= level[0] or way and way[1] - way[0] > CHARGE_ODOMETER:
                continue
            before = out and _ends(*o, *out[-1])
            if before and way and a - out[-1][1] <= CHARGE_GAP and abs(way[0] - before[1]) <= CHARGE_ODOMETER:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return _segments([r for r in out if (r[1] - r[0]) // SECOND >= shortest], key[0])

    found = rows(samples).groupBy("subject").cogroup(rows(odometer).groupBy("subject")).applyInPandas(find, "subject string, start_us long, end_us long")
    return _closed(found.where(F.col("subject").isNotNull()).withColumn("duration_s", F.floor((F.col("end_us") - F.col("start_us")) / SECOND)), start)


def page(segments: DataFrame, limit: int = 100, after: int | None = None) -> DataFrame:
    """The first `limit` (1 to 200) of each subject that start after a time."""
    if not 1 <= limit <= 200:
        raise ValueError("limit is from 1 to 200")
    rows = segments if after is None else segments.where(F.col("start_us") > after)
    return dedup_rank(rows, limit)


def dedup_rank(rows: DataFrame, limit: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("subject").orderBy("start_us"))).where(F.col("_n") <= limit).drop("_n")


def as_ranges(segments: DataFrame, end: int, buffer: int = 0) -> DataFrame:
    """(subject, seg_idx, start, end) for the range aggregates; an open segment lasts to the end. A buffer (microseconds)
    makes each range longer, up to where the next one starts."""
    w = W.partitionBy("subject").orderBy("start_us")
    last = F.coalesce("end_us", F.lit(end))
    if buffer:
        last = F.greatest(last, F.least(last + buffer, F.coalesce(F.lead("start_us").over(w), last + buffer)))
    return segments.select("subject", (F.row_number().over(w) - 1).alias("seg_idx"), F.timestamp_micros("start_us").alias("start"), F.timestamp_micros(last).alias("end"))


def civil_days(start: str, end: str, zone: str, spark) -> DataFrame:
    """(day, start_us, end_us) of the civil days from start to end (dates, both inside), as long as the zone has them."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day")
    edge = lambda d: F.unix_micros(F.to_utc_timestamp(d.cast("timestamp"), zone))
    return days.select("day", edge(F.col("day")).alias("day_start"), edge(F.date_add("day", 1)).alias("day_end"))


def daily_activity(segments: DataFrame, days: DataFrame) -> DataFrame:
    """(subject, day, n_segments, active_s, first_us, last_us): segments cut to each day; an open one is active to its end."""
    end = F.coalesce("end_us", "day_end")
    cut = segments.join(F.broadcast(days), (F.col("start_us") < F.col("day_end")) & (F.coalesce("end_us", "day_end") > F.col("day_start")))  # at most 33 days
    part = (F.least(end, F.col("day_end")) - F.greatest("start_us", "day_start")) / SECOND
    found = cut.groupBy("subject", "day").agg(F.count("*").alias("n_segments"), F.sum(F.floor(part)).alias("active_s"), F.min("start_us").alias("first_us"), F.max(end).alias("last_us"))
    return found


def by_day(subjects: DataFrame, days: DataFrame) -> DataFrame:
    """(subject, seg_idx, start, end, day): each civil day of each subject as a range; seg_idx counts the days."""
    w = W.orderBy("day")  # at most 33 days
    numbered = days.withColumn("seg_idx", F.row_number().over(w) - 1).agg(F.collect_list(F.struct("seg_idx", "day", "day_start", "day_end")).alias("_days"))
    every = subjects.select("subject").distinct().join(F.broadcast(numbered)).select("subject", F.explode("_days").alias("d"))  # one row
    return every.select("subject", "d.seg_idx", F.timestamp_micros("d.day_start").alias("start"), F.timestamp_micros("d.day_end").alias("end"), "d.day")
