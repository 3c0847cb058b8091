"""The service's calls as one object: arguments are checked, then turned into the operators' DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.filters import EventFilter, LocationFilter, StringFilter
from wayfare.functions.timing import between, duration_us, micros
from wayfare.operators import aggregate, asof, dedup, enrich, events, latest, raw, rollup, segments
from wayfare.operators.aggregate import Request
from wayfare.operators.raw import Search
from wayfare.schema import FloatAgg, LocationAgg, Mechanism
from wayfare.streaming.ingest import pruning

MOST_DAYS, MOST_AGGREGATES = 32, 65_535
ETHEREUM = re.compile(r"did:ethr:\d+:(0x[0-9a-fA-F]{40})")
EVENT_NAME, EVENT_PREFIX = re.compile(r"[A-Za-z][A-Za-z0-9]*\.[A-Za-z][A-Za-z0-9]*"), re.compile(r"[A-Za-z][A-Za-z0-9]*\.(?:[A-Za-z][A-Za-z0-9]*)?")
DAY, SUMMARY_BUFFER = 86_400_000_000, 120_000_000  # levels of a refuelling or charge may come just after it

#: The signals that describe a segment of any kind, and what is added for some.
SUMMARY = [Request("speed", FloatAgg.MAX), Request("currentLocationCoordinates", LocationAgg.FIRST), Request("currentLocationCoordinates", LocationAgg.LAST)]
MORE = {
    Mechanism.REFUEL: [Request("powertrainFuelSystemRelativeLevel", FloatAgg.FIRST), Request("powertrainFuelSystemRelativeLevel", FloatAgg.LAST)],
    Mechanism.RECHARGE: [Request("powertrainTractionBatteryStateOfChargeCurrent", FloatAgg.FIRST), Request("powertrainTractionBatteryStateOfChargeCurrent", FloatAgg.LAST)],
    Mechanism.IDLING: [Request("powertrainCombustionEngineSpeed", FloatAgg.AVG)],
}
PLACE = "currentLocationCoordinates"
IGNITION, SPEED, ENGINE = "isIgnitionOn", "speed", "powertrainCombustionEngineSpeed"
FUEL, CHARGE, WAY = "powertrainFuelSystemRelativeLevel", "powertrainTractionBatteryStateOfChargeCurrent", "powertrainTransmissionTravelledDistance"


def span(start: str, end: str, now: int | None = None) -> tuple[int, int]:
    """From before to; a `to` in the future is now."""
    a, b = micros(start), micros(end)
    b = b if now is None else min(b, now)
    if a >= b:
        raise ValueError("from must be before to")
    return a, b


def source_address(source: str) -> str:
    """The address in a did:ethr source; other sources as they are."""
    m = ETHEREUM.fullmatch(source)
    return m[1] if m else source


def checked(requests: list[Request]) -> list[Request]:
    if len(requests) > MOST_AGGREGATES:
        raise ValueError(f"more than {MOST_AGGREGATES} aggregates")
    for r in requests:
        if isinstance(r.filter, LocationFilter):
            sound = lambda lat, lon: -90 <= lat <= 90 and -180 <= lon <= 180  # noqa: E731  false for nan
            if r.filter.circle and not (sound(*r.filter.circle[:2]) and 0 <= r.filter.circle[2] < float("inf")):
                raise ValueError("no such circle")
            if r.filter.polygon and (len(r.filter.polygon) < 3 or not all(sound(*p) for p in r.filter.polygon)):
                raise ValueError("a polygon has at least three corners on the globe")
    return requests


def checked_names(names: StringFilter | None) -> None:
    """Event names are `category.name`; a prefix may end within either."""
    if names is None:
        return
    for name in [*([names.eq] if names.eq is not None else []), *names.isin]:
        if not EVENT_NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no event name")
    if names.startswith is not None and not EVENT_PREFIX.fullmatch(names.startswith):
        raise ValueError(f"{names.startswith!r} starts no event name")
    for other in names.any_of:
        checked_names(other)


@dataclass
class Enriched:
    """segments; ranges (subject, seg_idx, start, end); the requests that signal_type and signal_index of values count;
    counts (subject, seg_idx, name, count); places (subject, seg_idx, start_lat, ...)."""

    segments: DataFrame
    ranges: DataFrame
    requests: list[Request]
    values: DataFrame
    counts: DataFrame
    places: DataFrame


@dataclass
class Daily:
    days: DataFrame
    requests: list[Request]
    values: DataFrame
    counts: DataFrame


def _sides(values: DataFrame, requests: list[Request]) -> tuple[DataFrame, DataFrame]:
    """The first and the last locations among range aggregates."""
    places = [r for r in requests if r.kind == aggregate.PLACE]
    at = lambda agg: next(i for i, r in enumerate(places) if (r.name, r.agg) == (PLACE, agg))
    return tuple(values.where((F.col("signal_type") == aggregate.PLACE) & (F.col("signal_index") == at(a))) for a in (LocationAgg.FIRST, LocationAgg.LAST))


@dataclass
class Telemetry:
    """signals, events and raw envelopes, and rollups where there are any: they serve what has no source filter."""

    signals: DataFrame
    events: DataFrame
    raw: DataFrame | None = None
    rollup: DataFrame | None = None

    def _own(self, df: DataFrame, subjects: list[str] | None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Of the subjects, from start to end: by bucket and date, too, where the table has these partitions."""
        if subjects is not None and not all(subjects):
            raise ValueError("a subject is empty")
        if "subject_bucket" in df.columns:
            return df.where(pruning(subjects, start, end, "day" if "date" in df.columns else None)) if "timestamp" in df.columns else df.where(pruning(subjects, None, None))
        return df if subjects is None else df.where(F.col("subject").isin(subjects))

    def series(self, requests: list[Request], interval: str, start: str, end: str, subjects: list[str] | None = None, source: str | None = None) -> DataFrame:
        a, b = span(start, end)
        rows = aggregate.by_interval(self._own(self.signals, subjects, a, b), checked(requests), a, b, duration_us(interval), source and source_address(source))
        return aggregate.as_objects(rows, requests).orderBy("subject", "bucket_us")

    def latest(self, names: list[str] | None = None, subjects: list[str] | None = None, source: str | None = None) -> DataFrame:
        if self.rollup is not None and source is None:
            rows = self._own(self.rollup, subjects).drop("count", "first_seen", "last_seen")
            return rows if names is None else rows.where(F.col("name").isin(names))
        return latest.all_latest(self._own(self.signals, subjects), names, source and source_address(source))

    def available(self, known: list[str], subjects: list[str] | None = None, source: str | None = None) -> DataFrame:
        if self.rollup is not None and source is None:
            return self._own(self.rollup, subjects).where(F.col("name").isin(known)).select("subject", "name").orderBy("subject", "name")
        return latest.names(self._own(self.signals, subjects), source, known).orderBy("subject", "name")

    def snapshot(self, subjects: list[str] | None = None, privileges: DataFrame | None = None, held: list[str] | None = None) -> DataFrame:
        rows = latest.snapshot(self._own(self.signals, subjects))
        return rows if privileges is None else latest.allowed(rows, privileges, held or [])

    def summary(self, subjects: DataFrame) -> DataFrame:
        own = self.rollup.select(*rollup.KEY, "count", "first_seen", "last_seen") if self.rollup is not None else latest.summaries(self.signals)
        return latest.data_summary(own, events.summaries(self.events), subjects, F.current_timestamp())

    def list_events(self, start: str, end: str, where: EventFilter | None = None, subjects: list[str] | None = None) -> DataFrame:
        checked_names(where and where.name)
        a, b = span(start, end)
        return events.listing(self._own(self.events, subjects, a, b), a, b, where)

    def find_raw(self, search: Search, limit: int = 10) -> DataFrame:
        return raw.listing(self.raw, search, limit)

    def raw_types(self, search: Search) -> DataFrame:
        return raw.type_summaries(self.raw, search)

    def _level(self, name: str, subjects: list[str] | None) -> DataFrame:
        rows = dedup.signals(self._own(self.signals, subjects), [name])
        return rows.select("subject", "timestamp", F.col("value_number").alias("value"))

    def detect(self, mechanism: Mechanism, start: str, end: str, config: segments.Config | None = None, now: int | None = None, subjects: list[str] | None = None) -> DataFrame:
        a, b = span(start, end, now)
        if b - a > MOST_DAYS * 86_400 * segments.SECOND + segments.SECOND:
            raise ValueError(f"more than {MOST_DAYS} days")
        config = config or segments.Config()
        level = lambda name: self._level(name, subjects)
        if mechanism in (Mechanism.FREQUENCY, Mechanism.CHANGE_POINT):
            find = segments.frequency if mechanism is Mechanism.FREQUENCY else segments.change_point
            rows = self._own(self.signals, subjects, a - config.max_gap * segments.SECOND, b)
            return find(rows, a, b, config, b if now is None else now)
        if mechanism is Mechanism.IGNITION:
            return segments.ignition(level(IGNITION), a, b, config)
        if mechanism is Mechanism.IDLING:
            return segments.idling(level(ENGINE), level(SPEED), a, b, config)
        if mechanism is Mechanism.REFUEL:
            return segments.refuel(level(FUEL), a, b, config)
        return segments.recharge(level(CHARGE), level(WAY), a, b, config)

    def segments(self, mechanism: Mechanism, start: str, end: str, config: segments.Config | None = None, limit: int = 100, after: int | None = None, now: int | None = None, event_names: list[str] | None = None, extra: list[Request] | None = None, subjects: list[str] | None = None) -> Enriched:
        """Segments with their signal aggregates, event counts (of each asked name, 0 where there are none) and boundary
        locations, by subject and seg_idx. Levels of refuelling and charging are looked for two minutes longer."""
        found = segments.page(self.detect(mechanism, start, end, config, now, subjects), limit, after)
        last = span(start, end, now)[1]
        ranges = segments.as_ranges(found, last)
        longer = segments.as_ranges(found, last, SUMMARY_BUFFER) if mechanism in (Mechanism.REFUEL, Mechanism.RECHARGE) else ranges
        asked = checked(list({(r.name, r.agg): r for r in [*(extra or []), *MORE.get(mechanism, []), *SUMMARY][::-1]}.values())[::-1])
        signals = self._own(self.signals, subjects)
        a, _ = span(start, end, now)
        bounds = (a - segments.LOOKBACK if mechanism is Mechanism.IGNITION else a, last + SUMMARY_BUFFER)
        values = aggregate.by_range(signals, asked, longer, bounds)
        return Enriched(found, ranges, asked, values, self._counts(ranges, event_names, subjects, bounds), enrich.boundary_locations(ranges, *_sides(values, asked), signals, [PLACE]))

    def _counts(self, ranges: DataFrame, names: list[str] | None, subjects: list[str] | None, bounds: tuple[int, int]) -> DataFrame:
        found = events.counts_by_range(self._own(self.events, subjects), ranges, names, bounds)
        return enrich.event_summary(ranges, found, names) if names else found

    def daily(self, mechanism: Mechanism, start: str, end: str, zone: str = "UTC", config: segments.Config | None = None, event_names: list[str] | None = None, extra: list[Request] | None = None, subjects: list[str] | None = None) -> Daily:
        """Each civil day of each subject with segments or signals in the range: its segments, active seconds and boundary
        locations, its signal aggregates and its event counts, by subject and seg_idx (the number of the day)."""
        if mechanism in (Mechanism.IDLING, Mechanism.REFUEL, Mechanism.RECHARGE):
            raise ValueError("daily activity is of usage")
        days = segments.civil_days(start[:10], end[:10], zone, self.signals.sparkSession)
        found = self.detect(mechanism, start, end, config, None, subjects)
        a, b = span(start, end)
        signals = self._own(self.signals, subjects)
        people = signals.where(between("timestamp", a, b)).select("subject").unionByName(found.select("subject"))
        ranges = segments.by_day(people, days)
        asked = checked(list({(r.name, r.agg): r for r in [*(extra or []), *SUMMARY][::-1]}.values())[::-1])
        bounds = (a - 2 * DAY, b + 2 * DAY)  # civil days of any zone
        values = aggregate.by_range(signals, asked, ranges, bounds)
        spans = segments.as_ranges(found, b)
        own = aggregate.by_range(signals, SUMMARY, spans, (a - segments.LOOKBACK if mechanism is Mechanism.IGNITION else a, b))
        places = enrich.boundary_locations(spans, *_sides(own, SUMMARY), signals, [PLACE])
        numbered = found.join(spans.select("subject", "seg_idx", F.unix_micros("start").alias("start_us")), ["subject", "start_us"])
        edges = enrich.day_edges(numbered.select("subject", "seg_idx", "start_us", "end_us"), places, days)
        rows = enrich.daily(ranges, segments.daily_activity(found, days), edges, *_sides(values, asked), signals, [PLACE])
        return Daily(rows, asked, values, self._counts(ranges, event_names, subjects, bounds))

    def locations_at(self, probes: DataFrame, names: list[str]) -> DataFrame:
        """Probes without a fix get (0, 0)."""
        return asof.locations_at(self.signals, probes, names).fillna(0.0, ["loc_lat", "loc_lon"])
