"""The filter language: each object turns into one Column. An `any_of` list is ORed against all else together."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions.geo import within_circle, within_polygon


def all_of(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def _with_alternatives(own: Column | None, others: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, ([] if own is None else [own]) + others) if own is not None or others else F.lit(True)


@dataclass(frozen=True)
class FloatFilter:
    eq: float | None = None
    neq: float | None = None
    gt: float | None = None
    lt: float | None = None
    gte: float | None = None
    lte: float | None = None
    isin: list[float] = field(default_factory=list)
    notin: list[float] = field(default_factory=list)
    any_of: list[FloatFilter] = field(default_factory=list)

    def on(self, c: Column) -> Column:
        tests = [(self.eq, c.__eq__), (self.neq, c.__ne__), (self.gt, c.__gt__), (self.lt, c.__lt__), (self.gte, c.__ge__), (self.lte, c.__le__)]
        own = [test(value) for value, test in tests if value is not None]
        own += [c.isin(self.isin)] * bool(self.isin) + [~c.isin(self.notin)] * bool(self.notin)
        return _with_alternatives(all_of(own), [f.on(c) for f in self.any_of])


@dataclass(frozen=True)
class StringFilter:
    eq: str | None = None
    neq: str | None = None
    isin: list[str] = field(default_factory=list)
    notin: list[str] = field(default_factory=list)
    startswith: str | None = None
    any_of: list[StringFilter] = field(default_factory=list)

    def on(self, c: Column) -> Column:
        own = [test(value) for value, test in ((self.eq, c.__eq__), (self.neq, c.__ne__), (self.startswith, c.startswith)) if value is not None]
        own += [c.isin(self.isin)] * bool(self.isin) + [~c.isin(self.notin)] * bool(self.notin)
        return _with_alternatives(all_of(own), [f.on(c) for f in self.any_of])


@dataclass(frozen=True)
class ArrayFilter:
    """Null elements never match; arrays_overlap would turn the answer into null."""

    contains_any: list[str] = field(default_factory=list)
    contains_all: list[str] = field(default_factory=list)
    not_contains_any: list[str] = field(default_factory=list)
    not_contains_all: list[str] = field(default_factory=list)
    any_of: list[ArrayFilter] = field(default_factory=list)

    def on(self, c: Column) -> Column:
        values = lambda v: F.array(*map(F.lit, v))
        some = lambda v: F.size(F.array_intersect(c, values(v))) > 0
        every = lambda v: F.size(F.array_except(values(v), c)) == 0
        own = [f(v) for v, f in ((self.contains_any, some), (self.contains_all, every)) if v]
        own += [~f(v) for v, f in ((self.not_contains_any, some), (self.not_contains_all, every)) if v]
        return _with_alternatives(all_of(own), [f.on(c) for f in self.any_of])


@dataclass(frozen=True)
class LocationFilter:
    """A circle (lat, lon, km) or else a ring of (lat, lon)."""

    circle: tuple[float, float, float] | None = None
    polygon: list[tuple[float, float]] | None = None

    def on(self, lat: Column, lon: Column) -> Column:
        if self.circle:
            return within_circle(lat, lon, *self.circle)
        return within_polygon(lat, lon, self.polygon) if self.polygon else F.lit(True)


@dataclass(frozen=True)
class EventFilter:
    name: StringFilter | None = None
    source: StringFilter | None = None
    tags: ArrayFilter | None = None

    def on(self) -> Column:
        own = [f.on(F.col(c)) for c, f in (("name", self.name), ("source", self.source), ("tags", self.tags)) if f]
        return _with_alternatives(all_of(own), [])
