"""Interval and range aggregates over any number of subjects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.filters import FloatFilter, LocationFilter, StringFilter
from wayfare.functions.geo import has_fix
from wayfare.functions.tables import literals
from wayfare.functions.timing import between, bucket_us
from wayfare.operators import dedup
from wayfare.schema import LOCATION, FloatAgg, LocationAgg, StringAgg

FLOAT, STRING, PLACE = 1, 2, 3
MOST_BUCKETS = 100_000


@dataclass(frozen=True)
class Request:
    """One aggregate of one signal. The kind of `agg` says which of its values is meant; `alias` names it in objects."""

    name: str
    agg: FloatAgg | StringAgg | LocationAgg
    filter: FloatFilter | StringFilter | LocationFilter | None = None
    alias: str | None = None

    @property
    def kind(self) -> int:
        return {FloatAgg: FLOAT, StringAgg: STRING, LocationAgg: PLACE}[type(self.agg)]

    @classmethod
    def of(cls, name: str, kind: int, agg: str | None = None, **more: object) -> Request:
        """By the kind of values and the aggregate's name. An unknown aggregate is the kind's default: the average, the
        most frequent string, or the first location."""
        names, default = {FLOAT: (FloatAgg, FloatAgg.AVG), STRING: (StringAgg, StringAgg.TOP), PLACE: (LocationAgg, LocationAgg.FIRST)}[kind]
        return cls(name, names(agg) if agg in [x.value for x in names] else default, **more)


def _slots(requests: list[Request]) -> list[tuple[int, int, Request]]:
    """(kind, index within the kind, request)."""
    seen = {FLOAT: 0, STRING: 0, PLACE: 0}
    out = []
    for r in requests:
        out.append((r.kind, seen[r.kind], r))
        seen[r.kind] += 1
    return out


def _requested(df: DataFrame, requests: list[Request]) -> DataFrame:
    """A row for each request of the row's name. The requests are as many as the query names, and known here."""
    rows = [(k, i, r.name, r.agg.value) for k, i, r in _slots(requests)]
    asked = literals(df.sparkSession, rows, ["signal_type", "signal_index", "name", "fn"])
    out = df.join(F.broadcast(asked), "name")
    return out.withColumn("_rand", F.rand()) if any(r.agg.value == "RAND" for r in requests) else out


def _passes(requests: list[Request], fixes_only: bool) -> Column:
    out = F.lit(False)
    for k, i, r in _slots(requests):
        test = (F.col("signal_type") == k) & (F.col("signal_index") == i)
        if k == PLACE:
            test = test & has_fix() if fixes_only else test
            test = test & r.filter.on(F.col("loc_lat"), F.col("loc_lon")) if r.filter else test
        elif r.filter:
            test = test & r.filter.on(F.col("value_number" if k == FLOAT else "value_string"))
        out = out | test
    return out


def _measures(requests: list[Request]) -> list[Column]:
    """Only the aggregates that someone asks for, each over its own rows."""
    number, text = F.col("value_number"), F.col("value_string")
    place = F.struct(*LOCATION)
    ways = {
        (FLOAT, "AVG"): F.avg, (FLOAT, "MIN"): F.min, (FLOAT, "MAX"): F.max, (FLOAT, "MED"): F.median,
        (STRING, "TOP"): lambda v: F.mode(v, True), (STRING, "UNIQUE"): lambda v: F.array_join(F.array_sort(F.collect_set(v)), ","),
    }
    order = {"FIRST": lambda v, w: F.min_by(v, F.when(w, F.col("timestamp"))), "LAST": lambda v, w: F.max_by(v, F.when(w, F.col("timestamp"))), "RAND": lambda v, w: F.max_by(v, F.when(w, F.col("_rand")))}

    def over(kind: int, value: Column) -> list[Column]:
        out = []
        for fn in sorted({r.agg.value for r in requests if r.kind == kind}):
            own = (F.col("signal_type") == kind) & (F.col("fn") == fn)
            out.append(order[fn](F.when(own, value), own) if fn in order else ways[kind, fn](F.when(own, value)))
        return out

    def first_set(values: list[Column], default: object, name: str) -> Column:
        return F.coalesce(*[F.when(v != "", v) if default == "" else v for v in values], F.lit(default)).alias(name)

    out = [first_set(over(FLOAT, number), 0.0, "value_number"), first_set(over(STRING, text), "", "value_string")]
    fns = {r.agg.value for r in requests if r.kind == PLACE}
    for c in LOCATION:
        parts = []
        for fn in sorted(fns):
            own = (F.col("signal_type") == PLACE) & (F.col("fn") == fn)
            parts.append(F.avg(F.when(own, F.col(c))) if fn == "AVG" else order[fn](F.when(own, place), own)[c])
        out.append(F.coalesce(*parts, F.lit(0.0)).alias(c))
    return out


def by_interval(signals: DataFrame, requests: list[Request], start: int, end: int, width: int, source: str | None = None) -> DataFrame:
    """(subject, bucket_us, signal_type, signal_index, values...): a row for each bucket that has any row. One bucket
    starts at `start`. Values that a slot doesn't have are 0 or ''. Locations without a fix are left out."""
    if (end - start) > width * MOST_BUCKETS:
        raise ValueError(f"more than {MOST_BUCKETS} buckets")
    rows = dedup.signals(signals.where(between("timestamp", start, end)), [r.name for r in requests], source)
    asked = _requested(rows, requests).where(_passes(requests, True))
    return asked.groupBy("subject", bucket_us(F.col("timestamp"), width, start).alias("bucket_us"), "signal_type", "signal_index").agg(*_measures(requests))


def hull(ranges: DataFrame) -> tuple[int, int] | None:
    """The first start and the last end of ranges (start, end), in microseconds: what a scan can be pruned by."""
    first, last = ranges.agg(F.min(F.unix_micros("start")), F.max(F.unix_micros("end"))).first()
    return None if first is None else (first, last)


def within(rows: DataFrame, ranges: DataFrame, bounds: tuple[int, int] | None) -> DataFrame:
    bounds = bounds or hull(ranges)
    return rows.where(between("timestamp", *bounds)) if bounds else rows.where(F.lit(False))


def by_range(signals: DataFrame, requests: list[Request], ranges: DataFrame, bounds: tuple[int, int] | None = None) -> DataFrame:
    """(subject, seg_idx, signal_type, signal_index, values...) for ranges (subject, seg_idx, start, end), end exclusive.
    A row counts for the first range of its subject that holds it. No value filters; locations without a fix count. Only
    rows within bounds (microseconds; the first start and the last end, which are looked for if they aren't given) are
    read."""
    rows = dedup.signals(within(signals, ranges, bounds), [r.name for r in requests])
    held = _requested(in_first_range(rows, ranges, dedup.SIGNAL_KEY), requests)
    return held.groupBy("subject", "seg_idx", "signal_type", "signal_index").agg(*_measures(requests))


def in_first_range(rows: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """rows (no two with the same key, of which subject is a part) with the smallest seg_idx among the ranges of its
    subject that hold its timestamp. Rows and range starts of a day meet by an equality on (subject, day), each range
    under all days it touches, so that no subject's rows meet all of its ranges. Ranges that overlap no other need no
    choice; only rows in several are ranked by their key."""
    w = W.partitionBy("subject").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("subject").orderBy(F.desc("start"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    alone = (F.coalesce(F.max("end").over(w) <= F.col("start"), F.lit(True))) & (F.coalesce(F.min("start").over(later) >= F.col("end"), F.lit(True)))
    own = ranges.select("subject", "seg_idx", "start", "end").where("start < end").withColumn("_alone", alone)
    own = own.withColumn("_day", F.explode(F.expr("sequence(to_date(start), to_date(end))")))
    met = rows.withColumn("_day", F.to_date("timestamp")).join(own, ["subject", "_day"]).where("timestamp >= start AND timestamp < end").drop("_day", "start", "end")
    several = met.where("NOT _alone").withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("seg_idx"))).where("_n = 1").drop("_n")
    return met.where("_alone").unionByName(several).drop("_alone")


def as_objects(rows: DataFrame, requests: list[Request]) -> DataFrame:
    """(subject, bucket_us, numbers, strings, places): maps from alias to value, one row for each bucket."""
    alias = [(k, i, r.alias or f"{r.name}_{r.agg.value}") for k, i, r in _slots(requests)]
    names = literals(rows.sparkSession, alias, ["signal_type", "signal_index", "alias"])
    one = lambda kind, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("signal_type") == kind, F.struct(F.col("alias"), value.alias("v"))))))
    named = rows.join(F.broadcast(names), ["signal_type", "signal_index"])
    return named.groupBy("subject", "bucket_us").agg(one(FLOAT, F.col("value_number")).alias("numbers"), one(STRING, F.col("value_string")).alias("strings"), one(PLACE, F.struct(*LOCATION)).alias("places"))
