"""The registered queries: each operator over signals, events or envelopes derived from the events table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.filters import ArrayFilter, EventFilter, FloatFilter, LocationFilter, StringFilter
from wayfare.functions.geo import approximate, has_fix
from wayfare.functions.hashing import fnv_bucket
from wayfare.functions.timing import at, micros
from wayfare.operators import aggregate, asof, decode, dedup, enrich, events, latest, raw, rollup, segments
from wayfare.operators.aggregate import Request
from wayfare.operators.raw import Search
from wayfare.plans import serving
from wayfare.schema import LOCATION, FloatAgg, LocationAgg, StringAgg
from wayfare.sources import fixtures
from wayfare.streaming.ingest import Lake, backfill, lag, page

START, END = micros("2024-01-05"), micros("2024-01-12")
ODD = micros("2024-01-05T00:37:13")
HOUR, DAY = 3_600_000_000, 86_400_000_000
WATERMARK = micros("2024-01-15")
NAMES = ["click", "error", "purchase", "signup", "view"]
RING = [(-60.0, -120.0), (40.0, -90.0), (70.0, 60.0), (-10.0, 100.0)]
WIDE = segments.Config(max_gap=3600, min_duration=240, signal_count=10, distinct_count=2, window=3600)
FEW = segments.Config(max_gap=3600, min_duration=240, signal_count=2, distinct_count=2, window=3600)
STATES = segments.Config(max_gap=3600, min_duration=600)
QUIET = segments.Config(max_gap=3600, min_duration=60, max_idle=30)

EVERYTHING = Search(after=0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _us(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as microseconds."""
    for c in columns:
        df = df.withColumn(c, F.unix_micros(c))
    return df


def _numbers(df: DataFrame) -> DataFrame:
    return df.select("subject", "bucket_us", "signal_index", F.round("value_number", 6).alias("value_number"))


FLOATS = [Request("click", a) for a in (FloatAgg.AVG, FloatAgg.MIN, FloatAgg.MAX, FloatAgg.MED, FloatAgg.FIRST, FloatAgg.LAST)]


@query
def signals_hourly_float(spark, d):
    return _numbers(aggregate.by_interval(fixtures.signals(spark, d), [*FLOATS, Request("view", FloatAgg.AVG)], START, END, HOUR))


@query
def signals_anchored_bucket(spark, d):
    return _numbers(aggregate.by_interval(fixtures.signals(spark, d), [Request("click", FloatAgg.AVG)], ODD, END, 5_400_000_000))


@query
def signals_string_aggs(spark, d):
    asked = [Request("view", a) for a in (StringAgg.TOP, StringAgg.UNIQUE, StringAgg.FIRST, StringAgg.LAST)]
    return aggregate.by_interval(fixtures.signals(spark, d), asked, START, END, DAY).select("subject", "bucket_us", "signal_index", "value_string")


@query
def signals_location_aggs(spark, d):
    asked = [Request("view", a) for a in (LocationAgg.FIRST, LocationAgg.LAST, LocationAgg.AVG)]
    rows = aggregate.by_interval(fixtures.signals(spark, d), asked, START, END, DAY)
    return rows.select("subject", "bucket_us", "signal_index", *[F.round(c, 6).alias(c) for c in LOCATION])


@query
def signals_float_filter_or(spark, d):
    test = FloatFilter(gte=20, lt=60, notin=[30.0], any_of=[FloatFilter(gt=400), FloatFilter(isin=[1.0, 2.0])])
    return _numbers(aggregate.by_interval(fixtures.signals(spark, d), [Request("click", FloatAgg.MAX, test), Request("error", FloatAgg.MIN)], START, END, DAY))


@query
def signals_source_filter(spark, d):
    return _numbers(aggregate.by_interval(fixtures.signals(spark, d), [Request("click", FloatAgg.AVG)], START, END, DAY, source="src-1"))


@query
def signals_geo_circle(spark, d):
    near = LocationFilter(circle=(10.0, 20.0, 5000.0))
    rows = aggregate.by_interval(fixtures.signals(spark, d), [Request("view", LocationAgg.FIRST, near)], START, END, DAY)
    return rows.select("subject", "bucket_us", "loc_lat", "loc_lon")


@query
def signals_geo_polygon(spark, d):
    rows = aggregate.by_interval(fixtures.signals(spark, d), [Request("view", LocationAgg.LAST, LocationFilter(polygon=RING))], START, END, DAY)
    return rows.select("subject", "bucket_us", "loc_lat", "loc_lon")


def _ranges(spark, d) -> DataFrame:
    """Three ranges of each subject; the first two overlap."""
    subjects = fixtures.signals(spark, d).select("subject").distinct()
    marks = [(0, "2024-01-05", "2024-01-08"), (1, "2024-01-07", "2024-01-10"), (2, "2024-01-11", "2024-01-12")]
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("seg_idx"), at(micros(a)).alias("start"), at(micros(b)).alias("end")) for i, a, b in marks]))
    return subjects.select("subject", every.alias("r")).select("subject", "r.*")


@query
def signals_ranges(spark, d):
    rows = aggregate.by_range(fixtures.signals(spark, d), [Request("click", FloatAgg.AVG), Request("view", LocationAgg.LAST)], _ranges(spark, d))
    return rows.select("subject", "seg_idx", "signal_type", F.round("value_number", 6).alias("value_number"), "loc_lat", "loc_lon")


@query
def signals_rand(spark, d):
    return _numbers(aggregate.by_interval(fixtures.signals(spark, d), [Request("click", FloatAgg.RAND)], START, END, DAY))


@query
def signals_objects(spark, d):
    asked = [Request("click", FloatAgg.MAX, alias="most"), Request("view", FloatAgg.MIN, alias="least")]
    rows = aggregate.as_objects(aggregate.by_interval(fixtures.signals(spark, d), asked, START, END, DAY), asked)
    return rows.select("subject", "bucket_us", F.col("numbers")["most"].alias("most"), F.col("numbers")["least"].alias("least"))


@query
def dedup_by_sum(spark, d):
    return _us(dedup.signals_by_sum(fixtures.signals(spark, d)).select("subject", "name", "timestamp", "cloud_event_id", "value_number"), "timestamp")


@query
def latest_named(spark, d):
    rows = latest.all_latest(fixtures.signals(spark, d), ["click", "view"])
    return _us(rows.select("subject", "name", "timestamp", "value_number", "value_string"), "timestamp")


@query
def latest_location(spark, d):
    return _us(latest.locations(fixtures.signals(spark, d), ["view"]).select("subject", "timestamp", *LOCATION), "timestamp")


@query
def latest_all(spark, d):
    s = fixtures.signals(spark, d)
    rows = latest.all_latest(s).select("subject", "name", "timestamp", "value_number")
    seen = latest.last_seen(s).withColumn("value_number", F.lit(0.0))
    return _us(rows.unionByName(seen), "timestamp")


@query
def available_signals(spark, d):
    return latest.names(fixtures.signals(spark, d), source="src-1", known=NAMES[:4])


@query
def signal_summaries(spark, d):
    return _us(latest.summaries(fixtures.signals(spark, d)), "first_seen", "last_seen")


@query
def signals_snapshot(spark, d):
    return _us(latest.snapshot(fixtures.signals(spark, d)).select("subject", "name", "kind", "timestamp"), "timestamp")


@query
def data_summary(spark, d):
    s, e = fixtures.signals(spark, d), fixtures.events(spark, d)
    subjects = s.select("subject").distinct().unionByName(spark.createDataFrame([("did:test:none",)], "subject string"))
    rows = latest.data_summary(latest.summaries(s), events.summaries(e), subjects, at(micros("2024-02-01")))
    return _us(rows, "first_seen", "last_seen")


@query
def events_list_filtered(spark, d):
    test = EventFilter(name=StringFilter(notin=["error"], any_of=[StringFilter(startswith="sig")]), source=StringFilter(neq="src-2"), tags=ArrayFilter(contains_any=["click", "view"], not_contains_all=["k1"]))
    return _us(events.listing(fixtures.events(spark, d), START, END, test).select("subject", "name", "timestamp", "source", "tags", "duration_ns"), "timestamp")


@query
def event_counts(spark, d):
    return events.counts(fixtures.events(spark, d), START, END, ["click", "view"])


@query
def event_counts_ranges(spark, d):
    return events.counts_by_range(fixtures.events(spark, d), _ranges(spark, d), ["click", "error"])


@query
def event_summaries(spark, d):
    return _us(events.summaries(fixtures.events(spark, d)), "first_seen", "last_seen")


@query
def location_as_of(spark, d):
    s = fixtures.signals(spark, d)
    probes = s.where("name = 'purchase'").select("subject", F.expr("timestamp_micros(unix_micros(timestamp) + 1000000)").alias("timestamp"))
    return _us(asof.locations_at(s, probes, ["view"]), "timestamp", "loc_ts")


@query
def location_at_point(spark, d):
    return _us(asof.location_at(fixtures.signals(spark, d), "did:test:3", END, ["view"]), "timestamp")


def _fleet(spark, d) -> DataFrame:
    return fixtures.signals(spark, d).withColumn("subject", F.lit("fleet"))


@query
def windowed_counts(spark, d):
    return segments.active_windows(_fleet(spark, d), START, END, WIDE)


@query
def cusum_active_windows(spark, d):
    return segments.cusum(segments.active_windows(_fleet(spark, d), START, END, WIDE)).select("subject", "window_us", "n", "cusum")


@query
def segments_frequency(spark, d):
    return segments.frequency(fixtures.signals(spark, d), START, END, FEW, END + DAY)


@query
def segments_frequency_ongoing(spark, d):
    return segments.frequency(_fleet(spark, d), START, END, WIDE, END)


@query
def segments_changepoint(spark, d):
    return segments.change_point(fixtures.signals(spark, d), START, END, FEW, END + DAY)


def _states(spark, d) -> DataFrame:
    rows = dedup.first_of(fixtures.signals(spark, d), ["subject", "timestamp"], ["cloud_event_id"])
    return rows.select("subject", "timestamp", F.when(F.col("value_number") > 30, 1.0).otherwise(0.0).alias("value"))


def _levels(spark, d, name: str) -> DataFrame:
    rows = dedup.signals(fixtures.signals(spark, d), [name])
    return rows.select("subject", "timestamp", F.col("value_number").alias("value"))


@query
def ignition_changes(spark, d):
    return _us(segments.state_changes(_states(spark, d), START, END, 2 * DAY), "timestamp")


@query
def segments_ignition(spark, d):
    return segments.ignition(_states(spark, d), START, END, STATES)


@query
def idle_runs(spark, d):
    return segments.idle_runs(_levels(spark, d, "view"), START, END, QUIET)


@query
def segments_idling(spark, d):
    moving = _levels(spark, d, "error").withColumn("value", F.col("value") - 100)
    return segments.idling(_levels(spark, d, "view"), moving, START, END, QUIET)


def _level_curve(spark, d) -> DataFrame:
    """A sawtooth of ten minutes' samples for each subject: falls slowly, then jumps up."""
    subjects = fixtures.signals(spark, d).select("subject").distinct()
    steps = subjects.select("subject", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2015).cast("bigint"))).alias("i"), (F.substring("subject", 10, 4).cast("int")).alias("k"))
    return steps.select("subject", F.timestamp_micros(F.lit(START) + F.col("i") * 300_000_000).alias("timestamp"), (90 - (F.col("i") + F.col("k") * 7) % 120 * 0.6).cast("double").alias("value"))


@query
def segments_refuel(spark, d):
    return segments.refuel(_level_curve(spark, d), START, END, segments.Config(min_duration=60))


@query
def segments_recharge(spark, d):
    curve = _level_curve(spark, d).withColumn("value", 100 - F.col("value"))
    still = curve.withColumn("value", F.lit(7.0))
    return segments.recharge(curve, still, START, END, segments.Config())


@query
def segments_page(spark, d):
    return segments.page(segments.frequency(fixtures.signals(spark, d), START, END, FEW, END + DAY), 3, START + DAY)


@query
def segment_enrichment(spark, d):
    found = segments.frequency(fixtures.signals(spark, d), START, END, FEW, END + DAY)
    ranges = segments.as_ranges(found, END)
    speeds = aggregate.by_range(fixtures.signals(spark, d), [Request("view", FloatAgg.MAX)], ranges).select("subject", "seg_idx", F.col("value_number").alias("most"))
    counts = events.counts_by_range(fixtures.events(spark, d), ranges, ["click"]).select("subject", "seg_idx", F.col("count").alias("clicks"))
    out = ranges.join(speeds, ["subject", "seg_idx"], "left").join(counts, ["subject", "seg_idx"], "left")
    return out.select("subject", "seg_idx", F.unix_micros("start").alias("start_us"), "most", F.coalesce("clicks", F.lit(0).cast("bigint")).alias("clicks"))


@query
def daily_activity(spark, d):
    found = segments.frequency(fixtures.signals(spark, d), START, END, FEW, END + DAY)
    days = segments.civil_days("2024-01-05", "2024-01-11", "America/New_York", spark)
    return segments.daily_activity(found, days).withColumn("day", F.col("day").cast("string"))


def _raw(df: DataFrame) -> DataFrame:
    return _us(df.select("subject", "time", "type", "id", "source"), "time")


@query
def raw_list(spark, d):
    return _raw(raw.listing(fixtures.raw(spark, d), Search(isin={"subject": ["did:test:1", "did:test:2"]}, notin={"source": ["src-0"]}, after=START, before=END), 500, newest=False))


@query
def raw_latest(spark, d):
    return _raw(raw.latest(fixtures.raw(spark, d), Search(isin={"type": ["fleet.status"]}, now=END)))


@query
def raw_found(spark, d):
    return _raw(raw.found(fixtures.raw(spark, d), EVERYTHING))


@query
def raw_type_summaries(spark, d):
    return _us(raw.type_summaries(fixtures.raw(spark, d), EVERYTHING), "first_seen", "last_seen")


@query
def raw_tags_filter(spark, d):
    return _raw(raw.found(fixtures.raw(spark, d), Search(after=0, tags=ArrayFilter(contains_any=["click", "view"], not_contains_any=["k3"], contains_all=["k1"]))))


@query
def raw_payloads(spark, d):
    """Half of the indexes have another source than their row, so that the newest row of the id stands in."""
    r = fixtures.raw(spark, d)
    indexes = raw.found(r, EVERYTHING).withColumn("source", F.when(F.col("producer") == "prod-0", "elsewhere").otherwise(F.col("source")))
    return _us(raw.payloads(r, indexes).select("subject", "id", "time", "type", "source", "data"), "time")


@query
def decode_signals(spark, d):
    rows = decode.signals(fixtures.status_payloads(spark, d)).rows
    return _us(rows.select("subject", "cloud_event_id", "name", "timestamp", "value_number", "value_string", "loc_lat", "loc_lon", "loc_hdop"), "timestamp")


@query
def decode_signal_errors(spark, d):
    return decode.signals(fixtures.status_payloads(spark, d)).errors


@query
def decode_events(spark, d):
    rows = decode.events(fixtures.event_payloads(spark, d), [*NAMES, "broken", "tagged"]).rows
    return _us(rows.select("subject", "cloud_event_id", "name", "timestamp", "duration_ns", "metadata", F.to_json("tags").alias("tags")), "timestamp")


@query
def coordinate_merge(spark, d):
    """Three parts of a location from each event, the last of them late for every third."""
    s = fixtures.with_bucket(fixtures.signals(spark, d)).withColumn("producer", F.lit("p"))
    lag = lambda n: F.expr(f"timestamp_micros(unix_micros(timestamp) + {n})")
    late = F.when(F.substring("cloud_event_id", -1, 1).isin("0", "3", "6", "9"), lag(600_000)).otherwise(lag(200_000))
    part = lambda name, v, t: s.withColumn("name", F.lit(name)).withColumn("value_number", F.col(v)).withColumn("timestamp", t).withColumn("value_string", F.lit(""))
    rows = part(decode.LATITUDE, "loc_lat", F.col("timestamp")).unionByName(part(decode.LONGITUDE, "loc_lon", lag(100_000))).unionByName(part(decode.HDOP, "loc_hdop", late))
    found = decode.merged_coordinates(rows.withColumns({c: F.lit(0.0) for c in LOCATION}))
    return _us(found.select("subject", "cloud_event_id", "timestamp", "loc_lat", "loc_lon", "loc_hdop"), "timestamp")


def _rollup(df: DataFrame) -> DataFrame:
    return _us(df.select(*rollup.COLUMNS), "timestamp", "loc_ts", "first_seen", "last_seen")


@query
def rollup_signals(spark, d):
    return _rollup(rollup.full(fixtures.signals(spark, d)))


@query
def rollup_events(spark, d):
    return _us(rollup.of_events(fixtures.events(spark, d)), "first_seen", "last_seen")


@query
def rollup_incremental(spark, d):
    """Out of order: the second half of the ids is folded into the first, with copies that win in neither or in both."""
    s = fixtures.signals(spark, d)
    late = F.pmod(F.xxhash64("cloud_event_id"), F.lit(2)) == 1
    base, batch = s.where(~late), s.where(late)
    return _rollup(rollup.fold(rollup.full(base), batch, base))


@query
def rollup_advanced(spark, d):
    s = fixtures.signals(spark, d)
    return _rollup(rollup.advance(rollup.full(rollup.below(s, START)), s, START, WATERMARK))


@query
def summaries_watermark_union(spark, d):
    s = fixtures.signals(spark, d)
    return _us(rollup.served_summaries(rollup.full(rollup.below(s, WATERMARK)), s, WATERMARK), "first_seen", "last_seen")


@query
def rollup_diff(spark, d):
    s = fixtures.signals(spark, d)
    return rollup.diff(rollup.full(s.where("name <> 'click'")), rollup.full(rollup.below(s, WATERMARK).where("name <> 'view'")))


@query
def rollup_shadow_comparison(spark, d):
    s = fixtures.signals(spark, d)
    return rollup.compared(rollup.full(s), rollup.full(rollup.below(s, WATERMARK).where("name <> 'view'")).unionByName(rollup.full(s.where("name = 'view' AND subject = 'did:test:1'"))))


@query
def rollup_cardinality(spark, d):
    once = rollup.full(fixtures.signals(spark, d))
    return rollup.cardinality(once.unionByName(once.where("name = 'click'")))


@query
def insert_anti_join(spark, d):
    s = fixtures.signals(spark, d)
    rows = rollup.inserted(s.where("name <> 'click'"), s.where(F.col("timestamp") >= at(WATERMARK)))
    return rows.groupBy("subject", "name").agg(F.count("*").alias("count"))


@query
def prune_orphans(spark, d):
    s = fixtures.signals(spark, d).where(F.col("name").isin("view", "error") | (F.col("timestamp") < at(WATERMARK)))
    _, left = rollup.pruned(s, rollup.full(s), WATERMARK)
    return _us(left.select("subject", "name", "last_seen"), "last_seen")


@query
def late_subject_repair(spark, d):
    s = fixtures.signals(spark, d)
    stale = rollup.full(rollup.below(s, WATERMARK).where("NOT (subject = 'did:test:5' AND source = 'src-1')"))
    return _rollup(rollup.repaired(stale, s, spark.createDataFrame([("did:test:5",)], "subject string"), WATERMARK))


@query
def latest_fold(spark, d):
    return _us(rollup.latest_fold(fixtures.signals(spark, d)), "timestamp", "loc_ts")


@query
def privilege_filtered_snapshot(spark, d):
    needs = [(n, ["read"] if i % 2 else ["read", "locate"]) for i, n in enumerate(NAMES[:4])]
    held = latest.allowed(latest.snapshot(fixtures.signals(spark, d)), spark.createDataFrame(needs, "name string, needs array<string>"), ["read"])
    return _us(held.select("subject", "name", "timestamp"), "timestamp")


@query
def subject_buckets(spark, d):
    return fixtures.signals(spark, d).select("subject").distinct().withColumn("subject_bucket", fnv_bucket(F.col("subject")))


@query
def fixes_in_polygon(spark, d):
    s = dedup.signals(fixtures.signals(spark, d)).where(has_fix())
    return s.where(LocationFilter(polygon=RING).on(F.col("loc_lat"), F.col("loc_lon"))).groupBy("subject").agg(F.count("*").alias("count"))


@query
def blob_roundtrip(spark, d):
    """Payloads sealed with AES-GCM and opened again; every third is plain."""
    rows = fixtures.raw(spark, d).select("subject", "id", "type", F.unix_micros("time").alias("time"), F.encode("data", "UTF-8").alias("data"))
    secret = F.encode(F.lit("0123456789abcdef0123456789abcdef"), "UTF-8")
    key = F.concat(F.lit("cloudevent/blobs/"), F.col("id"))
    sealed = F.concat(F.encode(F.lit("DBE1"), "UTF-8"), F.aes_encrypt("data", secret, F.lit("GCM"), F.lit("DEFAULT"), F.encode(F.lit("123456789012"), "UTF-8"), key))
    stored = F.when(F.col("time") % 3 == 0, F.col("data")).otherwise(sealed)
    return rows.withColumn("stored", stored).select("subject", "id", "type", "time", F.decode(raw.blob(F.col("stored"), (secret, key)), "UTF-8").alias("data"))


@query
def segment_events_zero_filled(spark, d):
    ranges = segments.as_ranges(segments.frequency(fixtures.signals(spark, d), START, END, FEW, END + DAY), END)
    names = ["signup", "purchase"]
    return enrich.event_summary(ranges, events.counts_by_range(fixtures.events(spark, d), ranges, names), names)


@query
def segment_locations(spark, d):
    s = fixtures.signals(spark, d)
    ranges = segments.as_ranges(segments.frequency(s, START, END, FEW, END + DAY), END)
    found = aggregate.by_range(s, [Request("view", LocationAgg.FIRST), Request("view", LocationAgg.LAST)], ranges)
    side = lambda i: found.where(F.col("signal_index") == i)
    return enrich.boundary_locations(ranges, side(0), side(1), s, ["view"])


@query
def rollup_flushed(spark, d):
    s = fixtures.signals(spark, d)
    dirty = rollup.late_subjects(s.where("name = 'error' AND subject IN ('did:test:3', 'did:test:4')"), WATERMARK)
    stale = rollup.full(s.where("NOT (subject IN ('did:test:3', 'did:test:4') AND name = 'view')"))
    return _rollup(rollup.flushed(stale, s, dirty))


@query
def approximate_locations(spark, d):
    """The middles of the H3 cells of all fixes' places, as millionths of a degree."""
    places = fixtures.signals(spark, d).where(has_fix()).select("loc_lat", "loc_lon").distinct()
    near = approximate(F.col("loc_lat") * 0.9 + 0.123, F.col("loc_lon") + 0.456)
    whole = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    return places.withColumn("c", near).select("loc_lat", "loc_lon", whole("c.lat").alias("lat"), whole("c.lon").alias("lon"))


@query
def decode_last_in_payload(spark, d):
    rows = decode.batch(fixtures.repeated_payloads(spark, d)).signals
    return _us(rows.select("subject", "cloud_event_id", "name", "timestamp", "value_number"), "timestamp")


def _steady(spark, d) -> DataFrame:
    """Some subjects are on, or off, at all times; some since before the lookback only."""
    k = F.substring("subject", 10, 4).cast("int")
    value = F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 0.0).when(k % 4 == 2, F.when(F.col("timestamp") < at(START - HOUR), 1.0)).otherwise(F.col("value"))
    return _states(spark, d).withColumn("value", value)


@query
def ignition_steady(spark, d):
    return _us(segments.state_changes(_steady(spark, d), START, END, 2 * DAY), "timestamp")


@query
def segments_ignition_steady(spark, d):
    return segments.ignition(_steady(spark, d), START, END, STATES)


def _envelopes(spark, d) -> DataFrame:
    return fixtures.status_payloads(spark, d).unionByName(fixtures.event_payloads(spark, d))


@cache
def _ingested(spark, d) -> Lake:
    """One lake for all queries of a run. Two batches of a stream, the first of them twice, a backfill of what they left out and of some that they didn't,
    and a third batch."""
    rows = _envelopes(spark, d)
    part = lambda *k: rows.where(F.pmod(F.xxhash64("id"), F.lit(4)).isin(*k))
    lake = Lake(spark, fixtures.scratch(spark), "month")
    for number, some in ((0, part(0)), (0, part(0)), (1, part(1))):
        lake.append(decode.batch(some), "feed", number)
    backfill(lake, part(1, 2), "2024-01-01", "2100-01-01")
    lake.append(decode.batch(part(3, 0)), "feed", 2)
    return lake


@query
def ingest_rollup(spark, d):
    return _rollup(_ingested(spark, d).rollup())


@query
def ingest_events(spark, d):
    rows = _ingested(spark, d).events()
    return _us(rows.select("subject", "cloud_event_id", "name", "timestamp", "duration_ns", "metadata", F.to_json("tags").alias("tags")), "timestamp")


@query
def ingest_errors(spark, d):
    rows = _ingested(spark, d).errors()
    return rows.groupBy("name", "error").agg(F.countDistinct("id").alias("ids"))


@query
def ingest_daily(spark, d):
    """The daily rollup moves twice; in between come rows from before its watermark."""
    rows = fixtures.status_payloads(spark, d)
    late = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    lake = Lake(spark, fixtures.scratch(spark), "month")
    lake.append(decode.batch(rows.where(~late)), "feed", 0)
    lake.advance(START + DAY // 2)
    lake.append(decode.batch(rows.where(late)), "feed", 1)
    lake.advance(WATERMARK + DAY // 2)
    return _rollup(lake.rollup("daily"))


@query
def feed_page(spark, d):
    r = fixtures.raw(spark, d).where("type = 'fleet.status'")
    return _raw(page(r, (START, "did:test:7", "id-5"), 500, 3000))


@query
def cache_bootstrap(spark, d):
    s = fixtures.signals(spark, d)
    return _us(serving.bootstrapped(rollup.full(rollup.below(s, WATERMARK)), s, WATERMARK), "timestamp", "loc_ts")


@query
def cache_answers(spark, d):
    """The cache lacks every third subject; half of all are asked for, and some that nobody has."""
    s = fixtures.signals(spark, d)
    stored = rollup.full(s)
    k = F.substring("subject", 10, 4).cast("int")
    cache = rollup.latest_fold(s).where(k % 3 != 0)
    asked = s.select("subject").distinct().where(k % 2 == 0).unionByName(spark.createDataFrame([("did:test:90",), ("did:test:91",)], "subject string"))
    found = serving.answer(asked, cache, stored, serving.Mode.SERVE)
    missed = serving.answer(asked, cache, stored, serving.Mode.SERVE, serving.Mode.SERVE, True).where("origin = 'cache_miss'")
    return _us(found.unionByName(missed).select("subject", "origin", "name", "timestamp", "value_number"), "timestamp")


@query
def cache_keys(spark, d):
    return fixtures.signals(spark, d).select("subject").distinct().withColumn("key", serving.key(F.concat(F.lit("ÿ~"), F.col("subject"))))


@query
def daily_summary(spark, d):
    """Each day of each subject: segments, active seconds and counts of two events."""
    s = fixtures.signals(spark, d)
    found = segments.frequency(s, START, END, FEW, END + DAY)
    days = segments.civil_days("2024-01-05", "2024-01-11", "America/New_York", spark)
    ranges = segments.by_day(s.select("subject"), days)
    counts = enrich.event_summary(ranges, events.counts_by_range(fixtures.events(spark, d), ranges, ["click", "signup"]), ["click", "signup"])
    counts = counts.groupBy("subject", "seg_idx").pivot("name", ["click", "signup"]).agg(F.first("count"))
    active = segments.daily_activity(found, days).select("subject", "day", "n_segments", "active_s")
    out = ranges.join(active, ["subject", "day"], "left").join(counts, ["subject", "seg_idx"])
    zero = F.lit(0).cast("bigint")
    return out.select("subject", F.col("day").cast("string").alias("day"), F.coalesce("n_segments", zero).alias("n_segments"), F.coalesce("active_s", zero).alias("active_s"), "click", "signup")


@query
def rollup_new_keys(spark, d):
    s = fixtures.signals(spark, d)
    rows = rollup.new_keys(s.where(F.col("timestamp") >= at(START)), s.where((F.col("name") != "click") & (F.col("timestamp") < at(WATERMARK))))
    return rows.groupBy("subject", "name").agg(F.count("*").alias("count"))


@query
def raw_cloud_search(spark, d):
    """As a call for one subject: a type or another, and a source."""
    found = [raw.found(fixtures.raw(spark, d), Search.cloud(f"did:test:{i}", "fleet.status", ["fleet.none"], after="2024-01-05", before="2024-01-12", source="src-1")) for i in (3, 8)]
    return _raw(found[0].unionByName(found[1]))


@query
def raw_restored(spark, d):
    rows = raw.restored(raw.found(fixtures.raw(spark, d), EVERYTHING).withColumn("extras", F.when(F.col("producer") == "prod-0", F.concat(F.lit("["), "extras")).otherwise(F.col("extras"))))
    return _us(rows.select("subject", "id", "type", "source", "time", F.to_json("tags").alias("tags"), "malformed"), "time")


@query
def feed_lag(spark, d):
    rows = lag(fixtures.raw(spark, d), micros("2024-02-10"))
    return rows.select("n", *[F.round(c, 4).alias(c) for c in ("oldest_s", "median_s", "p95_s", "late_share")])


@query
def signals_default_aggs(spark, d):
    """Aggregates that nobody knows: of numbers the average, of locations the first."""
    asked = [Request.of("click", aggregate.FLOAT, "WHAT"), Request.of("view", aggregate.PLACE, "")]
    rows = aggregate.by_interval(fixtures.signals(spark, d), asked, START, END, DAY)
    return rows.select("subject", "bucket_us", "signal_type", F.round("value_number", 6).alias("value_number"), "loc_lat", "loc_lon")


@query
def privilege_one_of(spark, d):
    needs = [(n, ["read"] if i % 2 else ["locate", "write"]) for i, n in enumerate(NAMES[:4])]
    held = latest.allowed(latest.names(fixtures.signals(spark, d)), spark.createDataFrame(needs, "name string, needs array<string>"), ["write", "other"], one=True)
    return held.select("subject", "name")
