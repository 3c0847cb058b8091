"""Golden values, differential tests, plans and ingestion."""

import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.functions.filters import ArrayFilter, EventFilter, FloatFilter, LocationFilter, StringFilter
from wayfare.functions.geo import approximate
from wayfare.functions.hashing import bucket_of, fnv_bucket
from wayfare.functions.tables import literals
from wayfare.functions.timing import duration_us, micros
from wayfare.operators import aggregate, decode, dedup, latest, raw, rollup, segments
from wayfare.operators.aggregate import Request
from wayfare.operators.raw import Search
from wayfare.plans import access
from wayfare.plans.access import Claims, Denied, authorized
from wayfare.plans.api import Telemetry, source_address
from wayfare.plans.serving import Coverage, Mode, backoff
from wayfare.schema import SIGNALS, FloatAgg, LocationAgg, Mechanism, StringAgg
from wayfare.streaming.ingest import Conflict, Lake, backfill, ingest, lag, page

T0 = datetime(2026, 6, 1)


def signals(spark, rows):
    """rows: (seconds, name, number, string, lat, lon, source, id)."""
    full = []
    for i, r in enumerate(rows):
        t, name, number, text, lat, lon, source, id_ = (*r, *[None] * 8)[:8]
        full.append(("s", 0, name, T0 + timedelta(seconds=t), source or "a", "p", id_ or f"ce-{i:04}", float(number or 0), text or "", float(lat or 0), float(lon or 0), 0.5, 90.0))
    return spark.createDataFrame(full, SIGNALS)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


START = micros("2026-06-01")
MINUTE = 60_000_000


def test_interval_aggregates(spark):
    s = signals(spark, [(10, "speed", 10), (50, "speed", 30), (70, "speed", 50), (150, "speed", 20)])
    asked = [Request("speed", a) for a in (FloatAgg.AVG, FloatAgg.MIN, FloatAgg.MAX, FloatAgg.FIRST, FloatAgg.LAST, FloatAgg.MED)]
    got = aggregate.by_interval(s, asked, START, START + 10 * MINUTE, MINUTE)
    by = {(r.bucket_us - START) // MINUTE: [] for r in got.collect()}
    for r in got.orderBy("signal_index").collect():
        by[(r.bucket_us - START) // MINUTE].append(r.value_number)
    assert by == {0: [20, 10, 30, 10, 30, 20], 1: [50] * 6, 2: [20] * 6}


def test_anchored_buckets(spark):
    s = signals(spark, [(10, "speed", 10), (50, "speed", 30), (70, "speed", 50), (150, "speed", 20)])
    got = aggregate.by_interval(s, [Request("speed", FloatAgg.AVG)], START + MINUTE // 2, START + 10 * MINUTE, MINUTE)
    assert values(got, "bucket_us", "value_number") == [(START + 30_000_000, 40), (START + 150_000_000, 20)]


def test_strings(spark):
    s = signals(spark, [(5, "type", 0, "HEV"), (45, "type", 0, "EV"), (55, "type", 0, "EV"), (65, "type", 0, "EV")])
    asked = [Request("type", a) for a in (StringAgg.FIRST, StringAgg.LAST, StringAgg.UNIQUE, StringAgg.TOP)]
    got = aggregate.by_interval(s, asked, START, START + MINUTE, MINUTE)
    assert values(got, "signal_index", "value_string") == [(0, "HEV"), (1, "EV"), (2, "EV,HEV"), (3, "EV")]


def test_locations_without_a_fix(spark):
    s = signals(spark, [(20, "loc", 0, "", 1, 2), (40, "loc", 0, "", 3, 4), (80, "loc"), (100, "loc", 0, "", 5, 6)])
    asked = [Request("loc", a) for a in (LocationAgg.FIRST, LocationAgg.LAST, LocationAgg.AVG)]
    got = aggregate.by_interval(s, asked, START, START + 10 * MINUTE, MINUTE)
    assert values(got, "bucket_us", "signal_index", "loc_lat", "loc_lon") == [(START, 0, 1, 2), (START, 1, 3, 4), (START, 2, 2, 3), *[(START + MINUTE, i, 5, 6) for i in range(3)]]


def test_source_filter_is_below_the_deduplication(spark):
    s = signals(spark, [(1, "speed", 1, "", 0, 0, "a", "id-1"), (1, "speed", 2, "", 0, 0, "b", "id-2")])
    assert values(dedup.signals(s, source="b"), "value_number") == [(2,)]
    assert values(dedup.signals(s), "value_number") == [(1,)]


def test_scan_gets_the_filters(spark, tmp_path):
    signals(spark, [(i, "speed", i) for i in range(9)]).write.parquet(f"{tmp_path}/s")
    plan = dedup.signals(spark.read.parquet(f"{tmp_path}/s"), ["speed"], "a").select("value_number")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,a)" in plan and "WindowGroupLimit" in plan and "loc_lat" not in plan


def test_or_is_against_the_whole_group(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    kept = rows.where(FloatFilter(gt=2, lt=5, any_of=[FloatFilter(eq=9)]).on(rows.v))
    assert values(kept, "v") == [(3,), (4,), (9,)]


def test_arrays_with_nulls(spark):
    rows = spark.createDataFrame([(["a", None],), ([None],), ([],)], "v array<string>")
    assert rows.where(ArrayFilter(contains_any=["b", "a"]).on(rows.v)).count() == 1
    assert rows.where(ArrayFilter(not_contains_any=["a"]).on(rows.v)).count() == 2


def test_bucket(spark):
    names = ["", "did:erc721:137:0xbA5738a18d83D41847dfFbDC6101d37C69c9B0cF:1", "é"]
    rows = spark.createDataFrame([(n,) for n in names], "s string")
    assert values(rows.select("s", fnv_bucket(rows.s).alias("b")), "s", "b") == sorted((n, bucket_of(n)) for n in names)


def test_durations():
    assert [duration_us(x) for x in ("300ms", "2h45m", "1.5h")] == [300_000, 9_900_000_000, 5_400_000_000]
    for bad in ("", "5", "1d", "1ns"):
        with pytest.raises(ValueError):
            duration_us(bad)


def windows(spark, starts, n=10):
    rows = [(60 * m + i % 55, f"n{i % 2}", i) for m in starts for i in range(2 * n)]
    return signals(spark, rows)


def test_frequency_merges(spark):
    s = windows(spark, [0, 1, 4])
    got = segments.frequency(s, START, START + 60 * MINUTE, segments.Config(max_gap=300, min_duration=60, signal_count=5), START + 600 * MINUTE)
    assert values(got, "start_us", "end_us", "duration_s", "ongoing") == [(START, START + 5 * MINUTE, 300, False)]


def test_clip_keeps_what_began_before(spark):
    s = windows(spark, [-4, -3, -2, -1, 0])
    got = segments.frequency(s, START, START + 60 * MINUTE, segments.Config(max_gap=300, min_duration=120, signal_count=5), START + 600 * MINUTE)
    assert values(got, "start_us", "end_us", "started_before") == [(START, START + MINUTE, True)]


def test_cusum(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([1, 100, 1, 0, 0, 3])], "subject string, window_us bigint, n bigint")
    got, s = [], 0.0
    for n in (1, 100, 1, 0, 0, 3):
        s = max(0.0, s + n - 1.5)
        got.append(s)
    assert [r.cusum for r in segments.cusum(rows).orderBy("window_us").collect()] == got


def levels(spark, pairs):
    return spark.createDataFrame([("s", T0 + timedelta(seconds=t), float(v)) for t, v in pairs], "subject string, timestamp timestamp, value double")


def test_ignition(spark):
    states = levels(spark, [(-300, 0), (600, 1), (1200, 0)])
    assert values(segments.ignition(states, START, START + 3600_000_000, segments.Config()), "start_us", "duration_s", "ongoing") == [(START + 600_000_000, 600, False)]


def test_ignition_noise_and_open_end(spark):
    states = levels(spark, [(0, 1), (600, 0), (700, 1)])
    got = segments.ignition(states, START, START + 3600_000_000, segments.Config())
    assert values(got, "start_us", "end_us", "duration_s", "ongoing") == [(START, None, 3600, True)]


def test_ignition_on_throughout(spark):
    day = 86_400
    on = levels(spark, [(-40 * day, 1), (-20 * day, 1), (600, 1)])
    off = levels(spark, [(-20 * day, 0), (600, 0)]).withColumn("subject", F.lit("off"))
    old = levels(spark, [(-40 * day, 1)]).withColumn("subject", F.lit("old"))
    early = levels(spark, [(-40 * day, 1), (600, 1), (1200, 0)]).withColumn("subject", F.lit("early"))
    states = on.union(off).union(old).union(early)
    end = START + 3600_000_000
    changes = segments.state_changes(states, START, end, 30 * day * 1_000_000)
    assert [(r.subject, r.timestamp - T0, r.state, r.previous) for r in changes.orderBy("subject").collect()] == [("early", timedelta(seconds=1200), 0.0, 1.0), ("s", timedelta(days=-20), 1.0, 0.0)]
    got = segments.ignition(states, START, end, segments.Config())
    assert values(got, "subject", "start_us", "end_us", "ongoing", "started_before") == [("s", START - 20 * day * 1_000_000, None, True, True)]


def test_idle_runs(spark):
    rpm = levels(spark, [(0, 800), (100, 900), (200, 2000), (300, 700), (900, 700), (1000, 0)])
    got = segments.idle_runs(rpm, START, START + 3600_000_000, segments.Config(max_gap=300))
    assert values(got, "start_us", "end_us") == [(START, START + 100_000_000), (START + 300_000_000,) * 2, (START + 900_000_000,) * 2]


def test_refuel(spark):
    fuel = levels(spark, [(60 * m, 20 if m < 30 else 80) for m in range(60)])
    (row,) = segments.refuel(fuel, START, START + 60 * MINUTE, segments.Config(min_duration=60)).collect()
    assert START + 25 * MINUTE <= row.start_us < START + 30 * MINUTE and row.end_us >= START + 30 * MINUTE


def test_recharge(spark):
    soc = levels(spark, [(60 * i, 20 + 3 * i) for i in range(21)])
    still = levels(spark, [(60 * i, 100) for i in range(21)])
    got = segments.recharge(soc, still, START, START + 60 * MINUTE, segments.Config())
    assert values(got, "start_us", "end_us", "duration_s") == [(START + 5 * MINUTE, START + 15 * MINUTE, 600)]
    moving = levels(spark, [(60 * i, 100 + i) for i in range(21)])
    assert segments.recharge(soc, moving, START, START + 60 * MINUTE, segments.Config()).count() == 0


def test_civil_days(spark):
    days = segments.civil_days("2025-03-09", "2025-03-10", "America/New_York", spark)
    assert [(r.day_end - r.day_start) // 3_600_000_000 for r in days.orderBy("day").collect()] == [23, 24]


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], "subject string, name string, count bigint, first_seen timestamp, last_seen timestamp")
    from pyspark.sql import functions as F

    (row,) = latest.data_summary(none, none, spark.createDataFrame([("x",)], "subject string"), F.lit(T0)).collect()
    assert (row.n_signals, row.n_events, row.first_seen, row.last_seen) == (0, 0, T0, datetime(1900, 1, 1))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**6))
def test_fold_equals_recomputation(spark, seed):
    """Redelivery, collisions with smaller and larger ids, rows out of order, fixes that come and go."""
    rng = random.Random(seed)
    rows = [(rng.randrange(12), rng.choice("ab"), rng.randrange(9), rng.choice(["", "x"]), *rng.choice([(0, 0), (1, 2), (3, 4)]), None, f"id-{rng.randrange(40):03}") for _ in range(60)]
    rows = [(t, n, hash((t, n, id_)) % 50, "", *((0, 0) if hash((n, id_, t)) % 3 else (1 + t, 2)), None, id_) for t, n, _, _, _, _, _, id_ in rows]
    base, first, second = rows[:30], rows[25:45], rows[40:]
    stored = rollup.full(signals(spark, base))
    stored = rollup.fold(stored, signals(spark, first), signals(spark, base))
    stored = rollup.fold(stored, signals(spark, second), signals(spark, base + first))
    want = rollup.full(signals(spark, base + first + second))
    assert rollup.diff(stored.select(*want.columns), want).count() == 0
    assert stored.count() == want.count()


def envelopes(spark, payloads, start=0):
    from wayfare.schema import RAW

    rows = [("s", T0 + timedelta(seconds=start + i), "fleet.status", f"e-{start + i}", "a", "p", "", "v1", "{}", p, None, "", "") for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, RAW)


def payload(name, value, second=0):
    return f'{{"signals":[{{"timestamp":"2026-06-01T00:00:{second:02}Z","name":"{name}","value":{value}}}]}}'


def test_decode_keeps_siblings(spark):
    data = ['{"signals":[{"timestamp":"2026-06-01T00:00:01Z","name":"speed","value":"12.5"},{"timestamp":"2026-06-01T00:00:01Z","name":"speed2","value":1},{"timestamp":"2026-06-01T00:00:02Z","name":"powertrainType","value":3},{"timestamp":"2026-06-01T00:00:02Z","name":"powertrainType","value":"EV"}]}', "not json", payload("speed", '"NaN"')]
    got = decode.signals(envelopes(spark, data))
    assert values(got.rows, "name", "value_number", "value_string") == [("powertrainType", 0.0, "EV"), ("speed", 12.5, "")]
    assert values(got.errors, "name", "error") == [("powertrainType", "no string"), ("speed", "no number"), ("speed2", "unknown name")]


def test_voiding_is_by_subject(spark):
    rows = spark.createDataFrame([("s", T0, "t", "1", "a", "p", "v", "{}", ""), ("s", T0, "t", "2", "a", "p", "v", "{}", "1"), ("r", T0, "t", "1", "a", "p", "v", "{}", "")], "subject string, time timestamp, type string, id string, source string, producer string, data_version string, extras string, voids_id string")
    assert values(raw.found(rows, Search(after=0)), "subject", "id") == [("r", "1")]
    with pytest.raises(ValueError):
        Search(tags=ArrayFilter(any_of=[ArrayFilter(contains_any=["a"])]))


def test_last_of_a_payload_stays(spark):
    at = '"timestamp":"2026-06-01T00:00:01Z","name":"speed"'
    data = f'{{"signals":[{{{at},"value":10}},{{{at},"value":90}},{{{at},"value":"20"}},{{{at},"value":"x"}}]}}'
    got = decode.batch(envelopes(spark, [data]))
    assert values(got.signals, "value_number") == [(20.0,)] and values(got.errors, "error") == [("no number",)]


def test_routing_and_gate(spark):
    vehicle = "did:erc721:137:0xAB00000000000000000000000000000000000000:7"
    rows = envelopes(spark, [payload("speed", 5), payload("speed", 6), payload("speed", 7), '{"events":[{"name":"stop","timestamp":"2026-06-01T00:00:01Z","tags":[]}]}'])
    i = F.substring("id", 3, 1)
    rows = rows.withColumn("subject", F.when(i == 0, vehicle).otherwise("did:erc721:137:0xCC00000000000000000000000000000000000000:7")).withColumn("type", F.when(i == 2, "fleet.other").when(i == 3, "fleet.events").otherwise("fleet.status"))
    got = decode.batch(rows, decode.Registry(chain=137, contract="0xab00000000000000000000000000000000000000"))
    assert values(got.signals, "subject", "value_number") == [(vehicle, 5.0)] and values(got.events, "name") == [("stop",)]
    assert decode.batch(rows).signals.count() == 2
    assert decode.batch(rows, decode.Registry(known=["start"])).errors.count() == 1


def same_rollup(spark, lake, want):
    got = lake.rollup().select(*rollup.COLUMNS)
    assert rollup.diff(got, rollup.full(want).select(*rollup.COLUMNS)).count() == 0 and got.count() == rollup.full(want).count()


def test_stream_equals_batch(spark, tmp_path):
    batches = [envelopes(spark, [payload("speed", v, i) for i, v in enumerate(range(5))]), envelopes(spark, [payload("speed", 50 + i, i + 3) for i in range(5)], 100), envelopes(spark, [payload("speed", 1, 1)], 1)]
    lake = Lake(spark, f"{tmp_path}/lake")
    assert lake.signals() is None and lake.rollup() is None and lake.head()["version"] == 0
    for i, b in enumerate(batches):
        b.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        ingest(spark, f"{tmp_path}/in/*", lake, f"{tmp_path}/check", 1).awaitTermination()
        if i == 0:  # what the stream will bring next, and some that it won't
            more = envelopes(spark, [payload("speed", 7, 30), payload("speed", 8, 31)], 500)
            assert backfill(lake, batches[1].unionByName(more), "2026-06-01", "2026-06-02") == 2
            same_rollup(spark, lake, decode.batch(batches[0].unionByName(batches[1]).unionByName(more)).signals)
    want = decode.batch(batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(more)).signals
    key = ["cloud_event_id", "name", "timestamp", "value_number"]
    assert sorted(map(tuple, lake.signals().select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    same_rollup(spark, lake, want)
    before = lake.signals().count()
    lake.append(decode.batch(batches[0]))  # again: nothing is new
    assert lake.signals().count() == before
    same_rollup(spark, lake, want)
    assert lake.append(decode.batch(batches[0]), f"{tmp_path}/check", 0) is None  # a batch that was committed
    assert lake.rebuild() == lake.head()["version"]
    same_rollup(spark, lake, want)
    (row,) = lake.progress().collect()
    assert (row.batch, row.rows, row.version) == (2, before, lake.head()["version"])


def test_a_failed_version_leaves_no_trace(spark, tmp_path, monkeypatch):
    lake = Lake(spark, f"{tmp_path}/lake")
    first, second = envelopes(spark, [payload("speed", 1, 1)]), envelopes(spark, [payload("speed", 2, 2), payload("speed", 3, 3)], 10)
    lake.append(decode.batch(first), "s", 0)
    with monkeypatch.context() as m:
        m.setattr(lake, "_commit", lambda state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            lake.append(decode.batch(second), "s", 1)
    assert lake.signals().count() == 1
    same_rollup(spark, lake, decode.batch(first).signals)
    lake.append(decode.batch(second.limit(1)), "s", 1)  # another part of the feed than at the first try
    assert lake.signals().count() == 2
    with pytest.raises(Conflict):
        lake._commit(lake.head())


def test_scans_are_pruned(spark, tmp_path):
    lake = Lake(spark, f"{tmp_path}/lake")
    lake.append(decode.batch(envelopes(spark, [payload("speed", i, i) for i in range(5)])))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = plan(lake.signals(["s"], START, START + 60_000_000))
    filters = found[found.index("PartitionFilters") : found.index("PushedFilters")]
    assert "subject_bucket" in filters and "date" in filters and "version" in filters
    assert lake.attach("t_") == ["t_signals", "t_signals_latest"] and spark.sql("SELECT count FROM t_signals_latest").first()[0] == 5
    t = Telemetry(lake.signals().withColumn("date", F.to_date("timestamp")), lake.signals())
    assert values(t.series([Request("speed", FloatAgg.MAX, alias="top")], "1m", "2026-06-01", "2026-06-02", ["s"]), "subject") == [("s",)]
    kept = plan(lake.rollup("rollup", [bucket_of("s")]))
    assert "subject_bucket" in kept[kept.index("PartitionFilters") : kept.index("PushedFilters")]


def test_pages_and_lag(spark):
    rows = envelopes(spark, ["x" * 10] * 6)
    ids = lambda df: [r.id for r in df.orderBy("time").collect()]
    assert ids(page(rows, rows=4)) == ["e-0", "e-1", "e-2", "e-3"]
    assert ids(page(rows, (START + 1_000_000, "s", "e-1"), size=25)) == ["e-2", "e-3"]
    assert ids(page(rows, (START + 1_000_000, "s", "e-1"), size=1)) == ["e-2"]
    assert page(rows, (START + 5_000_000, "s", "e-5")).count() == 0
    (row,) = lag(rows, START + 303_000_000).collect()
    assert (row.n, row.oldest_s, row.late_share) == (6, 303.0, 0.5)


def test_raw_calls(spark):
    rows = envelopes(spark, ["a", "bb", "ccc"])
    assert raw.latest_row(rows, Search(after=0)).id == "e-2"
    with pytest.raises(raw.NotFound):
        raw.latest_row(rows, Search(isin={"id": ["none"]}))
    asked = rows.select("subject", "id", "time", "type", "source", (3 - F.col("data").cast("string").substr(1, 1).isin("a").cast("int")).alias("position"))
    assert [r.data for r in raw.fetched(rows, asked.where("id <> 'e-1'")).collect()] == ["a", "ccc"]
    with pytest.raises(raw.NotFound):
        raw.fetched(rows, asked.withColumn("id", F.lit("other")))
    with pytest.raises(raw.NotFound):
        raw.fetched(rows, asked.limit(0))
    with pytest.raises(ValueError):
        raw.fetched(rows, asked, budget=5)
    extras = spark.createDataFrame([(1, '{"tags":["a","b"]}'), (2, '{"tags":[42]}'), (3, "{bad"), (4, ""), (5, None), (6, "{}"), (7, "[1]"), (8, '{"x":1}')], "i int, extras string")
    assert sorted((r.i, r.tags, r.malformed) for r in raw.restored(extras).collect()) == [(1, ["a", "b"], False), (2, None, False), (3, None, True), (4, None, False), (5, None, False), (6, None, False), (7, None, True), (8, None, False)]
    assert [raw.valid_key(k) for k in ("a/b", "a/../b", "/a", "", "a..b")] == [True, False, False, False, True]
    search = Search.cloud("s", "t", ["u"], source="a")
    assert search.isin == {"subject": ["s"], "type": ["t", "u"], "source": ["a"]} and search.floor() is None
    assert Search(before=raw.LOOKBACK_DAYS * 86_400_000_000 + 5).floor() == 5 and Search().floor() > 0


def test_access():
    claims = Claims("did:erc721:1:0x" + "a" * 40 + ":1", frozenset({"p", "q"}))
    claims.for_subject(claims.subject)
    claims.all_of("p", "q")
    claims.one_of("x", "q")
    for check in (lambda: claims.for_subject("other"), lambda: claims.all_of("p", "x"), lambda: claims.one_of("x"), claims.raw_data, lambda: authorized(None, "s")):
        with pytest.raises(Denied):
            check()
    own = Claims(claims.subject, frozenset({access.LOCATIONS, access.OTHERS}))
    device = "did:erc721:1:0x" + "b" * 40 + ":2"
    assert authorized(own, own.subject) == own.subject and authorized(own, device, lambda d: own.subject) == device
    for linked in (None, lambda d: "other", lambda d: 1 / 0):
        with pytest.raises(Denied):
            authorized(own, device, linked)
    with pytest.raises(Denied):
        authorized(own, "no device", lambda d: own.subject)


def test_coverage():
    c = Coverage().reconciled(100.0, 0)
    assert c.trusted(150) and not c.trusted(191) and not c.trusted(99) and c.beat(180).trusted(260)
    assert c.stopped().started(500).trusted(500) and not c.started(500).trusted(500)
    lost = c.lost()
    assert not lost.trusted(110) and not lost.beat(110).trusted(110) and not lost.stopped().clean
    assert not lost.reconciled(120, 0).trusted(120) and lost.reconciled(120, 1).trusted(120)
    assert [backoff(n) for n in (0, 1, 4, 5, 50)] == [30, 60, 480, 600, 600]
    assert Mode.of(None) is Mode.OFF and Mode.of("serve") is Mode.SERVE
    with pytest.raises(ValueError):
        Mode.of("maybe")


def test_default_aggregates():
    assert [Request.of("x", k, a).agg for k, a in ((1, "MAX"), (1, "WHAT"), (2, None), (3, "AVG"), (3, ""))] == [FloatAgg.MAX, FloatAgg.AVG, StringAgg.TOP, LocationAgg.AVG, LocationAgg.FIRST]


def test_hexagonal_grid(spark):
    points = [(37.3615593, -122.0553238, 5, 37.34579337536848, -121.97637597255124), (37.775938728915946, -122.41795063018799, 9, 37.77670234943567, -122.41845932318311)]
    for lat, lon, resolution, want_lat, want_lon in points:
        got = spark.range(1).select(approximate(F.lit(lat), F.lit(lon), resolution).alias("c")).first().c
        assert got.lat == pytest.approx(want_lat, abs=1e-7) and got.lon == pytest.approx(want_lon, abs=1e-7)
    # no point is further from its middle than a cell is wide, and middles are their own
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(300)], "lat double, lon double")
    near = rows.withColumn("c", approximate(F.col("lat"), F.col("lon"))).withColumn("again", approximate(F.col("c.lat"), F.col("c.lon")))
    for r in near.collect():
        a, b, c, d = (math.radians(x) for x in (r.lat, r.lon, r.c.lat, r.c.lon))
        km = 6371 * math.acos(min(1, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d)))
        assert km < 4.7 and (r.again.lat, r.again.lon) == pytest.approx((r.c.lat, r.c.lon), abs=1e-7)


def test_refuel_golden(spark):
    """The level falls slowly to 20 at minute 30, rises to 80 at 32, and falls again. Minute 26 is the first of which the
    level five minutes on is 30 per cent higher, and where the level falls its trough is that minute itself. Minute 31 is
    the last; the peak after its five minutes is the level at 36."""
    level = lambda m: 30 - m / 3 if m <= 30 else 20 + 30 * (m - 30) if m <= 32 else 80 - (m - 32) / 10
    got = segments.refuel(levels(spark, [(60 * m, level(m)) for m in range(90)]), START, START + 90 * MINUTE, segments.Config(min_duration=60))
    assert values(got, "start_us", "end_us") == [(START + 26 * MINUTE, START + 36 * MINUTE)]


def test_literals(spark):
    rows = [(1, "it's", "a\\b"), (-2, "", "x\ny\"")]
    assert [tuple(r) for r in literals(spark, rows, ["a", "b", "c"]).collect()] == rows


def test_ranges_with_a_buffer(spark):
    found = spark.createDataFrame([("s", 0, 10), ("s", 15, 30), ("s", 31, None)], "subject string, start_us long, end_us long")
    got = segments.as_ranges(found, 50, 6).select("seg_idx", F.unix_micros("end").alias("end"))
    assert values(got, "seg_idx", "end") == [(0, 15), (1, 31), (2, 56)]


def test_random_aggregate_is_a_member(spark):
    s = signals(spark, [(i, "speed", i * 7) for i in range(50)])
    (row,) = aggregate.by_interval(s, [Request("speed", FloatAgg.RAND)], START, START + 10 * MINUTE, 10 * MINUTE).collect()
    assert row.value_number in {i * 7.0 for i in range(50)}


def test_segments_and_days(spark):
    n = lambda m, name, v, lat=0, lon=0: (60 * m, name, v, "", lat, lon)
    rows = [n(m, "isIgnitionOn", v) for m, v in ((-60, 0), (10, 1), (40, 0))] + [n(m, "speed", m) for m in range(0, 60, 5)] + [n(-30, "currentLocationCoordinates", 0, 1, 1), n(20, "currentLocationCoordinates", 0, 2, 2)]
    s = signals(spark, rows)
    e = spark.createDataFrame([("s", "trip.stop", T0 + timedelta(minutes=15), "a", "1", ["x"])], "subject string, name string, timestamp timestamp, source string, cloud_event_id string, tags array<string>")
    t = Telemetry(s, e)
    got = t.segments(Mechanism.IGNITION, "2026-06-01", "2026-06-02", event_names=["trip.stop", "trip.start"])
    assert values(got.segments, "start_us", "duration_s") == [(START + 10 * MINUTE, 1800)]
    assert values(got.counts, "name", "count") == [("trip.start", 0), ("trip.stop", 1)]
    assert values(got.places, "start_lat", "end_lat") == [(2.0, 2.0)]
    top = next(i for i, r in enumerate(r for r in got.requests if r.kind == 1) if r.name == "speed")
    assert values(got.values.where(f"signal_type = 1 AND signal_index = {top}"), "value_number") == [(35.0,)]
    days = t.daily(Mechanism.IGNITION, "2026-06-01", "2026-06-02", event_names=["trip.stop"])
    assert values(days.days, "seg_idx", "n_segments", "active_s", "start_lat", "end_lat") == [(0, 1, 1800, 2.0, 2.0), (1, 0, 0, 2.0, 2.0)]
    assert values(days.counts, "seg_idx", "count") == [(0, 1), (1, 0)]
    with pytest.raises(ValueError):
        t.list_events("2026-06-01", "2026-06-02", EventFilter(name=StringFilter(eq="stop")))
    assert t.list_events("2026-06-01", "2026-06-02", EventFilter(name=StringFilter(startswith="trip."))).count() == 1
    with pytest.raises(ValueError):
        t.series([Request("speed", LocationAgg.AVG, LocationFilter(polygon=[(0, 0), (1, 1), (float("nan"), 0)]))], "1m", "2026-06-01", "2026-06-02")


def test_one_of_privileges(spark):
    rows = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "subject string, name string")
    needs = spark.createDataFrame([("a", ["p", "q"]), ("b", ["q"])], "name string, needs array<string>")
    assert values(latest.allowed(rows, needs, ["p"]), "name") == [] and values(latest.allowed(rows, needs, ["p"], one=True), "name") == [("a",)]


def test_facade(spark):
    s = signals(spark, [(10, "speed", 10), (50, "speed", 30)])
    e = spark.createDataFrame([], "subject string, name string, timestamp timestamp, source string, cloud_event_id string, tags array<string>")
    t = Telemetry(s, e, rollup=rollup.full(s))
    (row,) = t.series([Request("speed", FloatAgg.MAX, alias="top")], "1m", "2026-06-01", "2026-06-02").collect()
    assert row.numbers == {"top": 30}
    assert values(t.latest(), "value_number") == values(t.latest(source="a"), "value_number") == [(30,)]
    with pytest.raises(ValueError):
        t.series([Request("speed", FloatAgg.MAX)], "1m", "2026-06-02", "2026-06-01")
    with pytest.raises(ValueError):
        t.daily(Mechanism.IDLING, "2026-06-01", "2026-06-02")
    assert source_address("did:ethr:1:0x" + "a" * 40) == "0x" + "a" * 40
