"""DuckDB SQL for the registered queries, over the same derivations."""

from __future__ import annotations

from wayfare.functions.geo import FACES, STEP
from wayfare.functions.timing import micros
from wayfare.plans.queries import DAY, END, HOUR, ODD, RING, START, WATERMARK

SIG = """
sig0 AS (SELECT 'did:test:' || (user_id % 20) AS subject, event_type AS name, ts AS timestamp, 'src-' || (event_id % 3) AS source,
  lpad(event_id::VARCHAR, 12, '0') AS cloud_event_id, value::DOUBLE AS value_number,
  ['BEV', 'HEV', 'ICE', 'PHEV'][event_id % 4 + 1] AS value_string,
  (CASE WHEN event_id % 10 <> 0 THEN event_id * 37 % 180 - 90 ELSE 0 END)::DOUBLE AS loc_lat,
  (CASE WHEN event_id % 10 <> 0 THEN event_id * 53 % 360 - 180 ELSE 0 END)::DOUBLE AS loc_lon,
  (event_id % 7)::DOUBLE AS loc_hdop, (event_id * 11 % 360)::DOUBLE AS loc_heading, event_id, props FROM events),
sig AS (SELECT * FROM sig0 UNION ALL
  SELECT * REPLACE ('zz' || cloud_event_id AS cloud_event_id, (-999)::DOUBLE AS value_number) FROM sig0 WHERE event_id % 7 = 0),
ded AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY subject, name, timestamp ORDER BY cloud_event_id) = 1),
ev AS (SELECT * EXCLUDE (value_number), event_id % 1000 * 1000000 AS duration_ns, [name, 'k' || (props::JSON ->> '$.k')] AS tags
  FROM sig QUALIFY row_number() OVER (PARTITION BY subject, timestamp, name, source ORDER BY cloud_event_id) = 1)"""
IN = f"epoch_us(timestamp) >= {START} AND epoch_us(timestamp) < {END}"


def _bucket(width: int, origin: int = START) -> str:
    return f"({origin} + (epoch_us(timestamp) - {origin}) // {width} * {width})::BIGINT"


def _with(body: str, *more: str) -> str:
    return f"WITH {','.join([SIG, *more])} {body}"


def _slots(name: str, fns: list[str], value: str, width: int, where: str = "true", table: str = "ded", origin: int = START) -> list[str]:
    own = f"FROM {table} WHERE name = '{name}' AND epoch_us(timestamp) >= {origin} AND epoch_us(timestamp) < {END} AND {where} GROUP BY 1, 2"
    return [f"SELECT subject, {_bucket(width, origin)} AS bucket_us, {i} AS signal_index, {f} AS {value} {own}" for i, f in enumerate(fns)]


def _numbers(parts: list[str], *more: str) -> str:
    return _with(f"SELECT subject, bucket_us, signal_index::INTEGER AS signal_index, round(value_number, 6) AS value_number FROM ({' UNION ALL '.join(parts)})", *more)


def _index(part: str, i: int) -> str:
    return part.replace(" 0 AS signal_index", f" {i} AS signal_index")


FIX = "(loc_lat <> 0 OR loc_lon <> 0)"
CIRCLE = "2 * 6371008.8 * asin(sqrt(least(1, sin(radians(loc_lat - 10) / 2) ^ 2 + cos(radians(loc_lat)) * cos(radians(10)) * sin(radians(loc_lon - 20) / 2) ^ 2))) <= 5000000"
_EDGES = [(a, b, c, d) for (a, b), (c, d) in zip(RING, [*RING[1:], RING[0]], strict=True)]
POLYGON = "(" + " + ".join(f"(CASE WHEN ((loc_lat < {a}) <> (loc_lat < {c})) AND loc_lon < (loc_lat - {a}) * {(d - b) / (c - a)!r} + {b} THEN 1 ELSE 0 END)" for a, b, c, d in _EDGES) + ") % 2 = 1"
RANGES = "rng AS (SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-08'), (1, TIMESTAMP '2024-01-07', TIMESTAMP '2024-01-10'), (2, TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-12')) AS t(seg_idx, a, b))"
SEG = f"(CASE WHEN timestamp >= '2024-01-05' AND timestamp < '2024-01-08' THEN 0 WHEN timestamp >= '2024-01-07' AND timestamp < '2024-01-10' THEN 1 WHEN timestamp >= '2024-01-11' AND timestamp < '2024-01-12' THEN 2 ELSE -1 END)"


def _rollup(source: str) -> str:
    """Of a CTE of signals."""
    return f"""(SELECT subject, name, max(timestamp) AS timestamp, arg_max(value_number, timestamp) AS value_number, arg_max(value_string, timestamp) AS value_string,
 coalesce(arg_max(loc_lat, timestamp) FILTER ({FIX}), 0) AS loc_lat, coalesce(arg_max(loc_lon, timestamp) FILTER ({FIX}), 0) AS loc_lon,
 coalesce(arg_max(loc_hdop, timestamp) FILTER ({FIX}), 0) AS loc_hdop, coalesce(arg_max(loc_heading, timestamp) FILTER ({FIX}), 0) AS loc_heading,
 max(timestamp) FILTER ({FIX}) AS loc_ts, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen
 FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY subject, name, timestamp ORDER BY cloud_event_id) = 1) GROUP BY subject, name)"""


def _us(body: str, *columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'epoch_us({c}) AS {c}' for c in columns)}) FROM ({body})"


ROLLUP_US = ("timestamp", "loc_ts", "first_seen", "last_seen")


def _windows(subject: str, count: int, start: int) -> str:
    return f"""win AS (SELECT {subject} AS subject, epoch_us(timestamp) // {HOUR} * {HOUR} AS window_us, count(*) AS n, count(DISTINCT name) AS n_names
 FROM (SELECT DISTINCT {subject} AS subject, name, timestamp FROM sig WHERE epoch_us(timestamp) >= {start} AND epoch_us(timestamp) < {END})
 GROUP BY ALL HAVING count(*) >= {count} AND count(DISTINCT name) >= 2),
cus AS (SELECT *, s - least(0, min(s) OVER w) AS cusum FROM (SELECT *, sum(n - 1.5) OVER w AS s FROM win WINDOW w AS (PARTITION BY subject ORDER BY window_us)) WINDOW w AS (PARTITION BY subject ORDER BY window_us))"""


def _merged(windows: str, ongoing: bool = False) -> str:
    """Segments of windows of an hour, joined over gaps of an hour."""
    now = f"i = k AND {END} - b <= {HOUR}" if ongoing else "false"
    return f"""iv AS (SELECT subject, window_us AS a, least(window_us + {HOUR}, {END}) AS b FROM {windows}),
isl AS (SELECT *, sum(CASE WHEN a - prev <= {HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY subject ORDER BY a) AS g
  FROM (SELECT *, max(b) OVER (PARTITION BY subject ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM iv)),
mrg AS (SELECT subject, min(a) AS a0, max(b) AS b0 FROM isl GROUP BY subject, g),
clp AS (SELECT subject, greatest(a0, {START}) AS a, least(b0, {END}) AS b, a0, b0 FROM mrg),
ok AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY a) AS i, count(*) OVER (PARTITION BY subject) AS k FROM clp
  WHERE b > a AND ((b - a) // 1000000 >= 240 OR (a0 < {START} AND (b0 - a0) // 1000000 >= 240))),
seg AS (SELECT subject, a::BIGINT AS start_us, (CASE WHEN {now} THEN NULL ELSE b END)::BIGINT AS end_us,
  ((CASE WHEN {now} THEN {END} ELSE b END - a) // 1000000)::BIGINT AS duration_s, {now} AS ongoing, a <= {START} AS started_before FROM ok)"""


STATES = "st AS (SELECT subject, timestamp, (CASE WHEN value_number > 30 THEN 1 ELSE 0 END)::DOUBLE AS state FROM (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY subject, timestamp ORDER BY cloud_event_id) = 1))"


def _changes(lookback: int) -> str:
    floor = START - lookback
    return f"""old AS (SELECT subject, arg_max(state, timestamp) AS state FROM st WHERE state IS NOT NULL AND epoch_us(timestamp) < {floor} GROUP BY subject),
sq AS (SELECT n.subject, timestamp, n.state, coalesce(lag(n.state) OVER w, old.state, 0)::DOUBLE AS previous, row_number() OVER w AS i
 FROM st n LEFT JOIN old USING (subject) WHERE n.state IS NOT NULL AND epoch_us(timestamp) >= {floor} AND epoch_us(timestamp) < {END} WINDOW w AS (PARTITION BY n.subject ORDER BY timestamp)),
ch AS (SELECT subject, timestamp, state, previous FROM sq WHERE state <> previous UNION ALL
 SELECT subject, timestamp, state, 0 FROM sq q WHERE i = 1 AND state = 1 AND NOT EXISTS (SELECT 1 FROM sq z WHERE z.subject = q.subject AND z.state <> z.previous))"""


STEADY = f"""st AS (SELECT subject, timestamp, (CASE substring(subject, 10)::INTEGER % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN epoch_us(timestamp) < {START - HOUR} THEN 1 END
 ELSE CASE WHEN value_number > 30 THEN 1 ELSE 0 END END)::DOUBLE AS state FROM (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY subject, timestamp ORDER BY cloud_event_id) = 1))"""


def _snapped(name: str, source: str, resolution: int = 6) -> str:
    """One pass of the hexagonal grid over (loc_lat, loc_lon, lat, lon in radians)."""
    scale, half = 7 ** (resolution / 2) / STEP, "(sqrt(3) / 2)"
    faces = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in FACES)
    return f"""{name}a AS (SELECT *, cos(lat) * cos(lon) * cos(a) * cos(b) + cos(lat) * sin(lon) * cos(a) * sin(b) + sin(lat) * sin(a) AS dot
 FROM {source}, (VALUES {faces}) AS f(a, b, c) QUALIFY row_number() OVER (PARTITION BY loc_lat, loc_lon ORDER BY dot DESC) = 1),
{name}b AS (SELECT *, sqrt(greatest(0, 1 / (dot * dot) - 1)) * {scale!r} AS far, c - atan2(cos(lat) * sin(lon - b), cos(a) * sin(lat) - sin(a) * cos(lat) * cos(lon - b)) AS angle FROM {name}a),
{name}c AS (SELECT *, far * cos(angle) + far * sin(angle) / {half} / 2 AS i, far * sin(angle) / {half} AS j FROM {name}b),
{name}d AS (SELECT *, floor(i) + u AS ci, floor(j) + v AS cj FROM {name}c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(u, v)
 QUALIFY row_number() OVER (PARTITION BY loc_lat, loc_lon ORDER BY (i - ci) ^ 2 - (i - ci) * (j - cj) + (j - cj) ^ 2) = 1),
{name}e AS (SELECT *, ci - cj / 2 AS x, cj * {half} AS y FROM {name}d),
{name}f AS (SELECT *, atan(sqrt(x * x + y * y) / {scale!r}) AS d, c - atan2(y, x) AS az FROM {name}e),
{name}g AS (SELECT *, asin(greatest(-1, least(1, sin(a) * cos(d) + cos(a) * sin(d) * cos(az)))) AS lat2 FROM {name}f),
{name} AS (SELECT loc_lat, loc_lon, lat2 AS lat, b + atan2(sin(az) * sin(d) * cos(a), cos(d) - sin(a) * sin(lat2)) AS lon FROM {name}g)"""


DECODED = """dec0 AS (SELECT 'did:test:' || (user_id % 20) AS subject, 'id-' || event_id AS cloud_event_id, ts AS timestamp, event_id FROM events),
dec AS (SELECT subject, cloud_event_id, 'speed' AS name, timestamp, (event_id % 200)::DOUBLE AS value_number, '' AS value_string, 0::DOUBLE AS loc_lat, 0::DOUBLE AS loc_lon, 0::DOUBLE AS loc_hdop, 0::DOUBLE AS loc_heading FROM dec0
UNION ALL SELECT subject, cloud_event_id, 'exteriorAirTemperature', timestamp, event_id + 0.5::DOUBLE, '', 0, 0, 0, 0 FROM dec0
UNION ALL SELECT subject, cloud_event_id, 'powertrainType', timestamp, 0, CASE WHEN event_id % 2 = 0 THEN 'HEV' ELSE 'BEV' END, 0, 0, 0, 0 FROM dec0
UNION ALL SELECT subject, cloud_event_id, 'currentLocationCoordinates', timestamp, 0, '', event_id % 90, event_id % 180, 1, 0 FROM dec0 WHERE event_id % 180 <> 0)"""

IGNITION = f"""
nx AS (SELECT *, epoch_us(timestamp) AS us, min(CASE WHEN state = 1 THEN epoch_us(timestamp) END) OVER (PARTITION BY subject ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM ch),
kp AS (SELECT * FROM nx WHERE state = 1 OR nxt IS NULL OR nxt - us >= {HOUR}),
gr AS (SELECT *, coalesce(sum(CASE WHEN state = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM kp),
rn AS (SELECT subject, min(CASE WHEN state = 1 AND previous <> 1 THEN us END) AS a, max(CASE WHEN state = 0 THEN us END) AS b FROM gr GROUP BY subject, g)"""
IDLE = f"""
lv AS (SELECT subject, timestamp, epoch_us(timestamp) AS us, value_number > 0 AND value_number <= 30 AS idle FROM ded WHERE name = 'view' AND epoch_us(timestamp) >= {START - HOUR} AND epoch_us(timestamp) < {END}),
lg AS (SELECT *, CASE WHEN lag(idle) OVER w AND us - lag(us) OVER w <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM lv WINDOW w AS (PARTITION BY subject ORDER BY us)),
ru AS (SELECT subject, min(us) AS start_us, max(us) AS end_us FROM (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY us) AS g FROM lg) WHERE idle GROUP BY subject, g)"""
RAW = """
r0 AS (SELECT 'did:test:' || (user_id % 20) AS subject, ts AS time, 'fleet.' || (CASE WHEN event_id % 2 = 0 THEN 'status' ELSE 'events' END) AS type, 'id-' || (event_id // 2) AS id,
  'src-' || (event_id % 3) AS source, 'prod-' || (event_id % 4) AS producer, [event_type, 'k' || (props::JSON ->> '$.k')] AS tags, '{"value":' || (event_id % 100) || '}' AS data,
  CASE WHEN event_id % 50 = 0 THEN 'id-' || (event_id // 2 + 10) ELSE '' END AS voids_id, event_id FROM events),
r AS (SELECT * FROM r0 UNION ALL SELECT * REPLACE (time + INTERVAL 1 MICROSECOND AS time) FROM r0 WHERE event_id % 7 = 0),
live AS (SELECT * FROM r WHERE voids_id = '' AND NOT EXISTS (SELECT 1 FROM r v WHERE v.voids_id = r.id AND v.subject = r.subject))"""


def _raw(where: str, tail: str = "", columns: str = "subject, epoch_us(time) AS time, type, id, source") -> str:
    return f"WITH {RAW}, found AS (SELECT * FROM live WHERE {where} QUALIFY row_number() OVER (PARTITION BY subject, date_trunc('second', time), type, source, id ORDER BY time) = 1) SELECT {columns} FROM found {tail}"


FLOATS = ["avg(value_number)", "min(value_number)", "max(value_number)", "median(value_number)", "arg_min(value_number, timestamp)", "arg_max(value_number, timestamp)"]
LATEST = f"""SELECT subject, name, max(timestamp) AS timestamp, arg_max(value_number, timestamp) AS value_number, arg_max(value_string, timestamp) AS value_string,
 arg_max(loc_lat, timestamp) FILTER ({FIX}) AS loc_lat, arg_max(loc_lon, timestamp) FILTER ({FIX}) AS loc_lon, arg_max(loc_hdop, timestamp) FILTER ({FIX}) AS loc_hdop,
 arg_max(loc_heading, timestamp) FILTER ({FIX}) AS loc_heading, max(timestamp) FILTER ({FIX}) AS loc_ts FROM ded GROUP BY subject, name"""
SUMMARY = "SELECT subject, name, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM {} GROUP BY subject, name"
BELOW = f"epoch_us(timestamp) < {WATERMARK}"

TOP = f"""SELECT subject, bucket_us, 0 AS signal_index, value_string FROM (SELECT subject, {_bucket(DAY)} AS bucket_us, value_string, count(*) AS n FROM ded WHERE name = 'view' AND {IN} GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY subject, bucket_us ORDER BY n DESC, value_string) = 1"""
TEXTS = _slots("view", ["''", "string_agg(DISTINCT value_string, ',' ORDER BY value_string)", "arg_min(value_string, timestamp)", "arg_max(value_string, timestamp)"], "value_string", DAY)[1:]


def _places(i: int, f: str) -> str:
    return f"SELECT subject, {_bucket(DAY)} AS bucket_us, {i}::INTEGER AS signal_index, {', '.join(f'round({f.format(c)}, 6) AS {c}' for c in ('loc_lat', 'loc_lon', 'loc_hdop', 'loc_heading'))} FROM ded WHERE name = 'view' AND {FIX} AND {IN} GROUP BY 1, 2"


def _fenced(test: str, f: str) -> str:
    return _with(f"SELECT subject, {_bucket(DAY)} AS bucket_us, {f}(loc_lat, timestamp) AS loc_lat, {f}(loc_lon, timestamp) AS loc_lon FROM ded WHERE name = 'view' AND {FIX} AND {test} AND {IN} GROUP BY 1, 2")


FREQUENCY = (_windows("subject", 2, START - HOUR), _merged("win"))
SEGMENT = "SELECT subject, start_us, end_us, duration_s, ongoing, started_before FROM seg"
EVENT_TEST = "((name <> 'error') OR starts_with(name, 'sig')) AND source <> 'src-2' AND list_has_any(tags, ['click', 'view']) AND NOT list_contains(tags, 'k1')"
SRC1 = "one AS (SELECT * FROM sig WHERE source = 'src-1' QUALIFY row_number() OVER (PARTITION BY subject, name, timestamp ORDER BY cloud_event_id) = 1)"
ASOF = f"""fx AS (SELECT * FROM sig WHERE name = 'view' AND {FIX} QUALIFY row_number() OVER (PARTITION BY subject, timestamp ORDER BY cloud_event_id) = 1),
pr AS (SELECT DISTINCT subject, timestamp + INTERVAL 1 SECOND AS timestamp FROM sig WHERE name = 'purchase')"""
STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"

ORACLES: dict[str, str] = {
    "signals_hourly_float": _numbers([*_slots("click", FLOATS, "value_number", HOUR), _index(_slots("view", ["avg(value_number)"], "value_number", HOUR)[0], 6)]),
    "signals_anchored_bucket": _numbers(_slots("click", ["avg(value_number)"], "value_number", 5_400_000_000, origin=ODD)),
    "signals_string_aggs": _with(f"SELECT subject, bucket_us, signal_index::INTEGER AS signal_index, value_string FROM ({' UNION ALL '.join([TOP, *TEXTS])})"),
    "signals_location_aggs": _with(" UNION ALL ".join([_places(0, "arg_min({}, timestamp)"), _places(1, "arg_max({}, timestamp)"), _places(2, "avg({})")])),
    "signals_float_filter_or": _numbers([_slots("click", ["max(value_number)"], "value_number", DAY, "((value_number >= 20 AND value_number < 60 AND value_number NOT IN (30)) OR value_number > 400 OR value_number IN (1, 2))")[0], _index(_slots("error", ["min(value_number)"], "value_number", DAY)[0], 1)]),
    "signals_source_filter": _numbers(_slots("click", ["avg(value_number)"], "value_number", DAY, table="one"), SRC1),
    "signals_geo_circle": _fenced(CIRCLE, "arg_min"),
    "signals_geo_polygon": _fenced(POLYGON, "arg_max"),
    "signals_ranges": _with(
        f"""SELECT subject, seg_idx::INTEGER AS seg_idx, t::INTEGER AS signal_type, round(CASE t WHEN 1 THEN avg(value_number) ELSE 0 END, 6) AS value_number,
 CASE t WHEN 3 THEN arg_max(loc_lat, timestamp) ELSE 0 END AS loc_lat, CASE t WHEN 3 THEN arg_max(loc_lon, timestamp) ELSE 0 END AS loc_lon
 FROM (SELECT *, {SEG} AS seg_idx, CASE name WHEN 'click' THEN 1 ELSE 3 END AS t FROM ded WHERE name IN ('click', 'view')) WHERE seg_idx >= 0 GROUP BY subject, seg_idx, t"""
    ),
    "signals_objects": _with(f"SELECT subject, {_bucket(DAY)} AS bucket_us, max(value_number) FILTER (name = 'click') AS most, min(value_number) FILTER (name = 'view') AS least FROM ded WHERE name IN ('click', 'view') AND {IN} GROUP BY 1, 2"),
    "dedup_by_sum": _with("SELECT subject, name, epoch_us(timestamp) AS timestamp, cloud_event_id, value_number FROM ded"),
    "latest_named": _with(f"SELECT subject, name, epoch_us(timestamp) AS timestamp, value_number, value_string FROM ({LATEST}) WHERE name IN ('click', 'view')"),
    "latest_location": _with(f"SELECT subject, epoch_us(loc_ts) AS timestamp, loc_lat, loc_lon, loc_hdop, loc_heading FROM ({LATEST}) WHERE name = 'view' AND loc_ts IS NOT NULL"),
    "latest_all": _with(f"SELECT subject, name, epoch_us(timestamp) AS timestamp, value_number FROM ({LATEST}) UNION ALL SELECT subject, 'lastSeen', max(epoch_us(timestamp)), 0 FROM sig GROUP BY subject"),
    "available_signals": _with("SELECT DISTINCT subject, name FROM sig WHERE source = 'src-1' AND name IN ('click', 'error', 'purchase', 'signup')"),
    "signal_summaries": _with(_us(SUMMARY.format("ded"), "first_seen", "last_seen")),
    "signals_snapshot": _with(f"SELECT subject, name, CASE WHEN loc_ts IS NOT NULL THEN 'location' WHEN value_string <> '' THEN 'string' ELSE 'number' END AS kind, epoch_us(coalesce(loc_ts, timestamp)) AS timestamp FROM ({LATEST})"),
    "data_summary": _with(
        """SELECT subject, n_signals::BIGINT AS n_signals, n_events::BIGINT AS n_events, epoch_us(a) AS first_seen, epoch_us(b) AS last_seen FROM (
 SELECT subject, sum(s) AS n_signals, sum(e) AS n_events, min(timestamp) AS a, max(timestamp) AS b FROM (SELECT subject, timestamp, 1 AS s, 0 AS e FROM ded UNION ALL SELECT subject, timestamp, 0, 1 FROM ev) GROUP BY subject
 UNION ALL SELECT 'did:test:none', 0, 0, TIMESTAMP '2024-02-01', TIMESTAMP '1900-01-01')"""
    ),
    "events_list_filtered": _with(f"SELECT subject, name, epoch_us(timestamp) AS timestamp, source, to_json(tags)::VARCHAR AS tags, duration_ns FROM ev WHERE {IN} AND {EVENT_TEST}"),
    "event_counts": _with(f"SELECT subject, name, count(*) AS count FROM ev WHERE {IN} AND name IN ('click', 'view') GROUP BY ALL"),
    "event_counts_ranges": _with(f"SELECT subject, seg_idx::INTEGER AS seg_idx, name, count(*) AS count FROM (SELECT *, {SEG} AS seg_idx FROM ev) WHERE name IN ('click', 'error') AND seg_idx >= 0 GROUP BY ALL"),
    "event_summaries": _with(_us(SUMMARY.format("ev"), "first_seen", "last_seen")),
    "location_as_of": _with("SELECT pr.subject, epoch_us(pr.timestamp) AS timestamp, loc_lat, loc_lon, loc_hdop, loc_heading, epoch_us(fx.timestamp) AS loc_ts FROM pr ASOF LEFT JOIN fx ON pr.subject = fx.subject AND pr.timestamp >= fx.timestamp", ASOF),
    "location_at_point": _with(f"SELECT subject, epoch_us(timestamp) AS timestamp, loc_lat, loc_lon, loc_hdop, loc_heading FROM sig WHERE subject = 'did:test:3' AND name = 'view' AND {FIX} AND epoch_us(timestamp) <= {END} ORDER BY timestamp DESC, cloud_event_id LIMIT 1"),
    "windowed_counts": _with("SELECT subject, window_us, n, n_names FROM win", _windows("'fleet'", 10, START)),
    "cusum_active_windows": _with("SELECT subject, window_us, n, cusum::DOUBLE AS cusum FROM cus", _windows("'fleet'", 10, START)),
    "segments_frequency": _with(SEGMENT, *FREQUENCY),
    "segments_frequency_ongoing": _with(SEGMENT, _windows("'fleet'", 10, START - HOUR), _merged("win", True)),
    "segments_changepoint": _with(SEGMENT, FREQUENCY[0], _merged("(SELECT * FROM cus WHERE cusum > 5)")),
    "ignition_changes": _with("SELECT subject, epoch_us(timestamp) AS timestamp, state, previous FROM ch", STATES, _changes(2 * DAY)),
    "segments_ignition": _with(
        f"""SELECT subject, a AS start_us, b AS end_us, (coalesce(b, {END}) - a) // 1000000 AS duration_s, b IS NULL AS ongoing, a < {START} AS started_before
 FROM rn WHERE a IS NOT NULL AND (coalesce(b, {END}) - a) // 1000000 >= 600 AND (b IS NULL OR b > {START})""",
        STATES, _changes(30 * DAY), IGNITION,
    ),
    "idle_runs": _with("SELECT subject, start_us, end_us FROM ru", IDLE),
    "segments_idling": _with(
        f"""SELECT subject, a AS start_us, b AS end_us, (b - a) // 1000000 AS duration_s, false AS ongoing, a <= {START} AS started_before
 FROM (SELECT subject, greatest(start_us, {START}) AS a, least(end_us, {END}) AS b, start_us, end_us FROM ru) c
 WHERE b > a AND ((b - a) // 1000000 >= 60 OR (start_us < {START} AND (end_us - start_us) // 1000000 >= 60))
 AND NOT EXISTS (SELECT 1 FROM ded WHERE ded.subject = c.subject AND name = 'error' AND value_number > 100 AND epoch_us(timestamp) >= a AND epoch_us(timestamp) < b AND {IN})""",
        IDLE,
    ),
    "segments_page": _with(f"{SEGMENT} WHERE start_us > {START + DAY} QUALIFY row_number() OVER (PARTITION BY subject ORDER BY start_us) <= 3", *FREQUENCY),
    "segment_enrichment": _with(
        """SELECT s.subject, (row_number() OVER (PARTITION BY s.subject ORDER BY s.start_us) - 1)::INTEGER AS seg_idx, s.start_us,
 (SELECT max(value_number) FROM ded WHERE ded.subject = s.subject AND name = 'view' AND epoch_us(timestamp) >= s.start_us AND epoch_us(timestamp) < s.end_us) AS most,
 (SELECT count(*) FROM ev WHERE ev.subject = s.subject AND name = 'click' AND epoch_us(timestamp) >= s.start_us AND epoch_us(timestamp) < s.end_us) AS clicks FROM seg s""",
        *FREQUENCY,
    ),
    "daily_activity": _with(
        """SELECT subject, strftime(day, '%Y-%m-%d') AS day, count(*) AS n_segments, sum((least(end_us, day_end) - greatest(start_us, day_start)) // 1000000)::BIGINT AS active_s, min(start_us) AS first_us, max(end_us) AS last_us
 FROM seg JOIN dy ON start_us < day_end AND end_us > day_start GROUP BY ALL""",
        *FREQUENCY,
        "dy AS (SELECT day, epoch_us(day) + 18000000000 AS day_start, epoch_us(day) + 104400000000 AS day_end FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-11', INTERVAL 1 DAY)) AS day))",
    ),
    "raw_list": _raw(f"subject IN ('did:test:1', 'did:test:2') AND source <> 'src-0' AND epoch_us(time) > {START} AND epoch_us(time) < {END}", "ORDER BY found.time, id, type, subject, source LIMIT 500"),
    "raw_latest": _raw(f"type = 'fleet.status' AND epoch_us(time) > {END - 400 * DAY}", "ORDER BY found.time DESC, id DESC, type DESC, subject, source LIMIT 1"),
    "raw_found": _raw("true"),
    "raw_type_summaries": _raw("true", "GROUP BY type", "type, count(*) AS count, epoch_us(min(time)) AS first_seen, epoch_us(max(time)) AS last_seen"),
    "raw_tags_filter": _raw("list_has_any(tags, ['click', 'view']) AND NOT list_contains(tags, 'k3') AND list_contains(tags, 'k1')"),
    "raw_payloads": _raw(
        "true", "",
        """subject, id, epoch_us(time) AS time, type, CASE WHEN producer = 'prod-0' THEN 'elsewhere' ELSE source END AS source,
 CASE WHEN producer = 'prod-0' THEN (SELECT data FROM r WHERE r.subject = found.subject AND r.id = found.id ORDER BY r.time DESC, r.type DESC, r.source DESC, data DESC LIMIT 1) ELSE data END AS data""",
    ),
    "decode_signals": """
WITH e AS (SELECT 'did:test:' || (user_id % 20) AS subject, 'id-' || event_id AS cloud_event_id, epoch_us(ts) AS timestamp, event_id FROM events)
SELECT subject, cloud_event_id, 'speed' AS name, timestamp, (event_id % 200)::DOUBLE AS value_number, '' AS value_string, 0::DOUBLE AS loc_lat, 0::DOUBLE AS loc_lon, 0::DOUBLE AS loc_hdop FROM e
UNION ALL SELECT subject, cloud_event_id, 'exteriorAirTemperature', timestamp, event_id + 0.5::DOUBLE, '', 0, 0, 0 FROM e
UNION ALL SELECT subject, cloud_event_id, 'powertrainType', timestamp, 0, CASE WHEN event_id % 2 = 0 THEN 'HEV' ELSE 'BEV' END, 0, 0, 0 FROM e
UNION ALL SELECT subject, cloud_event_id, 'currentLocationCoordinates', timestamp, 0, '', event_id % 90, event_id % 180, 1 FROM e""",
    "decode_signal_errors": "SELECT 'id-' || event_id AS id, n AS name, e AS error FROM events, (VALUES ('obdDistanceWithMIL', 'no number'), ('notInTheCatalogue', 'unknown name')) AS t(n, e)",
    "decode_events": """SELECT 'did:test:' || (user_id % 20) AS subject, 'id-' || event_id AS cloud_event_id, event_type AS name, epoch_us(ts) AS timestamp, event_id * 1000 AS duration_ns, '{"a":1}' AS metadata, '["ok"]' AS tags FROM events""",
    "coordinate_merge": _with(
        """SELECT subject, cloud_event_id, epoch_us(timestamp) + (CASE WHEN alone THEN 600000 ELSE 0 END) AS timestamp, CASE WHEN alone OR NOT fix THEN 0 ELSE loc_lat END AS loc_lat, CASE WHEN alone OR NOT fix THEN 0 ELSE loc_lon END AS loc_lon,
 CASE WHEN alone OR NOT late THEN loc_hdop ELSE 0 END AS loc_hdop
 FROM (SELECT *, event_id % 10 IN (0, 3, 6, 9) AS late, (loc_lat <> 0 OR loc_lon <> 0) AND loc_lat BETWEEN -90 AND 90 AND loc_lon BETWEEN -180 AND 180 AS fix FROM sig), (VALUES (false), (true)) AS t(alone)
 WHERE CASE WHEN alone THEN late ELSE fix OR NOT late END"""
    ),
    "rollup_signals": _with(_us(_rollup("sig"), *ROLLUP_US)),
    "rollup_events": _with(_us(SUMMARY.format("ev"), "first_seen", "last_seen")),
    "rollup_incremental": _with(_us(_rollup("sig"), *ROLLUP_US)),
    "rollup_advanced": _with(_us(_rollup(f"(SELECT * FROM sig WHERE {BELOW})"), *ROLLUP_US)),
    "summaries_watermark_union": _with(_us(SUMMARY.format("ded"), "first_seen", "last_seen")),
    "rollup_diff": _with(
        f"""SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.name, b.name) AS name, CASE WHEN a.subject IS NULL THEN 'missing_live' WHEN b.subject IS NULL THEN 'missing_shadow' ELSE 'mismatch' END AS status
 FROM {_rollup("(SELECT * FROM sig WHERE name <> 'click')")} a FULL JOIN {_rollup(f"(SELECT * FROM sig WHERE name <> 'view' AND {BELOW})")} b ON a.subject = b.subject AND a.name = b.name
 WHERE a.subject IS NULL OR b.subject IS NULL OR a.count <> b.count OR a.timestamp <> b.timestamp"""
    ),
    "rollup_shadow_comparison": _with(
        f"""SELECT a.subject, a.name, CASE WHEN b.t IS NULL THEN 'cache_miss' WHEN b.t = a.t THEN 'match' WHEN b.t > a.t THEN 'cache_newer' ELSE 'mismatch' END AS status
 FROM (SELECT subject, name, max(timestamp) AS t FROM sig GROUP BY ALL) a LEFT JOIN (SELECT subject, name, max(timestamp) AS t FROM sig WHERE ({BELOW} AND name <> 'view') OR (name = 'view' AND subject = 'did:test:1') GROUP BY ALL) b USING (subject, name)"""
    ),
    "rollup_cardinality": _with("SELECT (n + c)::BIGINT AS n_rows, n::BIGINT AS n_keys, c::BIGINT AS dup_keys, (2 * c)::BIGINT AS dup_rows FROM (SELECT count(*) AS n, count(*) FILTER (name = 'click') AS c FROM (SELECT DISTINCT subject, name FROM sig))"),
    "insert_anti_join": _with(f"SELECT subject, name, count(*) AS count FROM sig WHERE name = 'click' AND epoch_us(timestamp) >= {WATERMARK} GROUP BY ALL"),
    "prune_orphans": _with(f"SELECT subject, name, epoch_us(max(timestamp)) AS last_seen FROM sig WHERE name IN ('view', 'error') OR {BELOW} GROUP BY ALL HAVING max(epoch_us(timestamp)) >= {WATERMARK}"),
    "late_subject_repair": _with(_us(_rollup(f"(SELECT * FROM sig WHERE {BELOW})"), *ROLLUP_US)),
    "latest_fold": _with(_us(f"SELECT * EXCLUDE (count, first_seen, last_seen) FROM {_rollup('sig')}", "timestamp", "loc_ts")),
    "privilege_filtered_snapshot": _with(f"SELECT subject, name, epoch_us(coalesce(loc_ts, timestamp)) AS timestamp FROM ({LATEST}) WHERE name IN ('error', 'signup')"),
    "segment_events_zero_filled": _with(
        """SELECT s.subject, s.seg_idx, n.name, (SELECT count(*) FROM ev WHERE ev.subject = s.subject AND ev.name = n.name AND epoch_us(timestamp) >= s.start_us AND epoch_us(timestamp) < s.end_us) AS count
 FROM (SELECT *, (row_number() OVER (PARTITION BY subject ORDER BY start_us) - 1)::INTEGER AS seg_idx FROM seg) s, (VALUES ('signup'), ('purchase')) AS n(name)""",
        *FREQUENCY,
    ),
    "segment_locations": _with(
        f"""SELECT subject, seg_idx, {', '.join(f"coalesce({w}.loc_{c}, 0)::DOUBLE AS {n}_{c}" for n, w in (("start", "coalesce_a"), ("end", "coalesce_b")) for c in ("lat", "lon"))} FROM (
 SELECT s.subject, s.seg_idx, CASE WHEN {{0}} THEN a1 ELSE a2 END AS coalesce_a, CASE WHEN {{1}} THEN b1 ELSE b2 END AS coalesce_b FROM (SELECT *,
 (SELECT {{{{'loc_lat': arg_min(loc_lat, timestamp), 'loc_lon': arg_min(loc_lon, timestamp)}}}} FROM ded WHERE ded.subject = q.subject AND name = 'view' AND epoch_us(timestamp) >= start_us AND epoch_us(timestamp) < end_us) AS a1,
 (SELECT {{{{'loc_lat': arg_max(loc_lat, timestamp), 'loc_lon': arg_max(loc_lon, timestamp)}}}} FROM ded WHERE ded.subject = q.subject AND name = 'view' AND epoch_us(timestamp) >= start_us AND epoch_us(timestamp) < end_us) AS b1,
 (SELECT {{{{'loc_lat': arg_max(loc_lat, timestamp), 'loc_lon': arg_max(loc_lon, timestamp)}}}} FROM fx WHERE fx.subject = q.subject AND epoch_us(timestamp) <= start_us) AS a2,
 (SELECT {{{{'loc_lat': arg_max(loc_lat, timestamp), 'loc_lon': arg_max(loc_lon, timestamp)}}}} FROM fx WHERE fx.subject = q.subject AND epoch_us(timestamp) <= end_us) AS b2
 FROM (SELECT *, (row_number() OVER (PARTITION BY subject ORDER BY start_us) - 1)::INTEGER AS seg_idx FROM seg) q) s)""".replace("{{", "{").replace("}}", "}").replace("{0}", "a1.loc_lat <> 0 OR a1.loc_lon <> 0").replace("{1}", "b1.loc_lat <> 0 OR b1.loc_lon <> 0"),
        *FREQUENCY, ASOF,
    ),
    "rollup_flushed": _with(_us(_rollup("sig"), *ROLLUP_US)),
    "approximate_locations": _with(
        "SELECT loc_lat, loc_lon, round(degrees(lat) * 1000000)::BIGINT AS lat, round((degrees(lon) - 360 * floor((degrees(lon) + 180) / 360)) * 1000000)::BIGINT AS lon FROM twice",
        f"pts AS (SELECT DISTINCT loc_lat, loc_lon, radians(loc_lat * 0.9 + 0.123) AS lat, radians(loc_lon + 0.456) AS lon FROM sig WHERE {FIX})",
        _snapped("once", "pts"), _snapped("twice", "once"),
    ),
    "decode_last_in_payload": "SELECT 'did:test:' || (user_id % 20) AS subject, 'id-' || event_id AS cloud_event_id, 'speed' AS name, epoch_us(ts) AS timestamp, (event_id % 200)::DOUBLE AS value_number FROM events",
    "ignition_steady": _with("SELECT subject, epoch_us(timestamp) AS timestamp, state, previous FROM ch", STEADY, _changes(2 * DAY)),
    "segments_ignition_steady": _with(
        f"""SELECT subject, a AS start_us, b AS end_us, (coalesce(b, {END}) - a) // 1000000 AS duration_s, b IS NULL AS ongoing, a < {START} AS started_before
 FROM rn WHERE a IS NOT NULL AND (coalesce(b, {END}) - a) // 1000000 >= 600 AND (b IS NULL OR b > {START})""",
        STEADY, _changes(30 * DAY), IGNITION,
    ),
    "ingest_rollup": f"WITH {DECODED} {_us(_rollup('dec'), *ROLLUP_US)}",
    "ingest_daily": f"WITH {DECODED} {_us(_rollup(f'(SELECT * FROM dec WHERE {BELOW})'), *ROLLUP_US)}",
    "ingest_events": """SELECT 'did:test:' || (user_id % 20) AS subject, 'id-' || event_id AS cloud_event_id, event_type AS name, epoch_us(ts) AS timestamp, event_id * 1000 AS duration_ns, '{"a":1}' AS metadata, '["ok"]' AS tags FROM events""",
    "ingest_errors": "SELECT n AS name, e AS error, (SELECT count(*) FROM events) AS ids FROM (VALUES ('obdDistanceWithMIL', 'no number'), ('notInTheCatalogue', 'unknown name'), ('broken', 'bad metadata'), ('tagged', 'bad tag')) AS t(n, e)",
    "feed_page": f"""WITH {RAW}, p AS (SELECT * FROM r WHERE type = 'fleet.status' AND (epoch_us(time), subject, id) > ({START}, 'did:test:7', 'id-5') ORDER BY epoch_us(time), subject, id LIMIT 500)
SELECT subject, epoch_us(time) AS time, type, id, source FROM p QUALIFY sum(length(data)) OVER (ORDER BY epoch_us(time), subject, id) <= 3000""",
    "cache_bootstrap": _with(_us(f"SELECT * EXCLUDE (count, first_seen, last_seen) FROM {_rollup('sig')}", "timestamp", "loc_ts")),
    "cache_answers": _with(
        f"""SELECT subject, CASE WHEN substring(subject, 10)::INTEGER % 3 = 0 THEN 'rollup' ELSE 'cache' END AS origin, name, epoch_us(timestamp) AS timestamp, value_number FROM ({LATEST}) WHERE substring(subject, 10)::INTEGER % 2 = 0
 UNION ALL SELECT DISTINCT subject, 'cache_miss', NULL, NULL::BIGINT, NULL::DOUBLE FROM (SELECT subject FROM sig UNION ALL SELECT unnest(['did:test:90', 'did:test:91'])) WHERE substring(subject, 10)::INTEGER % 6 = 0 OR length(subject) = 11 AND substring(subject, 10)::INTEGER >= 90"""
    ),
    "cache_keys": _with("SELECT DISTINCT subject, 's.' || replace(replace(rtrim(base64(encode('ÿ~' || subject)), '='), '+', '-'), '/', '_') AS key FROM sig"),
    "daily_summary": _with(
        """SELECT u.subject, strftime(dy.day, '%Y-%m-%d') AS day,
 (SELECT count(*) FROM seg WHERE seg.subject = u.subject AND start_us < day_end AND end_us > day_start) AS n_segments,
 coalesce((SELECT sum((least(end_us, day_end) - greatest(start_us, day_start)) // 1000000) FROM seg WHERE seg.subject = u.subject AND start_us < day_end AND end_us > day_start), 0)::BIGINT AS active_s,
 (SELECT count(*) FROM ev WHERE ev.subject = u.subject AND name = 'click' AND epoch_us(timestamp) >= day_start AND epoch_us(timestamp) < day_end) AS click,
 (SELECT count(*) FROM ev WHERE ev.subject = u.subject AND name = 'signup' AND epoch_us(timestamp) >= day_start AND epoch_us(timestamp) < day_end) AS signup
 FROM (SELECT DISTINCT subject FROM sig) u, dy""",
        *FREQUENCY,
        "dy AS (SELECT day, epoch_us(day) + 18000000000 AS day_start, epoch_us(day) + 104400000000 AS day_end FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-11', INTERVAL 1 DAY)) AS day))",
    ),
    "rollup_new_keys": _with(f"SELECT subject, name, count(*) AS count FROM ded WHERE epoch_us(timestamp) >= {START} AND (name = 'click' OR epoch_us(timestamp) >= {WATERMARK}) GROUP BY ALL"),
    "raw_cloud_search": _raw(f"subject IN ('did:test:3', 'did:test:8') AND type = 'fleet.status' AND source = 'src-1' AND epoch_us(time) > {START} AND epoch_us(time) < {END}"),
    "raw_restored": _raw("true", "", """subject, id, type, source, epoch_us(time) AS time, CASE WHEN producer <> 'prod-0' THEN to_json(tags)::VARCHAR END AS tags, producer = 'prod-0' AS malformed"""),
    "feed_lag": f"""WITH {RAW}, a AS (SELECT ({micros("2024-02-10")} - epoch_us(time)) / 1000000 AS age FROM r)
SELECT count(*) AS n, round(max(age), 4) AS oldest_s, round(quantile_cont(age, 0.5), 4) AS median_s, round(quantile_cont(age, 0.95), 4) AS p95_s, round(avg(CASE WHEN age > 300 THEN 1.0 ELSE 0 END), 4) AS late_share FROM a""",
    "signals_default_aggs": _with(
        f"""SELECT subject, {_bucket(DAY)} AS bucket_us, 1::INTEGER AS signal_type, round(avg(value_number), 6) AS value_number, 0::DOUBLE AS loc_lat, 0::DOUBLE AS loc_lon FROM ded WHERE name = 'click' AND {IN} GROUP BY 1, 2
 UNION ALL SELECT subject, {_bucket(DAY)}, 3, 0, arg_min(loc_lat, timestamp), arg_min(loc_lon, timestamp) FROM ded WHERE name = 'view' AND {FIX} AND {IN} GROUP BY 1, 2"""
    ),
    "privilege_one_of": _with("SELECT DISTINCT subject, name FROM sig WHERE name IN ('click', 'purchase')"),
    "subject_buckets": _with(
        """SELECT subject, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, len(subject) + 1), lambda i: ascii(subject[i])::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 256)::INTEGER AS subject_bucket
 FROM (SELECT DISTINCT subject FROM sig)"""
    ),
    "blob_roundtrip": f"WITH {RAW} SELECT subject, id, type, epoch_us(time) AS time, data FROM r",
    "fixes_in_polygon": _with(f"SELECT subject, count(*) AS count FROM ded WHERE {FIX} AND {POLYGON} GROUP BY subject"),
}
