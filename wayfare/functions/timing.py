"""Buckets, literals and durations in microseconds."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"ns": 1e-3, "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def micros(t: str | datetime) -> int:
    """Of a time in UTC."""
    t = datetime.fromisoformat(t) if isinstance(t, str) else t
    t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t
    return round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


def at(us: int) -> Column:
    return F.timestamp_micros(F.lit(us))


def between(column: str, start: int | None, end: int | None) -> Column:
    """start is inside, end is not."""
    c, out = F.col(column), F.lit(True)
    out = out if start is None else out & (c >= at(start))
    return out if end is None else out & (c < at(end))


def bucket_us(ts: Column, width: int, origin: int = 0) -> Column:
    """The start of the bucket, in microseconds, where one bucket starts at the origin."""
    us = F.unix_micros(ts)
    return us - F.pmod(us - F.lit(origin), F.lit(width))


def duration_us(text: str) -> int:
    """'2h45m', '300ms', '1.5h': at least one microsecond."""
    if not re.fullmatch(r"(?:\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h))+", text):
        raise ValueError(f"{text!r} is no duration")
    us = int(sum(float(n) * UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)))
    if us < 1:
        raise ValueError("an interval has at least one microsecond")
    return us
