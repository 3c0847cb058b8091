"""A cache of latest values beside the rollup: what it holds, whether a miss in it means that there is nothing, and which of
the two answers."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.timing import at
from wayfare.operators import rollup

FRESH_S, BEAT_S, LEAST_S, MOST_S = 90, 30, 30, 600  # fixed values: seconds


class Mode(str, Enum):
    """shadow answers from the rollup and compares; serve answers from the cache if it can."""

    OFF = "off"
    SHADOW = "shadow"
    SERVE = "serve"

    @classmethod
    def of(cls, text: str | None) -> Mode:
        return cls(text or "off")


def key(subject: Column) -> Column:
    """The cache's key: base64 for URLs, without padding."""
    text = F.translate(F.base64(F.encode(subject, "UTF-8")), "+/", "-_")
    return F.concat(F.lit("s."), F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "=+$", ""))


def bootstrapped(stored: DataFrame, signals: DataFrame, watermark: int | None) -> DataFrame:
    """The cache's rows from a rollup (of what lies below the watermark, if there is one) and the signals from it on: the
    newest value and the newest fix of each (subject, name), each by its own time."""
    tail = rollup.latest_fold(signals if watermark is None else signals.where(F.col("timestamp") >= at(watermark)))
    return reconciled(stored.select(*tail.columns), tail)


def reconciled(cache: DataFrame, more: DataFrame) -> DataFrame:
    """The cache with other rows of its kind folded in: the later of each stays, the cache's own if they tie."""
    zero = F.lit(0).cast("bigint")
    counted = [df.withColumn("count", zero).withColumn("first_seen", F.col("timestamp")).withColumn("last_seen", F.col("timestamp")) for df in (more, cache)]
    return rollup.merge(*counted).drop("count", "first_seen", "last_seen").select(*cache.columns)


@dataclass(frozen=True)
class Coverage:
    """A writer's word that the cache holds every subject of the rollup. It is worth nothing FRESH_S seconds after it was
    given, so that a writer that stops in any way takes it back."""

    proven: bool = False
    verified: float = 0.0  # when it was given, in seconds
    clean: bool = False  # the writer went down in order
    degraded: bool = False  # a row is known to be lost
    expires: bool = False  # the cache drops entries by age: then it is never complete
    failures: int = 0

    def trusted(self, now: float) -> bool:
        return self.proven and not self.degraded and not self.expires and 0 <= now - self.verified <= FRESH_S

    def started(self, now: float) -> Coverage:
        """A new writer takes over: it may go on after a clean stop, and has to reconcile() after any other."""
        return replace(self, proven=self.proven and self.clean, clean=False, verified=now if self.proven and self.clean else self.verified)

    def beat(self, now: float) -> Coverage:
        return replace(self, verified=now) if self.proven and not self.degraded else self

    def lost(self) -> Coverage:
        """A row wasn't written."""
        return replace(self, proven=False, degraded=True, failures=self.failures + 1)

    def reconciled(self, now: float, failures: int) -> Coverage:
        """All rows were folded in, from a state with so many failures: another one meanwhile makes it worthless."""
        return replace(self, proven=True, degraded=False, verified=now) if failures == self.failures else self

    def stopped(self) -> Coverage:
        return replace(self, clean=self.proven and not self.degraded)


def backoff(tries: int) -> int:
    """Seconds to wait before reconciling again."""
    return min(MOST_S, LEAST_S << min(tries, 10))


def answer(subjects: DataFrame, cache: DataFrame, stored: DataFrame, mode: Mode, misses: Mode = Mode.OFF, trusted: bool = False) -> DataFrame:
    """(subject, origin, name, timestamp, ...): latest values of the subjects, from the cache or the rollup. A subject
    that the cache holds is answered from it if the mode is to serve. One that it doesn't hold is answered by the rollup,
    unless misses are served and the cache's coverage is trusted: then there is nothing (origin cache_miss, one row)."""
    columns = cache.columns
    stored = stored.select(*columns)
    own = subjects.select("subject").distinct()
    if mode is not Mode.SERVE:
        return own.join(stored, "subject").withColumn("origin", F.lit("rollup"))
    hit = own.join(cache, "subject").withColumn("origin", F.lit("cache"))
    missed = own.join(cache.select("subject").distinct(), "subject", "left_anti")
    if misses is Mode.SERVE and trusted:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in cache.schema if f.name != "subject"]
        return hit.unionByName(missed.select("subject", *nothing, F.lit("cache_miss").alias("origin")))
    return hit.unionByName(missed.join(stored, "subject").withColumn("origin", F.lit("rollup")))


def false_negatives(subjects: DataFrame, cache: DataFrame, stored: DataFrame) -> DataFrame:
    """The subjects whose miss would have been taken for nothing although the rollup has rows."""
    missed = subjects.select("subject").distinct().join(cache.select("subject").distinct(), "subject", "left_anti")
    return missed.join(stored.select("subject").distinct(), "subject", "left_semi")
