"""Column expressions that the native operators share."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of a word, once A-Z are lowered: all but ASCII punctuation, white space and controls.
WORD = r"0-9a-z\x{80}-\x{10FFFF}"
_STEP = 256
_CHUNK = 4096


def lowered(text: str) -> Column:
    """The text with A-Z lowered; empty for null."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)


def n_words(low: Column) -> Column:
    """Words of a lowered text: pieces between other characters, less an empty one at either end."""
    inner = F.regexp_replace(low, f"^[^{WORD}]+|[^{WORD}]+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, f"[^{WORD}]+"))).cast("long")


def running(items: Column, op: Callable[[Column, Column], Column] = operator.add) -> Column:
    """The sums of all items before each item, and of all: one more than there are items. Or what else `op` makes of
    them from 0 on, if it is associative. Works in steps of 256 items, as adding to an array copies it."""
    zero = F.lit(0).cast("long")
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / _STEP).cast("int") - 1))
    cut = F.transform(steps, lambda i: F.slice(items, i * _STEP + 1, F.lit(_STEP)))

    def upto(some: Column, start: Column) -> Column:
        return F.aggregate(some, F.array(start.cast("long")), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    totals = upto(F.transform(cut, lambda x: F.aggregate(x, zero, lambda a, y: op(a, y))), zero)
    inner = F.transform(F.arrays_zip(cut.alias("c"), totals.alias("t")), lambda z: F.when(z["c"].isNotNull(), F.slice(upto(z["c"], z["t"]), F.lit(1), F.size(z["c"]))))
    return F.concat(F.flatten(F.filter(inner, lambda x: x.isNotNull())), F.array(F.element_at(totals, -1)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once even if it stands in the body of a lambda."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of the text that in_chunks() cut up. Reads only the chunks that it touches."""
    lo, hi = start.cast("int"), end.cast("int")
    touched = F.sequence((lo / _CHUNK).cast("int"), ((hi - 1) / _CHUNK).cast("int"))
    part = lambda k: F.substring(F.get(chunks, k), F.greatest(lo - k * _CHUNK, F.lit(0)) + 1, F.least(hi - k * _CHUNK, F.lit(_CHUNK)) - F.greatest(lo - k * _CHUNK, F.lit(0)))
    return F.when(hi > lo, F.array_join(F.transform(touched, part), "")).otherwise(F.lit(""))


def in_chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def places(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """The matches of a pattern that can't match nothing, as (start, kind, end, part): code points, and the group's text.
    What split() leaves between the matches gives their positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    sizes = F.transform(found, lambda x: F.length(x).cast("long"))
    before = F.zip_with(running(gaps), running(sizes), lambda a, b: F.struct(a.alias("gap"), b.alias("own")))
    rows = F.arrays_zip(F.slice(before, F.lit(2), F.size(found)).alias("at"), sizes.alias("n"), part.alias("part"))

    def row(x: Column) -> Column:
        # at is taken one piece further, so that its own sum holds this match too
        start = x["at"]["gap"] + x["at"]["own"] - x["n"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (x["at"]["gap"] + x["at"]["own"]).alias("end"), x["part"].alias("part"))

    return F.when(text.rlike(pattern), F.transform(rows, row)).otherwise(F.array().cast("array<struct<start: bigint, kind: int, end: bigint, part: string>>"))


def below(z: Column) -> Column:
    """The standard normal distribution function (Abramowitz and Stegun 26.2.17; fixed values)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z > 0, 1 - tail).otherwise(tail)
