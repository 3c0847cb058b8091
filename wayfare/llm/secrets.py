"""Secret scans: known forms, and a battery of randomness tests under length-aware control of false discoveries.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import fresh, without
from wayfare.llm.native import below, in_chunks, once, piece, places, running

#: The base forms, and the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # one match takes all of [A-Z0-9], so 20 characters may as well be asked for at once
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

#: Alphabets in the order in which they are tried.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
BINS = 2000  # of -20 ln p
HALF = 14  # bins of p above about a half, which strings that weren't drawn evenly hardly reach
CLASSES = (32, 64)  # lengths from which a class of its own starts


def _alphabet(s: Column) -> Column:
    out = None
    for symbols in ALPHABETS.values():
        held = F.translate(s, symbols, "") == ""
        out = F.when(held, F.lit(symbols)) if out is None else out.when(held, F.lit(symbols))
    return out.otherwise(F.lit("".join(sorted(set("".join(ALPHABETS.values()))))))


def candidates(text: Column) -> Column:
    """(start, kind, end, bin, class) of each long run that has both letters and digits.

    The run's encoding is the first alphabet that holds it. Three tests ask if it was drawn evenly from that alphabet:
    chi-squared of the symbol counts (by the Wilson-Hilferty cube root), runs above and below the alphabet's middle,
    and serial correlation of neighbours. Fisher's sum of their logarithms makes one p of the three, of which the bin is
    the rounded -20 ln.
    """
    found = F.filter(places(text, CANDIDATE, 3), lambda x: x["part"].rlike("[0-9]") & x["part"].rlike("[A-Za-z]"))

    def with_values(x: Column) -> Column:
        symbols = _alphabet(x["part"])
        chars = F.filter(F.split(x["part"], ""), lambda c: c != "")
        return F.struct(
            x["start"].alias("start"),
            x["kind"].alias("kind"),
            x["end"].alias("end"),
            x["part"].alias("s"),
            F.length(symbols).cast("double").alias("k"),
            F.transform(chars, lambda c: F.position(c, symbols).cast("double") - 1).alias("v"),
            F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(F.length(x["part"]) - F.length(F.replace(x["part"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
        )

    def with_statistics(x: Column) -> Column:
        """Each test's statistic as a standard normal variable."""
        n, k, v = F.size(x["v"]).cast("double"), x["k"], x["v"]
        chi, free = x["squares"] * k / n - n, k - 1
        even = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        ahead, behind = F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1)
        high = F.aggregate(v, F.lit(0.0), lambda a, y: a + F.when(y >= k / 2, 1.0).otherwise(0.0))
        turns = F.aggregate(F.zip_with(ahead, behind, lambda a, b: F.when((a >= k / 2) != (b >= k / 2), 1.0).otherwise(0.0)), F.lit(1.0), lambda a, y: a + y)
        mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n

        def runs(pairs: Column) -> Column:
            return (turns - (pairs / n + 1)) / F.sqrt(F.greatest(pairs * (pairs - n) / (n * n * (n - 1)), F.lit(1e-9)))

        def serial(mean: Column) -> Column:
            power = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
            lag = F.aggregate(F.zip_with(ahead, behind, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, y: a + y)
            return (lag / F.greatest(power, F.lit(1e-9)) + 1 / n) * F.sqrt(n)

        size = sum(F.when(n >= c, 1).otherwise(0) for c in CLASSES)
        z = F.array(even, once(high, lambda h: once(2 * h * (n - h), runs)), once(mean, serial))
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), z.alias("z"), size.alias("class"))

    def with_bin(x: Column) -> Column:
        """Each is two-sided. Their p together are that of a chi-squared variable with six degrees of freedom."""
        log = lambda z: F.log(F.least(F.lit(1.0), F.greatest(2 * below(-F.abs(z)), F.lit(1e-100))))
        bin_ = lambda y: F.least(F.lit(BINS), F.floor(20 * (y - F.log(1 + y + y * y / 2)))).cast("int")
        sums = F.aggregate(F.transform(x["z"], log), F.lit(0.0), lambda a, y: a - y)
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.greatest(F.lit(0), once(sums, bin_)).alias("bin"), x["class"].alias("class"))

    return F.transform(F.transform(F.transform(found, with_values), with_statistics), with_bin)


def largest_bins(counts: dict[tuple[int, int], int], rate: float) -> list[int]:
    """For each class of lengths the largest bin that is taken for random, from the number of candidates by (class, bin).

    p of evenly drawn strings is even on (0, 1), and others hardly exceed a half: so twice the candidates above a half
    (Storey's estimate) are the drawn ones of the class, and of these a share 1 - t has p >= t. The rest of those with
    p >= t are false discoveries: t goes as low as their estimated share stays within the rate. Short strings, on which
    the tests have little power, so need a larger p than long ones. -1: there is no discovery.
    """
    out = []
    for c in range(len(CLASSES) + 1):
        own = {b: n for (k, b), n in counts.items() if k == c}
        drawn = sum(n for b, n in own.items() if b < HALF) / (1 - math.exp(-HALF / 20))
        taken, most = 0, -1
        for b in sorted(own):
            taken += own[b]
            if 1 - drawn * (1 - math.exp(-(b + 1) / 20)) / taken <= rate:
                most = b
        out.append(most)
    return out


def thresholds(tested: DataFrame, rate: float) -> list[int]:
    """largest_bins() of a column found, from counts of at most 3 x 2001 bins."""
    bins = tested.select(F.explode("found").alias("x")).groupBy("x.class", "x.bin").count().collect()
    return largest_bins({(c, b): n for c, b, n in bins}, rate)


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """docs with a column spans: array of (start, kind, end), by start and then kind as in KINDS; code points, end
    exclusive.

    Kinds 0 to 2 are the base forms, found in the whole text. Kind 3, `random`, are runs of 20 and more that the battery
    takes for random strings and that overlap no base span: those whose p is large enough that, among all candidates of
    the corpus in their class of lengths, the estimated share of false discoveries is at most `rate`. So the text is read
    twice, once for the counts of p. A null or empty text has no spans. Repeated rows are judged each. All columns of docs
    are kept; one that is named spans, in any case of letters, is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    most = thresholds(docs.select(candidates(text).alias("found")), rate)
    base = F.concat(F.filter(places(text, ASSIGN, 0, 2), lambda x: F.length(x["part"]) >= 6), places(text, ACCESS, 1), places(text, HEX, 2))
    kept = without(docs, "spans")
    known, tried = fresh(docs, "base", "tried")
    narrow = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    out = docs.select(*kept, F.array_sort(F.transform(base, narrow)).alias(known), candidates(text).alias(tried))
    taken = lambda x: F.when(x["class"] == 0, most[0]).when(x["class"] == 1, most[1]).otherwise(most[2])
    held = F.filter(tried, lambda x: (x["bin"] <= taken(x)) & ~F.exists(known, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.select(*kept, F.array_sort(F.concat(known, F.transform(held, narrow))).alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of spans replaced by the mark. Reads each chunk of the text once or a few times."""
    reach = running(F.transform(spans, lambda x: x["end"]), F.greatest)  # where all spans before one have ended

    def done(held: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            at = F.get(held["reach"], i)
            return F.when((x["start"] > at) | (i == 0), F.concat(piece(held["chunks"], at, x["start"]), F.lit(mark))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(spans, part), ""), piece(held["chunks"], F.element_at(held["reach"], -1), F.length(text)))

    return F.when(F.size(spans) > 0, once(F.struct(in_chunks(text).alias("chunks"), reach.alias("reach")), done)).otherwise(text)
