"""Search of raw event envelopes."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wayfare.functions.filters import ArrayFilter
from wayfare.functions.timing import at, micros
from wayfare.operators import dedup

LOOKBACK_DAYS, MOST = 400, 1000
SETS = ("subject", "type", "source", "producer", "id", "data_version", "extras")
HEADER = ("subject", "time", "type", "id", "source", "producer", "data_version", "extras", "voids_id")


@dataclass(frozen=True)
class Search:
    """isin and notin: lists by column. after and before are microseconds, neither inside. Without after, ids and subjects
    only the 400 days up to before, or else up to now, are read (now: the time of the query, if it isn't given)."""

    isin: dict[str, list[str]] = field(default_factory=dict)
    notin: dict[str, list[str]] = field(default_factory=dict)
    tags: ArrayFilter | None = None
    after: int | None = None
    before: int | None = None
    now: int | None = None

    def __post_init__(self):
        if unknown := (self.isin.keys() | self.notin.keys()) - set(SETS):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        if self.tags and self.tags.any_of:
            raise ValueError("alternatives aren't supported here")

    @classmethod
    def cloud(cls, subject: str, type: str | None = None, types: list[str] | None = None, after: str | None = None, before: str | None = None, **values: str) -> Search:
        """Of one subject; type and types are alternatives to each other."""
        kinds = [t for t in [type, *(types or [])] if t is not None]
        isin = {"subject": [subject]} | ({"type": kinds} if kinds else {}) | {k: [v] for k, v in values.items()}
        return cls(isin=isin, after=after and micros(after), before=before and micros(before))

    @classmethod
    def simple(cls, after: str | None = None, before: str | None = None, **values: str) -> Search:
        """Each value as a list of one."""
        return cls(isin={k: [v] for k, v in values.items()}, after=after and micros(after), before=before and micros(before))

    def on(self, df: DataFrame) -> DataFrame:
        for column, values in self.isin.items():
            df = df.where(F.col(column).isin(values)) if values else df
        for column, values in self.notin.items():
            df = df.where(~F.col(column).isin(values)) if values else df
        after = self.floor()
        df = df if after is None else df.where(F.col("time") > at(after))
        df = df if self.before is None else df.where(F.col("time") < at(self.before))
        if self.tags:
            tags = F.coalesce(F.from_json(F.get_json_object("extras", "$.tags"), "array<string>"), F.array().cast("array<string>"))
            df = df.where(self.tags.on(tags))
        return df


    def floor(self) -> int | None:
        if self.after is not None or self.isin.get("id") or self.isin.get("subject"):
            return self.after
        last = self.before if self.before is not None else self.now
        last = round(time.time() * 1_000_000) if last is None else last
        return last - LOOKBACK_DAYS * 86_400_000_000

    def tombstones(self, df: DataFrame) -> DataFrame:
        """Rows that may void a match: of the subjects that are asked for, whenever they came."""
        subjects = self.isin.get("subject")
        return df.where(F.col("subject").isin(subjects)) if subjects else df


def standing(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """rows that are no tombstone and to which no tombstone of the same subject refers."""
    voided = raw.where(F.coalesce("voids_id", F.lit("")) != "").select("subject", F.col("voids_id").alias("id")).distinct()
    return rows.where(F.coalesce("voids_id", F.lit("")) == "").join(voided, ["subject", "id"], "left_anti")


def found(raw: DataFrame, search: Search, columns: tuple[str, ...] = HEADER) -> DataFrame:
    """Matching events without payloads (they aren't read), voided ones left out, one for each key."""
    return dedup.raw(standing(search.on(raw).select(*columns), search.tombstones(raw)))


def listing(raw: DataFrame, search: Search, limit: int = 10, newest: bool = True) -> DataFrame:
    """In the order of time, id and type."""
    order = [F.desc(c) if newest else F.asc(c) for c in ("time", "id", "type")]
    out = found(raw, search).orderBy(*order, "subject", "source").limit(min(max(limit, 1), MOST))
    return out.withColumn("locator", F.concat_ws("/", F.lit("lake:/"), "subject", "id"))


class NotFound(LookupError):
    pass


def latest(raw: DataFrame, search: Search) -> DataFrame:
    return listing(raw, search, 1)


def latest_row(raw: DataFrame, search: Search) -> Row:
    """The newest match; an error if there is none."""
    row = latest(raw, search).first()
    if row is None:
        raise NotFound("no event matches")
    return row


def restored(rows: DataFrame) -> DataFrame:
    """rows with what the header has no columns for, from extras: tags (null if they aren't a list of strings), and
    malformed (extras that are no JSON object, which are left out and can be counted)."""
    text = F.coalesce("extras", F.lit(""))
    there = ~text.isin("", "{}")
    parsed = F.try_parse_json(text)
    sound = there & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.tags", "variant"))
    tags = F.when(kind == "ARRAY<STRING>", F.try_variant_get(parsed, "$.tags", "array<string>"))
    return rows.withColumn("tags", F.when(sound, tags)).withColumn("malformed", there & ~sound)


def type_summaries(raw: DataFrame, search: Search) -> DataFrame:
    return found(raw, search).groupBy("type").agg(F.count("*").alias("count"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))


def payloads(raw: DataFrame, indexes: DataFrame) -> DataFrame:
    """indexes (position, subject, id, and the rest of the header) with data: of the row with the same header, or else of
    the newest one with that subject and id, since these two aren't unique. An index of neither is left with null."""
    keys = ["subject", "id", "time", "type", "source"]
    own = raw.select(*keys, "data")
    exact = dedup.first_of(own, keys, ["data"]).withColumnRenamed("data", "exact")
    newest = raw.groupBy("subject", "id").agg(F.max_by("data", F.struct("time", "type", "source", "data")).alias("newest"))
    out = indexes.join(exact, keys, "left").join(newest, ["subject", "id"], "left")
    return out.withColumn("data", F.coalesce("exact", "newest")).drop("exact", "newest")


def fetched(raw: DataFrame, indexes: DataFrame, budget: int = 256 << 20, most: int = 1000) -> DataFrame:
    """payloads() of at most `most` indexes (position, ...) in their order; an error if one has no event, or if all
    payloads together have more bytes than the budget. The sums are checked before any payload is sent anywhere."""
    n = indexes.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} events")
    if not n:
        raise NotFound("no events are asked for")
    found = payloads(raw, indexes)
    missing, size = found.agg(F.sum(F.when(F.col("data").isNull(), 1).otherwise(0)), F.sum(F.octet_length("data"))).first()
    if missing:
        raise NotFound(f"{missing} events aren't there")
    if size > budget:
        raise ValueError(f"{size} bytes of payloads; the budget is {budget}")
    return found.orderBy("position")


def valid_key(key: str) -> bool:
    """Whether an object key stays inside its folder."""
    return bool(key) and not key.startswith("/") and ".." not in key.split("/")


def with_blobs(raw: DataFrame, files: DataFrame, most: int = 50 << 20) -> DataFrame:
    """raw with content: of the file (path, length, content: what the binaryFile source gives) that data_index_key is the
    end of; null where there is none, or it is too large. Only the keys in use are joined."""
    key = F.regexp_extract("path", r"(cloudevent/blobs/.*)$", 1)
    held = files.where(F.col("length") <= most).select(key.alias("data_index_key"), "content").where("data_index_key <> ''")
    return raw.join(held, "data_index_key", "left")


def blob(content, key, magic: bytes = b"DBE1"):
    """The plaintext of an AES-GCM blob: a magic word, nonce, text and tag, with the object's key as associated data.
    Content without the magic word is plain. `key` is a pair of Columns (secret, object key)."""
    secret, name = key
    body = F.substring(content, len(magic) + 1, 1 << 30)
    sealed = F.substring(content, 1, len(magic)) == F.lit(magic)
    return F.when(sealed, F.try_aes_decrypt(body, secret, F.lit("GCM"), F.lit("DEFAULT"), name)).otherwise(content)
