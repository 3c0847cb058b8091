"""Signals, events and raw envelopes derived from the flat events table, by formulas of its columns alone."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.hashing import fnv_bucket


#: Of the flat table; a scan whose schema is known starts no job to find it.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet").withColumn("timestamp", F.col("ts").cast("timestamp"))


def _subject() -> Column:
    return F.concat(F.lit("did:test:"), (F.col("user_id") % 20).cast("string"))


def _fleet(e: DataFrame, copy: bool) -> DataFrame:
    """Originals, or the copies that deduplication must drop."""
    own = F.lpad(F.col("event_id").cast("string"), 12, "0")
    fix = F.col("event_id") % 10 != 0
    return (e.where("event_id % 7 = 0") if copy else e).select(
        _subject().alias("subject"),
        F.col("event_type").alias("name"),
        "timestamp",
        F.concat(F.lit("src-"), (F.col("event_id") % 3).cast("string")).alias("source"),
        (F.concat(F.lit("zz"), own) if copy else own).alias("cloud_event_id"),
        (F.lit(-999.0) if copy else F.col("value")).alias("value_number"),
        F.get(F.array(*map(F.lit, ("BEV", "HEV", "ICE", "PHEV"))), (F.col("event_id") % 4).cast("int")).alias("value_string"),
        F.when(fix, F.col("event_id") * 37 % 180 - 90).otherwise(0).cast("double").alias("loc_lat"),
        F.when(fix, F.col("event_id") * 53 % 360 - 180).otherwise(0).cast("double").alias("loc_lon"),
        (F.col("event_id") % 7).cast("double").alias("loc_hdop"),
        (F.col("event_id") * 11 % 360).cast("double").alias("loc_heading"),
        "event_id",
        "props",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _base(spark, sf_dir)
    return _fleet(e, False).unionByName(_fleet(e, True)).drop("event_id", "props")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _base(spark, sf_dir)
    both = _fleet(e, False).unionByName(_fleet(e, True))
    tag = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    return both.select(
        "subject", "name", "timestamp", "source", "cloud_event_id",
        (F.col("event_id") % 1000 * 1_000_000).alias("duration_ns"),
        F.col("props").alias("metadata"),
        F.array("name", tag).alias("tags"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes: ids repeat across types, every seventh row comes twice within a second, and every fiftieth voids an id."""
    e = _base(spark, sf_dir)
    id_ = F.concat(F.lit("id-"), F.floor(F.col("event_id") / 2).cast("string"))
    tag = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    one = e.select(
        _subject().alias("subject"),
        F.col("timestamp").alias("time"),
        F.concat(F.lit("fleet."), F.when(F.col("event_id") % 2 == 0, "status").otherwise("events")).alias("type"),
        id_.alias("id"),
        F.concat(F.lit("src-"), (F.col("event_id") % 3).cast("string")).alias("source"),
        F.concat(F.lit("prod-"), (F.col("event_id") % 4).cast("string")).alias("producer"),
        F.lit("v1.0").alias("data_version"),
        F.concat(F.lit('{"tags":["'), F.col("event_type"), F.lit('","'), tag, F.lit('"]}')).alias("extras"),
        F.concat(F.lit('{"value":'), (F.col("event_id") % 100).cast("string"), F.lit("}")).alias("data"),
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("id-"), F.floor(F.col("event_id") / 2 + 10).cast("string"))).otherwise("").alias("voids_id"),
        "event_id",
    )
    again = one.where("event_id % 7 = 0").withColumn("time", F.expr("timestamp_micros(unix_micros(time) + 1)"))
    return one.unionByName(again).drop("event_id")


def status_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status envelopes with a number, a numeric string, a location, and two values that can't be decoded."""
    e = _base(spark, sf_dir)
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    n = F.col("event_id").cast("string")

    def signal(name: str, *value: Column) -> Column:
        return F.concat(F.lit('{"timestamp":"'), stamp, F.lit(f'","name":"{name}","value":'), *value, F.lit("}"))

    data = F.concat(
        F.lit('{"signals":['),
        F.concat_ws(
            ",",
            signal("speed", (F.col("event_id") % 200).cast("string")),
            signal("exteriorAirTemperature", F.lit('"'), n, F.lit('.5"')),
            signal("powertrainType", F.lit('"'), F.when(F.col("event_id") % 2 == 0, "HEV").otherwise("BEV"), F.lit('"')),
            signal("currentLocationCoordinates", F.lit('{"latitude":'), (F.col("event_id") % 90).cast("string"), F.lit(',"longitude":'), (F.col("event_id") % 180).cast("string"), F.lit(',"hdop":1}')),
            signal("obdDistanceWithMIL", F.lit('"many"')),
            signal("notInTheCatalogue", F.lit("1")),
        ),
        F.lit("]}"),
    )
    return e.select(_subject().alias("subject"), F.col("timestamp").alias("time"), F.lit("fleet.status").alias("type"), F.concat(F.lit("id-"), n).alias("id"), F.lit("src-0").alias("source"), F.lit("prod-0").alias("producer"), data.alias("data"))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event envelopes with a good event, one with bad metadata and one with an upper-case tag."""
    e = _base(spark, sf_dir)
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    def event(name: Column, metadata: str, tag: str) -> Column:
        return F.concat(F.lit('{"name":"'), name, F.lit('","timestamp":"'), stamp, F.lit('","durationNs":'), (F.col("event_id") * 1000).cast("string"), F.lit(f',"metadata":{metadata},"tags":["{tag}"]}}'))

    data = F.concat(F.lit('{"events":['), F.concat_ws(",", event(F.col("event_type"), r'"{\"a\":1}"', "ok"), event(F.lit("broken"), '"{"', "ok"), event(F.lit("tagged"), '""', "Loud")), F.lit("]}"))
    return e.select(_subject().alias("subject"), F.col("timestamp").alias("time"), F.lit("fleet.events").alias("type"), F.concat(F.lit("id-"), F.col("event_id").cast("string")).alias("id"), F.lit("src-0").alias("source"), F.lit("prod-0").alias("producer"), data.alias("data"))


def with_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("subject_bucket", fnv_bucket(F.col("subject")))


def repeated_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status envelopes that tell the speed of one instant three times, at last the least, written in another zone, and
    then one that can't be decoded."""
    e = _base(spark, sf_dir)
    n = F.col("event_id") % 200
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    signal = lambda zone, value: F.concat(F.lit('{"timestamp":"'), stamp, F.lit(f'{zone}","name":"speed","value":'), value, F.lit("}"))
    some = [signal("Z", (n + 300).cast("string")), signal("Z", (n + 900).cast("string")), signal("+00:00", n.cast("string")), signal("Z", F.lit('"fast"'))]
    data = F.concat(F.lit('{"signals":['), F.concat_ws(",", *some), F.lit("]}"))
    return e.select(_subject().alias("subject"), F.col("timestamp").alias("time"), F.lit("fleet.status").alias("type"), F.concat(F.lit("id-"), F.col("event_id").cast("string")).alias("id"), F.lit("src-0").alias("source"), F.lit("prod-0").alias("producer"), data.alias("data"))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, or, only where none is named and all runs on one machine, here. It is
    deleted when the driver's process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    path = f"{named or tempfile.gettempdir()}/wayfare-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
