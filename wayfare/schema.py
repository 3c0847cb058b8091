"""Tables, enumerations and the signal catalogue."""

from __future__ import annotations

from enum import Enum

from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "timestamp": TimestampType(), "binary": BinaryType(), "array<string>": ArrayType(StringType())}


def _table(columns: str) -> StructType:
    """Of "name type, ..."; StructType.fromDDL asks for a session, which there isn't on import."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


SIGNALS = _table(
    "subject string, subject_bucket int, name string, timestamp timestamp, source string, producer string, cloud_event_id string, "
    "value_number double, value_string string, loc_lat double, loc_lon double, loc_hdop double, loc_heading double"
)
EVENTS = _table(
    "subject string, subject_bucket int, source string, producer string, cloud_event_id string, type string, data_version string, name string, "
    "timestamp timestamp, duration_ns bigint, metadata string, tags array<string>"
)
RAW = _table(
    "subject string, time timestamp, type string, id string, source string, producer string, data_content_type string, data_version string, "
    "extras string, data string, data_base64 binary, data_index_key string, voids_id string"
)
SIGNALS_LATEST = _table(
    "subject string, subject_bucket int, name string, timestamp timestamp, value_number double, value_string string, loc_lat double, loc_lon double, "
    "loc_hdop double, loc_heading double, loc_ts timestamp, count bigint, first_seen timestamp, last_seen timestamp"
)
EVENTS_LATEST = _table("subject string, subject_bucket int, name string, count bigint, first_seen timestamp, last_seen timestamp")

LOCATION = ("loc_lat", "loc_lon", "loc_hdop", "loc_heading")


class FloatAgg(str, Enum):
    AVG = "AVG"
    MIN = "MIN"
    MAX = "MAX"
    MED = "MED"
    FIRST = "FIRST"
    LAST = "LAST"
    RAND = "RAND"


class StringAgg(str, Enum):
    TOP = "TOP"
    UNIQUE = "UNIQUE"
    FIRST = "FIRST"
    LAST = "LAST"
    RAND = "RAND"


class LocationAgg(str, Enum):
    FIRST = "FIRST"
    AVG = "AVG"
    LAST = "LAST"
    RAND = "RAND"


class Mechanism(str, Enum):
    IGNITION = "IGNITION"
    FREQUENCY = "FREQUENCY_ANALYSIS"
    CHANGE_POINT = "CHANGE_POINT_DETECTION"
    IDLING = "IDLING"
    REFUEL = "REFUEL"
    RECHARGE = "RECHARGE"
