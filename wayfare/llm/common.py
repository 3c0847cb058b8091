"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that a Python task works on at a time, so that its arrays stay small.
CHUNK_BYTES = 1 << 20

#: Maps A-Z to a-z, keeps 0-9, a-z and every byte of a non-ASCII character, and turns the rest into spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(data: bytes | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, with A-Z lowered; none for null."""
    return data.translate(WORD_BYTES).split() if data else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with at most so many bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = utf8(batch.column(batch.schema.get_field_index(text)))
        start, size = 0, 0
        for i, x in enumerate(data):
            if i > start and size + len(x or b"") > most:
                yield batch.slice(start, i - start), data[start:i]
                start, size = i, 0
            size += len(x or b"")
        yield batch.slice(start), data[start:]


def joined(data: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a chunk in one array, and where each row starts and ends."""
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(x or b"") for x in data], out=ends[1:])
    return np.frombuffer(b"".join(x or b"" for x in data), np.uint8), ends


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own, or, only where none is named and all runs on one machine (tests), a
    local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "wayfare-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared checkpoint folder and read again: later reads need no executor that made it,
    and the planner knows its size (a checkpoint keeps the estimate of the plan that made it, which joins multiply from
    round to round). The tables are dropped when the driver's process ends, if drop() hasn't done so."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _CUTS:
        atexit.register(_drop_all, spark)
    _CUTS.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


_CUTS: set[str] = set()


def drop(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that cut() returned, once nothing reads it any more."""
    _remove(df.sparkSession, df._cut)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _CUTS.discard(path)


def _drop_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        for path in list(_CUTS):
            _remove(spark, path)


def spread_join(left: DataFrame, right: DataFrame, key: list[str], by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """left joined with right, which has a row for each key, where one key may hold a large share of left: its rows are
    spread over `salts` tasks by a hash of the column `by`, and right is repeated for each. Spark's own splitting of
    skewed joins doesn't apply where right is a sum by the same key. A merge join, as right grows with the data and its
    size is underrated: it must not be broadcast."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*key, "_salt"], how).drop("_salt")


def widened(docs: DataFrame, added: str) -> tuple[list[str], StructType, pa.Schema]:
    """The columns of docs that stay when those of the DDL string are added (or replaced: Spark's names ignore case), and
    the schema with both."""
    new = StructType.fromDDL(added)
    kept = without(docs, *new.names)
    both = StructType([*(docs.schema[c] for c in kept), *new])
    return kept, both, to_arrow_schema(both)


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of df that have none of the names, in any case of letters."""
    low = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in low]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many _ before it as it takes that no column of df has it, in any case of letters."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
