"""A corpus pipeline: five stages over the documents table, each an operator of wayfare.llm whose decisions take effect.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import langid, mixing, neardup, secrets
from wayfare.llm.common import cut, drop, spread_join, table
from wayfare.llm.decontaminate import decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter, and those that letters drawn without any language explain better
    than the mixture of learned languages does. Where no row has a label, there is no language to compare with, and only
    the first two go. Repeated rows are judged each; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.identify(docs, model).where("lang_pred <> 'und' AND gain > 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates (five-word shingles, similarity 0.8 or more), that of the smallest
    doc_id. A row is named by its doc_id and text, so that rows that share a doc_id are judged each by its own text, and
    of rows with the same doc_id and text one is kept: the first by n_chars, source and lang. Rows without a doc_id are
    named by their text, and come after the others of their class. Null and empty texts are linked to nothing. An empty
    table stays empty."""
    keyed = docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("key"))
    found = neardup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), size=5, percent=80)
    classes = found.select(F.col("doc_id").alias("key"), "component_id").distinct()
    members = cut(keyed.select("key", "doc_id").distinct().join(classes.hint("merge"), "key"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("first"))
    gone = spread_join(members, first, ["component_id"], "key").where("key <> first").select("key")
    left = keyed.join(gone, "key", "left_anti")
    place = left.withColumn("place", F.expr("row_number() OVER (PARTITION BY key ORDER BY n_chars, source, lang)"))
    return place.where("place = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all words of a shorter one. A null or empty
    text holds none, and stays; repeated rows are judged each; without items, or documents, nothing goes."""
    found = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with each secret replaced by a mark, and n_chars then that of the new text. A null text stays
    null; repeated rows are judged each; an empty table stays empty."""
    found = secrets.find_secrets(docs.select(*COLUMNS))
    text = secrets.redact(F.col("text"), F.col("spans"))
    changed = found.withColumn("text", text)
    return changed.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which to read what is left: a row for each reading of a document. A null source is the source '', a
    null text has no tokens, repeated rows are read each; an empty table gives an empty order. Rows of sources without any
    token are left out."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]

#: Hashing, EM and floating-point bisection have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each of them keeps is written to the shared checkpoint folder, and read by the next. The table of
    a stage is deleted as soon as the next one is written, the last one when the driver ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
