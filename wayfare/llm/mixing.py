"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import cut

BLOCK_ROWS = 1 << 16
GRID = 32  # exponents that one pass over the sources tries; three passes cut the interval to 1 / 32 ** 3


def n_tokens(text: str) -> F.Column:
    """Words between ASCII white space; 0 for null."""
    kept = F.expr(rf"regexp_replace({text}, '^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$', '')")
    return F.when(F.coalesce(F.length(kept), F.lit(0)) == 0, 0).otherwise(F.size(F.split(kept, r"[\x09-\x0D\x20]+"))).cast("long")


def exponent(sources: DataFrame, budget: float, entropy: float, repeats: float) -> float:
    """The largest exponent in [0, 1] with which weights in proportion to tokens ** exponent have at least the share
    `entropy` of the largest possible entropy, or, if that repeats a source more than `repeats` times, the smallest
    that doesn't. Entropy falls and the most repeats fall as the exponent grows, so each limit is bisected, 32 ways at
    a time, by sums over the sources: they are never collected. With fewer than two sources it is 1."""
    n, most, least = sources.agg(F.count("*"), F.max("tokens"), F.min("tokens")).first()
    if n < 2:
        return 1.0
    lo, hi = 0.0, 1.0
    x = F.log(F.col("tokens") / most)

    def sums(at: list[float]) -> list[tuple[float, float]]:
        row = sources.agg(*[f for a in at for f in (F.sum(F.exp(x * a)), F.sum(x * F.exp(x * a)))]).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(at))]

    def search(good, wants_large: bool) -> float:
        """good holds on one side of [0, 1] only; the end of that side."""
        lo, hi = 0.0, 1.0
        for _ in range(3):
            at = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
            held = [good(a, *s) for a, s in zip(at, sums(at), strict=True)]
            if wants_large:
                k = max((i for i, h in enumerate(held) if h), default=0)
                lo, hi = at[k], at[min(k + 1, GRID)]
            else:
                k = min((i for i, h in enumerate(held) if h), default=GRID)
                lo, hi = at[max(k - 1, 0)], at[k]
            if lo == hi:
                break
        return lo if wants_large else hi

    by_entropy = search(lambda a, z, t: math.log(z) - a * t / z >= entropy * math.log(n) - 1e-12, True)
    by_repeats = search(lambda a, z, t: budget * math.exp(math.log(least / most) * a) / z / least <= repeats, False)
    return max(by_entropy, by_repeats)


def mix(docs: DataFrame, budget: int | None = None, entropy: float = 0.95, repeats: float = 4.0, blocks: int | None = None, seed: int = 0) -> DataFrame:
    """The documents to read, with repeats, so that sources have their target weights:
    (doc_id, source, n_tokens, weight, epoch, block_rank, slot).

    Weights are shares of tokens to the power exponent(), normalised. A source's quota is its weight times the budget
    (default: all tokens). Each source is dealt into `blocks` blocks by a hash of doc_id, or of the text where that is null
    (default: one for each BLOCK_ROWS rows of the table, 256 at least, so that a block has a bounded number of rows). An epoch reads all blocks of a source in
    an order of its own (block_rank), and the documents of a block in an order of its own (slot). A source has as many
    whole epochs as fit into its quota; in the next epoch it has the blocks that fit, and of the block that does not,
    the documents that fit from its start. So each quota is met up to one document, and the order to read in is (epoch,
    block_rank, slot) within a source. If all sources together exceed `repeats`, the budget itself asks for it.

    Only per-block sums are ever ordered: at most `blocks` rows for each source and epoch, besides the documents of one
    block. A null source is the source ''; rows with a null doc_id are returned with null. Documents without tokens are in every whole epoch. Repeated rows are read
    each; rows without any token in their source have weight 0 and are left out. Empty tables give an empty result.
    """
    key = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64(F.lit("text"), "text"))  # null ids by their text
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    narrow = cut(narrow.select("doc_id", "source", n_tokens("text").alias("n_tokens"), key.alias("key")))
    blocks = blocks or max(256, -(-narrow.count() // BLOCK_ROWS))
    narrow = narrow.withColumn("block", F.expr(f"CAST(pmod(xxhash64(key, {seed}), {blocks}) AS INT)"))
    held = cut(narrow.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    sources = held.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    a = exponent(sources, budget, entropy, repeats)
    most, z = 1, 1.0
    if total:
        most = sources.agg(F.max("tokens")).first()[0]
        z = sources.agg(F.sum(F.exp(F.log(F.col("tokens") / most) * a))).first()[0]
    quotas = sources.withColumn("weight", F.exp(F.log(F.col("tokens") / most) * a) / z).withColumn("quota", F.floor(F.col("weight") * budget).cast("long"))
    quotas = quotas.withColumn("whole", F.expr("quota DIV tokens")).select("source", "weight", "whole", F.expr("quota % tokens").alias("rest"))
    epochs = quotas.withColumn("epoch", F.explode(F.expr("sequence(CAST(0 AS BIGINT), whole)")))
    turns = held.join(epochs, "source").withColumn("turn", F.xxhash64("source", "block", "epoch", F.lit(seed)))
    turns = turns.withColumn("block_rank", F.expr("row_number() OVER (PARTITION BY source, epoch ORDER BY turn, block)"))
    turns = turns.withColumn("before", F.expr("sum(tokens) OVER (PARTITION BY source, epoch ORDER BY turn, block) - tokens"))
    turns = turns.withColumn("room", F.expr("CASE WHEN epoch < whole THEN NULL ELSE rest - before END")).where("room IS NULL OR room > 0")
    read = narrow.join(turns.select("source", "block", "weight", "epoch", "block_rank", "room", F.col("tokens").alias("held")), ["source", "block"])
    read = read.withColumn("slot", F.xxhash64("key", "epoch", F.lit(seed)))
    columns = ["doc_id", "source", "n_tokens", "weight", F.col("epoch").cast("int").alias("epoch"), "block_rank", "slot"]
    cuts = read.where("room < held")
    cuts = cuts.withColumn("upto", F.expr("sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY slot, doc_id)")).where("upto <= room")
    return read.where("room IS NULL OR room >= held").select(*columns).unionByName(cuts.select(*columns))
