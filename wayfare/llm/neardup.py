"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges,
and links that are confirmed on the full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import common
from wayfare.llm.graph import components

BINS = 256  # of the one permutation
MISSED = 1e-8  # pairs at the threshold that may share no band
_SHIFT = np.uint64(64 - 8)
LIMIT = 1 << 21  # shingles that a block holds on average
_BOUNDS = np.arange(BINS, dtype=np.uint64) << _SHIFT
#: For each bin the bins that an empty one borrows from, in order: the hash functions of the optimal densification.
_PROBES = (common.mix(np.arange(BINS * 1024, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, 1024)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingles(text: bytes | None, size: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of a shorter text, one of all its words."""
    found = text.lower().split() if text else []  # bytes: lowers A-Z and splits at ASCII white space only
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    width = min(size, n)
    acc = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            acc = common.mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return np.unique(acc)


def signature(found: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin takes that of the first bin with one on its own probe sequence."""
    at = np.searchsorted(found, _BOUNDS)
    value = found[np.minimum(at, len(found) - 1)]
    full = (at < len(found)) & ((value >> _SHIFT) == np.arange(BINS, dtype=np.uint64))
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[_PROBES[empty]]
        first = np.where(hit.any(1), _PROBES[empty, hit.argmax(1)], np.flatnonzero(full)[0])
        value[empty] = value[first]
    return value


def band_length(percent: int) -> int:
    """The most bins in a band with which at most MISSED of the pairs at the threshold share no band, as far as bins are
    independent: 6 (42 bands) at 85 hundredths, 5 (51 bands) at 80."""
    return max([1, *(r for r in range(1, 33) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED)])


def bands(found: np.ndarray, length: int) -> np.ndarray:
    rows = signature(found)[: BINS // length * length].reshape(-1, length)
    acc = np.arange(len(rows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            acc = common.mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return acc.view(np.int64)


SIGNED = "doc_id long, n_shingles long, print_a long, print_b long, keys array<long>"


def _signer(size: int, length: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch, texts in common.chunks(batches, "text"):
            n, a, b, keys, ends = [], [], [], [], [0]
            for text in texts:
                found = shingles(text, size, hashes)
                n.append(len(found))
                if len(found):
                    x = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
                    keys.append(bands(found, length))
                    a.append(int(x[0]))
                    b.append(int(x[1]))
                else:
                    a.append(None)
                    b.append(None)
                ends.append(ends[-1] + (len(keys[-1]) if len(found) else 0))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], schema=kind)

    return run


def links(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sets of which the intersection has at least percent hundredths of the union. Intersections are
    counted by products of 0/1 matrices over the members that two sets share, a strip of members at a time."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    members, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    name = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], name[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common_ = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        strip = np.zeros((len(sets), 4096), np.float32)
        strip[owner[lo:hi], column[lo:hi] - start] = 1
        common_ += strip @ strip.T
    both = common_.astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if labels is not None:
        linked &= labels[:, None] != labels[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    yield from zip(i.tolist(), j.tolist(), strict=True)


def _linker(size: int, percent: int):
    """Rows (block, rep, label, text), those of a block in a row, to (a, b): edges that span the components of the
    links between rows of a block that have different labels."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def spanned(reps: list[int], labels: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        order = sorted({(r, x.tobytes()): i for i, (r, x) in enumerate(zip(reps, sets, strict=True))}.values())
        reps, labels, sets = [reps[i] for i in order], [labels[i] for i in order], [sets[i] for i in order]
        if len(sets) < 2:
            return
        top = list(range(len(sets)))

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        for i, j in links(sets, percent, np.array(labels)):
            if (p := root(i)) != (q := root(j)):
                top[q] = p
                yield reps[i], reps[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        block, reps, labels, sets, out = None, [], [], [], []
        for batch, texts in common.chunks(batches, "text"):
            ids, reps_in, labels_in = (batch.column(k).to_pylist() for k in ("block", "rep", "label"))
            for i, text in enumerate(texts):
                if ids[i] != block:
                    out += spanned(reps, labels, sets)
                    block, reps, labels, sets = ids[i], [], [], []
                reps.append(reps_in[i])
                labels.append(labels_in[i])
                sets.append(shingles(text, size, hashes))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=kind)
                out = []
        out += spanned(reps, labels, sets)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=kind)

    return run


def _spread(key: str, n: str) -> F.Column:
    """Which of so many parts a row goes to."""
    return F.expr(f"pmod(xxhash64({key}, 7), greatest(1, {n}))")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """Classes of documents under the links "the Jaccard similarity of the shingle sets is at least percent / 100":
    (doc_id, n_shingles, component_id, kept) for each row of docs; component_id is the class's smallest doc_id.

    1. Documents with one and the same set (exact copies among them) are one node, named by their smallest doc_id, so
       that groups of copies of any size cost a partial sum.
    2. A bucket (equal band keys) of n nodes gives n - 1 candidate edges, to its smallest node, the hub: a star. Bands are
       as long as MISSED allows.
    3. Each node is first compared with the others of its smallest hub, on full sets, which finds most classes. Then
       every star that holds several classes is compared, unless all of it was: so every pair that shares a bucket is
       compared, as its bucket has one hub, or is in one class. A star of more than `block` nodes, or of more than LIMIT
       shingles, is dealt into blocks, at first such that all hold the hub and a few other nodes, then in pairs of
       blocks, except where two blocks belong to one class. Nothing is capped: work beyond that is only for pairs of one
       star that are in different classes so far. Stars are never joined for comparison, so that a long chain of
       candidates costs no more than its stars.

    Words are split at ASCII white space, A-Z lowered. A null or empty text has no shingles, is linked to nothing and
    kept; a text of fewer words than size is one shingle. Repeated rows give repeated result rows; a doc_id
    names one text, so that rows whose texts differ need ids of their own. A null doc_id has a null component, or that of its copies. Other columns aren't
    read. A block holds the sets of its texts: the longest text bounds it, where that is longer than LIMIT.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = common.cut(rows.mapInArrow(_signer(size, band_length(percent)), SIGNED))
    prints = ["print_a", "print_b"]
    filled = signed.where("print_a IS NOT NULL")
    named = filled.groupBy(*prints).agg(F.min("doc_id").alias("rep"))
    members = common.cut(common.spread_join(filled.drop("keys"), named, prints, "doc_id").select("doc_id", "n_shingles", "rep"))
    nodes = common.spread_join(filled, named, prints, "doc_id").where("doc_id = rep")
    keyed = nodes.select("rep", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    stars = common.spread_join(keyed, buckets.select("key", F.col("hub").alias("grp")), ["key"], "rep").select("rep", "grp").distinct()
    placed = common.cut(stars.join(nodes.select("rep", "n_shingles").hint("merge"), "rep"))  # a hub is in its own star

    def sized(some: DataFrame) -> DataFrame:
        """n: nodes of the group, or as many as its shingles count for."""
        sizes = some.groupBy("grp").agg(F.count("*").alias("all"), F.sum("n_shingles").alias("total")).where("all > 1")
        sizes = sizes.select("grp", "all", F.expr(f"CAST(greatest(all, ceil(total * {block} / {LIMIT})) AS BIGINT)").alias("n"))
        return common.spread_join(some, sizes, ["grp"], "rep")

    def compared(assigned: DataFrame) -> DataFrame:
        """(a, b) for assigned (rep, block, label)."""
        held = rows.join(assigned.hint("merge"), rows.doc_id == assigned.rep).select("block", "rep", "label", "text")  # alike at every size: both sides grow
        dealt = held.repartition(common.tasks(docs.sparkSession), "block").sortWithinPartitions("block", "rep")
        return common.cut(dealt.mapInArrow(_linker(size, percent), "a long, b long"))

    large = F.col("n") > block
    parts = f"CAST(ceil(n / {block / 2}) AS INT)"
    nearest = placed.groupBy("rep").agg(F.min("grp").alias("grp"), F.max("n_shingles").alias("n_shingles")).where("grp < rep")
    first = sized(nearest.unionByName(placed.where("rep = grp"))).withColumn("part", _spread("rep", parts))
    ranked = first.where(large).withColumn("rank", F.expr("row_number() OVER (PARTITION BY grp ORDER BY rep <> grp, xxhash64(rep))"))  # the hub first
    everywhere = ranked.where("rank <= 8").drop("rank").withColumn("part", F.explode(F.expr(f"sequence(0L, {parts} - 1L)")))
    first = first.withColumn("part", F.when(large, F.col("part")).otherwise(0).cast("long")).unionByName(everywhere)
    edges = compared(first.select("rep", F.xxhash64("grp", "part").alias("block"), F.col("rep").alias("label")).distinct())

    known = components(edges, "a", "b")
    now = sized(placed).join(known.hint("merge"), F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep"))
    now = common.spread_join(now, nearest.select("rep", F.col("grp").alias("least")), ["rep"], "grp", "left", 1)
    counts = now.groupBy("grp", "label").agg(F.count("*").alias("m"), F.sum(F.when((F.col("rep") == F.col("grp")) | (F.col("least") == F.col("grp")), 1).otherwise(0)).alias("met"))
    loose = counts.groupBy("grp").agg(F.sum(F.when(F.col("m") < block, F.col("m")).otherwise(0)).alias("loose"), F.sum("met").alias("met"), F.count("*").alias("labels"))
    now = common.spread_join(common.spread_join(now, counts.drop("met"), ["grp", "label"], "rep"), loose.where("labels > 1"), ["grp"], "rep")
    now = now.where(large | (F.col("met") < F.col("all")))
    big = large & (F.col("m") >= block)
    half = block // 2
    # n / all: how much longer than usual the texts of the star are
    now = now.withColumn("pure", F.when(big, F.col("label"))).withColumn(
        "part",
        F.when(~large, 0)
        .when(big, F.xxhash64("label", _spread("rep", f"CAST(ceil(m * n / all / {half}) AS INT)")))
        .otherwise(F.xxhash64(F.lit("loose"), _spread("label", f"CAST(ceil(loose * n / all / {half}) AS INT)"))),
    )
    now = common.cut(now.select("rep", "grp", "label", "pure", "part"))
    shares = now.select("grp", "part", "pure").distinct()
    other = shares.select("grp", F.col("part").alias("part_b"), F.col("pure").alias("pure_b"))
    pairs = shares.join(other, "grp").where("part <= part_b AND (pure IS NULL OR pure_b IS NULL OR pure <> pure_b)")
    pairs = pairs.withColumn("block", F.xxhash64("grp", "part", "part_b"))
    sides = pairs.select("grp", "part", "block").unionByName(pairs.select("grp", F.col("part_b").alias("part"), "block")).distinct()
    edges = edges.unionByName(compared(now.join(sides.hint("merge"), ["grp", "part"]).select("rep", "block", "label")))
    classes = components(edges, "a", "b")
    joined = members.join(classes, members.rep == classes.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("print_a IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
