"""Approximate nearest neighbours by learned partitions: a balanced partitioning of a neighbour graph, and a small
classifier that routes vectors to partitions."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import cut

NEAR = 10  # neighbours of a vector in the graph
HIDDEN = 128
WIDTH = 256  # partitions of a level at most
HELD_BACK = 8  # one of so many sampled rows only measures recall


def knn(base: np.ndarray, queries: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Indices of the nearest base rows, a block of queries at a time; own: queries are the base, and not their own neighbours."""
    out, norms = [], (base * base).sum(1)
    for i in range(0, len(queries), 512):
        d = norms[None, :] - 2 * queries[i : i + 512] @ base.T
        if own:
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Labels of `parts` (a power of two) groups of equal size, give or take one, that cut few edges of the graph: each
    group is halved at the median of its main direction, then pairs whose exchange saves most edges change sides."""
    label = np.zeros(len(x), np.int64)
    a = np.repeat(np.arange(len(x)), near.shape[1])
    edges = np.concatenate([np.stack([a, near.ravel()]), np.stack([near.ravel(), a])], axis=1)
    rng = np.random.default_rng(0)
    for _ in range(parts.bit_length() - 1):
        side = np.zeros(len(x), np.int64)
        inside = edges[:, label[edges[0]] == label[edges[1]]]
        for group in range(label.max() + 1):
            own = np.flatnonzero(label == group)
            y = x[own] - x[own].mean(0)
            v = rng.standard_normal(x.shape[1])
            for _ in range(20):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) + 1e-30
            side[own[np.argsort(y @ v, kind="stable")[len(own) // 2 :]]] = 1
        for _ in range(30):
            across = side[inside[0]] != side[inside[1]]
            gain = np.bincount(inside[0], np.where(across, 1, -1), minlength=len(x))
            moved = 0
            for group in range(label.max() + 1):
                left, right = (np.flatnonzero((label == group) & (side == s)) for s in (0, 1))
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                n = min(len(left), len(right))
                m = int((gain[left[:n]] + gain[right[:n]] > 0).sum()) // 2
                side[left[:m]], side[right[:m]] = 1, 0
                moved += m
            if not moved:
                break
        label = 2 * label + side
    return label


@dataclass
class Router:
    """A perceptron with one hidden layer, and how many of its most probable partitions a query visits."""

    shift: np.ndarray
    scale: float
    weights: list[np.ndarray]
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.weights
        return np.maximum((x - self.shift) / self.scale @ w + b, 0) @ u + c


def train(x: np.ndarray, target: np.ndarray, steps: int = 300) -> Router:
    """Adam on the cross-entropy with the shares of each row's neighbours that the partitions hold."""
    rng = np.random.default_rng(0)
    router = Router(x.mean(0), float(x.std()) or 1.0, [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, target.shape[1])) * 0.05, np.zeros(target.shape[1])])
    y = (x - router.shift) / router.scale
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in router.weights]
    for t in range(1, steps + 1):
        w, b, u, c = router.weights
        h = np.maximum(y @ w + b, 0)
        z = h @ u + c
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - target) / len(x)
        e = (d @ u.T) * (h > 0)
        for i, g in enumerate((y.T @ e, e.sum(0), h.T @ d, d.sum(0))):
            m, v = state[i]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            router.weights[i] = router.weights[i] - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return router


def fit(sample: np.ndarray, parts: int, recall: float) -> Router:
    """The router, with the least number of probes that finds `recall` of the neighbours in the sample of its rows held
    back (all, if none does): one of HELD_BACK, which neither the partitions nor the router were fitted on."""
    held = np.arange(len(sample)) % HELD_BACK == 0
    known = sample[~held]
    near = knn(known, known, min(NEAR, len(known) - 1), own=True)
    label = balanced_parts(known, near, parts)
    target = np.zeros((len(known), parts))
    rows = np.arange(len(known))
    np.add.at(target, (np.repeat(rows, near.shape[1]), label[near].ravel()), 1)
    target[rows, label] += near.shape[1] / 2
    router = train(known, target / target.sum(1, keepdims=True))
    scores = router.scores(sample)
    own, order = scores.argmax(1), np.argsort(-scores[held], axis=1, kind="stable")
    rank = np.empty_like(order)
    rank[np.arange(len(order))[:, None], order] = np.arange(parts)
    found = knn(sample, sample[held], min(NEAR, len(sample) - 1) + 1)
    others = found != np.flatnonzero(held)[:, None]
    needed = np.take_along_axis(rank, own[found], 1)[others]
    router.probes = next((t for t in range(1, parts) if (needed < t).mean() >= recall), parts)
    return router


def usable(v: Column) -> Column:
    """Neither null nor zero, nor with a component that is null or not finite."""
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~broken & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest of each query by Euclidean distance, then id. Products rule out most rows, by more than their error;
    the rest are measured by differences."""
    norms = (base * base).sum(1)
    for q, own in zip(queries, query_ids.tolist(), strict=True):
        keep = np.flatnonzero(ids != own)
        rough = norms[keep] - 2 * (base[keep] @ q)
        if len(keep) > k:
            bound = np.partition(rough, k - 1)[k - 1] + 1e-9 * (1 + q @ q + norms.max())
            keep = keep[rough <= bound]
        d = np.sqrt(((base[keep] - q) ** 2).sum(1))
        for i in np.lexsort((ids[keep], d))[:k]:
            yield own, int(ids[keep[i]]), float(d[i])


class Tree:
    """Routers of one or two levels: the first deals vectors to partitions, and those of the second deal a partition that
    holds many to partitions of its own. A path is partition * WIDTH + partition of the second level."""

    def __init__(self, first: Router | None, second: dict[int, Router]):
        self.first, self.second = first, second

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The first level alone."""
        return self.first.scores(x).argmax(1) if self.first and len(x) else np.zeros(len(x), np.int64)

    def home(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        path = part.astype(np.int64) * WIDTH
        for p in np.unique(part).tolist():
            if p in self.second:
                own = part == p
                path[own] += self.second[p].scores(x[own]).argmax(1)
        return path

    def visits(self, x: np.ndarray, held: dict[int, int], k: int) -> list[np.ndarray]:
        """The paths that each vector visits: as many of the most probable partitions as the routers found necessary, and
        more in the same order while those hold no more than k vectors."""
        if not self.first or not len(x):
            return [np.array(sorted(held), np.int64)] * len(x)
        order = np.argsort(-self.first.scores(x), axis=1, kind="stable")
        inner = {p: np.argsort(-r.scores(x), axis=1, kind="stable") for p, r in self.second.items() if p in set(order[:, : self.first.probes].ravel().tolist())}
        out = []
        for i, parts in enumerate(order.tolist()):
            must, rest = [], []
            for n, p in enumerate(parts):
                if p in self.second:
                    subs = (inner[p][i] if p in inner else np.arange(len(self.second[p].weights[3]))).tolist()
                else:
                    subs = [0]
                cut = self.second[p].probes if p in self.second else 1
                (must if n < self.first.probes else rest).extend(p * WIDTH + s for s in subs[:cut])
                rest.extend(p * WIDTH + s for s in subs[cut:])
            total = sum(held.get(c, 0) for c in must)
            for c in rest:
                if total > k:
                    break
                must.append(c)
                total += held.get(c, 0)
            out.append(np.array([c for c in must if held.get(c, 0)], np.int64))
        return out


def _fitter(parts: dict[int, int], recall: float):
    """Rows (part, v) of a partition's sample to (part, router): the second level, fitted on the executors."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        x = np.array(group.column("v").combine_chunks().flatten()).reshape(group.num_rows, -1)
        found = fit(x, parts[part], recall)
        found.weights, found.shift = [w.astype(np.float32) for w in found.weights], found.shift.astype(np.float32)
        return pa.table({"part": pa.array([part], pa.int32()), "router": pa.array([pickle.dumps(found)], pa.binary())})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = 4096, rows_per_part: int = 4096, recall: float = 0.98, block: int = 8192, width: int = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) that is_query picks, the k nearest
    rows found among all others.

    The neighbour graph, its partitions and the router are fitted on `sample` rows, those with the smallest hash of
    vec_id; all rows are indexed, each in its most probable partition, of which there is one for each rows_per_part rows
    (a power of two from 8 to `width`). A partition that then holds more than twice rows_per_part rows has a graph, partitions
    and a router of its own, fitted by a task on a sample of its own. So cells stay small up to width ** 2 * rows_per_part
    rows, some 270 million; beyond that they grow, and nothing is left out. The routers, at most width + 1 of 160 KB, are
    broadcast. A query visits as many partitions of each level as rows held back from the fit needed for `recall`, and
    more while those hold no more than k vectors. A sample of fewer than 16 rows for each partition can teach no router:
    then all rows are one partition, and the search is exact. Partitions and their queries are dealt into blocks of bounded size, so that a
    partition with any share of the rows is spread over tasks.

    Rows with the same vector are one entry with its k + 1 smallest ids; no others of them can be among the k nearest.
    Vectors that are null, zero, or hold null or non-finite components, or whose length isn't the most frequent one,
    take no part, nor do null ids. Repeated rows count once. Ties go to the smaller vec_id. An empty table gives an empty
    result. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    shape = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], shape)
    rows = rows.where(F.size("v") == lengths["n"]).select("vec_id", "v", "asks")
    base = rows.select("vec_id", "v").withColumn("place", F.expr("dense_rank() OVER (PARTITION BY v ORDER BY vec_id)")).where(F.col("place") <= k + 1).select("vec_id", "v").distinct()
    base = cut(base)
    drawn = np.array([r[0] for r in base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()])
    parts = 8
    while parts < width and parts * rows_per_part < lengths["count"]:
        parts *= 2
    if len(drawn) < 16 * parts:
        parts = 1
    first = fit(drawn, parts, recall) if parts > 1 else None
    shared = spark.sparkContext.broadcast(Tree(first, {}))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = shared.value.parts(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    placed = cut(base.mapInArrow(home, "vec_id long, v array<double>, part int"))
    sizes = dict(placed.groupBy("part").count().collect())
    large = {}
    for p, n in sizes.items():
        inner = 2
        while inner < width and inner * rows_per_part < n:
            inner *= 2
        if first and n > 2 * rows_per_part and min(n, sample) >= 16 * inner:
            large[p] = inner
    second: dict[int, Router] = {}
    if large:
        by = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
        shares = spark.createDataFrame([(p, min(1.0, 2 * sample / sizes[p])) for p in large], "part int, share double")
        near = placed.join(F.broadcast(shares), "part").where(by < F.col("share") * (1 << 40)).withColumn("h", by)  # at most `width` rows
        ranked = near.withColumn("n", F.expr("row_number() OVER (PARTITION BY part ORDER BY h, vec_id)")).where(F.col("n") <= sample)
        found = ranked.select("part", "v").groupBy("part").applyInArrow(_fitter(large, recall), "part int, router binary").collect()
        second = {p: pickle.loads(r) for p, r in found}
    tree = spark.sparkContext.broadcast(Tree(first, second))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path = tree.value.home(_matrix(b.column("v")), np.array(b.column("part")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(path.astype(np.int32))], names=["vec_id", "v", "part"])

    if second:
        placed = cut(placed.mapInArrow(inside, "vec_id long, v array<double>, part int"))
        held = dict(placed.groupBy("part").count().collect())  # at most width ** 2 rows
    else:
        placed, held = placed.withColumn("part", F.col("part") * WIDTH), {p * WIDTH: n for p, n in sizes.items()}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x.astype(np.int32) for x in tree.value.visits(_matrix(b.column("v")), held, k)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "v", "parts"])

    asked = rows.where("asks").select("vec_id", "v").distinct().mapInArrow(visits, "query_id long, v array<double>, parts array<int>")
    asked = cut(asked.select("query_id", "v", F.explode("parts").alias("part")))
    asking = dict(asked.groupBy("part").count().collect())
    deal = spark.createDataFrame([(p, max(1, -(-n // block)), max(1, -(-asking.get(p, 0) // 2048))) for p, n in held.items()], "part int, n_base int, n_asked int")
    deal = F.broadcast(deal)  # a row for each of at most width ** 2 partitions
    left = placed.join(deal, "part").select("part", F.expr("pmod(xxhash64(vec_id), n_base)").cast("int").alias("b"), F.explode(F.expr("sequence(0, n_asked - 1)")).alias("q"), "vec_id", "v")
    right = asked.join(deal, "part").select("part", F.explode(F.expr("sequence(0, n_base - 1)")).alias("b"), F.expr("pmod(xxhash64(query_id), n_asked)").cast("int").alias("q"), "query_id", "v")
    found_kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            x, y = (np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (left, right))
            found = list(nearest(y, np.array(right.column("query_id")), x, np.array(left.column("vec_id")), k))
        return pa.Table.from_arrays([pa.array([f[i] for f in found], found_kind.field(i).type) for i in range(3)], schema=found_kind)

    cells = left.groupBy("part", "b", "q").cogroup(right.groupBy("part", "b", "q")).applyInArrow(rank, "query_id long, vec_id long, score double")
    best = cells.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
