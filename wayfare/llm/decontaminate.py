"""Benchmark decontamination: Wu-Manber search of item windows in documents, over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import common

HITS = "n_words long, hits array<struct<start: int, end: int>>, items array<long>"


class Patterns:
    """Word windows of one length. The search looks at the last block (two words, or one) of the position where a
    window could end. Its shift table says how far the search may jump; where that is 0, the bucket of that block (the
    suffix) and of the window's first word gives the windows that are compared word by word."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.buckets: dict = {}

    def add(self, window: tuple[bytes, ...], item: int | None) -> None:
        for end in range(self.block, self.length + 1):
            key = window[end - 2 : end] if self.block == 2 else window[end - 1]
            self.shift[key] = min(self.shift.get(key, self.length), self.length - end)
            if end == self.length:
                found = self.buckets.setdefault((key, window[0]), {}).setdefault(window, set())
                if item is not None:
                    found.add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of each occurrence, by start."""
        m, shift, buckets = self.length, self.shift.get, self.buckets
        most, i, n = m - self.block + 1, m - 1, len(words)
        while i < n:
            key = (words[i - 1], words[i]) if self.block == 2 else words[i]
            if jump := shift(key, most):
                i += jump
                continue
            if bucket := buckets.get((key, words[i - m + 1])):
                items = bucket.get(tuple(words[i - m + 1 : i + 1]))
                if items is not None:
                    yield i - m + 1, items
            i += 1


def windows(text: bytes | None, size: int) -> Iterator[tuple[bytes, ...]]:
    """size consecutive words; of a shorter text, all its words as one window; of a text without words, none."""
    found = common.words(text)
    for i in range(max(1, len(found) - size + 1) if found else 0):
        yield tuple(found[i : i + size])


def _blocks(rows: Iterable, size: int, most: int) -> Iterator[list[Patterns]]:
    by: dict[int, Patterns] = {}
    one: dict[bytes, bytes] = {}  # windows share their words
    n = 0
    for item, text in rows:
        for window in windows(text and text.encode(), size):
            window = tuple(one.setdefault(w, w) for w in window)
            by.setdefault(len(window), Patterns(len(window))).add(window, item)
            n += 1
            if n == most:
                yield list(by.values())
                by, one, n = {}, {}, 0
    if by:
        yield list(by.values())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _searcher(tables: Broadcast | None, kept: list[str], kind: pa.Schema, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.chunks(batches, "text"):
            n_words, hits, items = [], [], []
            before = [batch.column(k).to_pylist() for k in ("hits", "items")] if again else None
            for i, text in enumerate(texts):
                found = common.words(text)
                spans = [(x["start"], x["end"]) for x in before[0][i]] if before else []
                of = set(before[1][i]) if before else set()
                for patterns in tables.value if tables else ():
                    for start, ids in patterns.search(found):
                        spans.append((start, start + patterns.length))
                        of |= ids
                n_words.append(len(found))
                hits.append([{"start": a, "end": b} for a, b in _merged(spans)])
                items.append(sorted(of))
            new = [pa.array(x, kind.field(k).type) for k, x in (("n_words", n_words), ("hits", hits), ("items", items))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *new], schema=kind)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 100_000) -> DataFrame:
    """docs with the columns n_words, hits and items (replaced, if docs has them).

    hits are the merged word spans [start, end) inside an occurrence of a window; items the ids of the items with an
    occurring window. The windows are read as a stream and broadcast in blocks of at most block_windows (some 80 MB
    in each Python worker), whatever the size of the benchmark; each block is one pass over the documents, and a pass adds to what the one before it found.

    A null or empty text has no words and no hits. An item without words matches nothing; one with a null id marks
    words but isn't listed. Repeated rows of docs are judged each. All other columns of docs are kept; those of the
    benchmark besides item_id and text aren't read.
    """
    sc, out, again = docs.sparkSession.sparkContext, docs.withColumn("text", F.col("text").cast("string")), False
    kept, schema, kind = common.widened(out, HITS)
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()
    blocks = _blocks(rows, window, block_windows)
    block = next(blocks, None)
    while True:
        following = next(blocks, None)
        out = out.mapInArrow(_searcher(sc.broadcast(block) if block else None, kept, kind, again), schema)
        if following is None:
            return out
        out, block, again = common.cut(out), following, True
