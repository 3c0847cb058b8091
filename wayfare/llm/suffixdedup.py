"""Removal of byte strings that repeat across documents: blockwise sorting of sampled suffixes.

A suffix array of everything would hold a row for each byte. Here only a cover of the suffixes is sorted: those that start
at an anchor, a 16-byte string with the smallest hash among all that lie in some 50-byte string. Equal 50-byte strings
have their anchor at the same offset, so (as with a difference cover) two of them can be compared through a sampled
suffix at equal distance from both. The sampled suffixes are dealt into buckets by their first 16 bytes; one bucket at a
time is sorted, by the name of those bytes and then by the name of all that can matter around them. Only ties of the
first part whose surroundings differ are looked at again: in a second pass their surroundings are gathered, and
their 50-byte strings are sorted by the names of four 16-byte samples each, and those of one name compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import common

LENGTH, ANCHOR = 50, 16
LEFT = LENGTH - ANCHOR  # bytes before an anchor that a string with it can hold
SPAN = LEFT + LENGTH  # bytes around and after it
OFFSETS = LEFT + 1
ALL = np.uint64((1 << OFFSETS) - 1)
FLUSH = 8 << 20  # bytes of text of which a task packs the rows together
NULL = 2**63 - 1  # stands for a null doc_id, so that it comes last
PIECE = 1 << 18
_U = np.uint64
_BYTES = common.mix(np.arange(1, 257, dtype=np.uint64))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * _U(0x9E3779B97F4A7C15) + b
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
    return x


def names(data: np.ndarray) -> np.ndarray:
    """Hashes of the 16-byte strings that start at each place along the last axis."""
    h = _BYTES[data]
    for step in (1, 2, 4, 8):
        h = _pair(h[..., :-step], h[..., step:])
    return h ^ (h >> _U(29))


def _slide(x: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """f over each run of `width` items."""
    size, y = 1, x
    while 2 * size <= width:
        y = f(y[:-size], y[size:])
        size *= 2
    return f(y[: len(x) - width + 1], y[width - size : width - size + len(x) - width + 1])


class Anchors:
    """The anchors of some texts: their place, text, name, a key of name and surroundings, and bytes on either side."""

    def __init__(self, texts: list[bytes | None]):
        data, ends = common.joined(texts)
        self.data, self.ends = data, ends
        self.at = np.zeros(0, np.int64)
        if len(data) >= LENGTH:
            starts = np.arange(len(data) - LENGTH + 1)
            own = np.repeat(np.arange(len(texts)), np.diff(ends))
            whole = own[starts] == own[starts + LENGTH - 1]
            name = names(data)
            least = np.where(whole, _slide(name, OFFSETS, np.minimum), _U(0))
            edge = np.zeros(LEFT, np.uint64)
            best = _slide(np.concatenate([edge, least, edge]), OFFSETS, np.maximum)
            self.at = np.flatnonzero((best == name) & (best != 0))
            self.text = own[self.at]
            self.name = name[self.at]
            self.first = np.maximum(self.at - LEFT, ends[self.text])
            self.last = np.minimum(self.at + LENGTH, ends[self.text + 1])
            around = _pair((self.at - self.first).astype(np.uint64), (self.last - self.at).astype(np.uint64))
            for i in range(-(-SPAN // ANCHOR)):
                around = _pair(around, name[np.clip(self.at - LEFT + ANCHOR * i, self.first, self.last - ANCHOR)])
            around = common.mix(around) >> _U(16)
            self.low = self.name & _U((1 << 40) - 1)
            self.key = (around << _U(16)) | (self.low & _U(0xFFFF))

    def __len__(self) -> int:
        return len(self.at)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    for batch, texts in common.chunks(batches, "text", PIECE):
        yield np.array(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64), texts


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _cuts(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run."""
    if len(sorted_):
        edge = np.flatnonzero(np.diff(sorted_)) + 1
        for lo, hi in zip(np.r_[0, edge].tolist(), np.r_[edge, len(sorted_)].tolist(), strict=True):
            yield int(sorted_[lo]), lo, hi


def _parts(values: np.ndarray, n: int) -> np.ndarray:
    return (common.mix(values.view(np.uint64)) % _U(n)).astype(np.int64)


#: Binary columns hold packed arrays: the rows of a bucket or shard that one task had at hand.
PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
PACKED_SQL = "part int, kind int, a binary, b binary, c binary, d binary, e binary"
CHECK, FULL, MASKS, TEXTS = 0, 1, 2, 3  # marks sort before texts


def _emit_anchors(buckets: int, shards: int):
    """Of each anchor with its surroundings the smallest document among the texts at hand, for the buckets (a: doc_ids;
    b: index into a, u2 or u4 as kind says; c: low 40 bits of the name, u4 and u1 after it; d: 48 bits of the key, u4 and
    u2). The others' documents aren't the smallest, wherever that is: they are FULL marks at once, so that a passage which
    every document holds sends a bucket one row for each 8 MB of text."""

    def packed(docs: list[np.ndarray], low: list[np.ndarray], part: list[np.ndarray], key: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        docs_, low_, part_, key_ = map(np.concatenate, (docs, low, part, key))
        order = np.lexsort((docs_, key_, low_, part_))
        docs_, low_, part_, key_ = docs_[order], low_[order], part_[order], key_[order]
        first = np.r_[True, (np.diff(low_) != 0) | (np.diff(key_) != 0) | (np.diff(part_) != 0)]
        least = np.repeat(docs_[first], np.diff(np.r_[np.flatnonzero(first), len(docs_)]))
        fulls = _Marks(FULL, shards)
        fulls.add(docs_[docs_ > least], key_[docs_ > least])
        yield from fulls.rows()
        docs_, low_, part_, key_ = docs_[first], low_[first], part_[first], key_[first]
        out = []
        for p, lo, hi in _cuts(part_):
            ids, index = np.unique(docs_[lo:hi], return_inverse=True)
            index = index.astype(np.uint16 if len(ids) <= 65536 else np.uint32)
            around = key_[lo:hi] >> _U(16)
            c = low_[lo:hi].astype(np.uint32).tobytes() + (low_[lo:hi] >> _U(32)).astype(np.uint8).tobytes()
            d = around.astype(np.uint32).tobytes() + (around >> _U(32)).astype(np.uint16).tobytes()
            out.append((p, index.itemsize, ids.tobytes(), index.tobytes(), c, d, None))
        yield _rows(PACKED, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, texts in _pieces(batches):
            found = Anchors(texts)
            if len(found):
                docs = ids[found.text]
                # a document has each key once
                order = np.lexsort((found.key, docs))
                fresh = np.r_[True, (np.diff(docs[order]) != 0) | (np.diff(found.key[order]) != 0)]
                keep = order[fresh]
                held.append((docs[keep], found.low[keep], ((found.name[keep] >> _U(40)) % _U(buckets)).astype(np.int64), found.key[keep]))
            size += sum(len(x or b"") for x in texts)
            if size >= FLUSH and held:
                yield from packed(*zip(*held, strict=True))
                held, size = [], 0
        if held:
            yield from packed(*zip(*held, strict=True))

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each part; parts come one after another."""
    part, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                if held:
                    yield part, held
                part, held = row["part"], []
            held.append(row)
    if held:
        yield part, held


class _Marks:
    """Marks of several buckets, packed together as rows for the shards of the documents, so that their number follows
    the data and not the product of buckets and shards. a: doc_ids; b: keys; c: masks, if there are any."""

    def __init__(self, kind: int, shards: int):
        self.kind, self.shards, self.held, self.n = kind, shards, [], 0

    def add(self, docs: np.ndarray, keys: np.ndarray, masks: np.ndarray | None = None) -> None:
        if len(docs):
            self.held.append((docs, keys) if masks is None else (docs, keys, masks))
            self.n += len(docs)

    def rows(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        if self.n > most:
            packed = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            part = _parts(packed[0], self.shards)
            order = np.argsort(part, kind="stable")
            packed = [x[order] for x in packed]
            out = [(p, self.kind, *(x[lo:hi].tobytes() for x in packed), *[None] * (5 - len(packed))) for p, lo, hi in _cuts(part[order])]
            self.held, self.n = [], 0
            for i in range(0, len(out), 64):
                yield _rows(PACKED, out[i : i + 64])


def _sort_anchors(shards: int):
    """Of each bucket: anchors with surroundings that a smaller document has (FULL), and, where surroundings of the same
    anchor differ, the smallest document of each (CHECK)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fulls, checks = _Marks(FULL, shards), _Marks(CHECK, shards)
        for _, rows in _by_part(batches):
            docs, low, key = [], [], []
            if passed := [r for r in rows if r["kind"] == FULL]:
                yield _rows(PACKED, [tuple(r.values()) for r in passed])
            for r in rows:
                if r["kind"] == FULL:
                    continue
                index = np.frombuffer(r["b"], np.uint16 if r["kind"] == 2 else np.uint32)
                n = len(index)
                docs.append(np.frombuffer(r["a"], np.int64)[index])
                low.append(np.frombuffer(r["c"], np.uint32, n).astype(np.uint64) | (np.frombuffer(r["c"], np.uint8, n, 4 * n).astype(np.uint64) << _U(32)))
                around = np.frombuffer(r["d"], np.uint32, n).astype(np.uint64) | (np.frombuffer(r["d"], np.uint16, n, 4 * n).astype(np.uint64) << _U(32))
                key.append((around << _U(16)) | (low[-1] & _U(0xFFFF)))
            if not docs:
                continue
            docs, low, key = map(np.concatenate, (docs, low, key))
            order = np.lexsort((docs, key, low))
            docs, low, key = docs[order], low[order], key[order]
            new_low = np.r_[True, np.diff(low) != 0]
            new = new_low | np.r_[True, np.diff(key) != 0]
            firsts = np.flatnonzero(new)
            least = np.repeat(docs[firsts], np.diff(np.r_[firsts, len(docs)]))
            full = docs > least
            group = np.cumsum(new_low[firsts]) - 1
            heads = np.flatnonzero(new_low[firsts])
            lo, hi = np.minimum.reduceat(docs[firsts], heads), np.maximum.reduceat(docs[firsts], heads)
            check = firsts[(lo != hi)[group]]
            fulls.add(docs[full], key[full])
            checks.add(docs[check], key[check])
            yield from fulls.rows(FLUSH // 16)
            yield from checks.rows(FLUSH // 16)
        yield from fulls.rows()
        yield from checks.rows()

    return run


def _emit_texts(shards: int):
    """a: doc_ids; b: lengths (i8, -1 for null); c: the texts, compressed; d: their length."""

    def packed(ids: list[np.ndarray], texts: list[bytes | None]) -> pa.RecordBatch:
        docs = np.concatenate(ids)
        part = _parts(docs, shards)
        out = []
        order = np.argsort(part, kind="stable")
        for p, lo, hi in _cuts(part[order]):
            own = order[lo:hi]
            data = b"".join(texts[i] or b"" for i in own)
            sizes = np.array([-1 if texts[i] is None else len(texts[i]) for i in own], np.int64)
            out.append((p, TEXTS, docs[own].tobytes(), sizes.tobytes(), pa.compress(data, "zstd", asbytes=True), str(len(data)).encode(), None))
        return _rows(PACKED, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for some, data in _pieces(batches):
            ids.append(some)
            texts += data
            size += sum(len(x or b"") for x in data)
            if size >= FLUSH:
                yield packed(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield packed(ids, texts)

    return run


def _texts(row: dict) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    """The documents of a row, some at a time."""
    ids, sizes = np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.int64)
    data = pa.decompress(row["c"], int(row["d"]), "zstd", asbytes=True) if int(row["d"]) else b""
    ends = np.cumsum(np.maximum(sizes, 0))
    lo = 0
    while lo < len(ids):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        yield ids[lo:hi], [None if sizes[i] < 0 else data[ends[i] - sizes[i] : ends[i]] for i in range(lo, hi)]
        lo = hi


class _Marked:
    """Masks by (doc_id, key)."""

    def __init__(self, docs: list[np.ndarray], keys: list[np.ndarray], masks: list[np.ndarray]):
        self.docs, self.keys, self.masks = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((docs, np.int64), (keys, np.uint64), (masks, np.uint64)))
        mixed = self.mixed(self.docs, self.keys)
        order = np.argsort(mixed, kind="stable")
        self.by, self.docs, self.keys, self.masks = (x[order] for x in (mixed, self.docs, self.keys, self.masks))

    @staticmethod
    def mixed(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return _pair(common.mix(docs.view(np.uint64)), keys)

    def of(self, docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """All masks of each (doc_id, key) together; others that mix to the same number don't count."""
        out = np.zeros(len(docs), np.uint64)
        if not len(self.by):
            return out
        mixed = self.mixed(docs, keys)
        at, rest = np.searchsorted(self.by, mixed), np.arange(len(docs))
        while len(rest := rest[(at[rest] < len(self.by))]):
            rest = rest[self.by[at[rest]] == mixed[rest]]
            own = rest[(self.docs[at[rest]] == docs[rest]) & (self.keys[at[rest]] == keys[rest])]
            out[own] |= self.masks[at[own]]
            at[rest] += 1
        return out


def _shards(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]) -> Iterator[tuple[_Marked, dict]]:
    """Each row of texts, with the marks of its shard, which come before it."""
    part, held, marked = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                part, held, marked = row["part"], [], None
            if row["kind"] in kinds:
                held.append(row)
            elif row["kind"] == TEXTS:
                if marked is None:
                    docs = [np.frombuffer(r["a"], np.int64) for r in held]
                    keys = [np.frombuffer(r["b"], np.uint64) for r in held]
                    masks = [np.frombuffer(r["c"], np.uint64) if r["kind"] == MASKS else np.full(len(k), ALL) for r, k in zip(held, keys, strict=True)]
                    marked, held = _Marked(docs, keys, masks), []
                yield marked, row


def _emit_around(buckets: int):
    """The surroundings of anchors to check. a: doc_ids; b: names; c: keys; d: bytes before and after (u1, u1); e: the
    surroundings, padded, compressed."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        docs, name, key, sides, around = (np.concatenate(x) for x in zip(*rows, strict=True))
        part = ((name >> _U(40)) % _U(buckets)).astype(np.int64)
        order = np.lexsort((name, part))
        out = []
        for p, lo, hi in _cuts(part[order]):
            own = order[lo:hi]
            out.append((p, CHECK, docs[own].tobytes(), name[own].tobytes(), key[own].tobytes(), sides[own].tobytes(), pa.compress(around[own].tobytes(), "zstd", asbytes=True)))
        return _rows(PACKED, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for marked, row in _shards(batches, (CHECK,)):
            if not len(marked.by):
                continue
            for ids, texts in _texts(row):
                found = Anchors(texts)
                if not len(found):
                    continue
                docs = ids[found.text]
                own = np.flatnonzero(marked.of(docs, found.key))
                order = own[np.lexsort((found.key[own], docs[own]))]
                if not len(order):
                    continue
                fresh = np.r_[True, (np.diff(docs[order]) != 0) | (np.diff(found.key[order]) != 0)]
                own = order[fresh]
                at = found.at[own][:, None] - LEFT + np.arange(SPAN)
                inside = (at >= found.first[own][:, None]) & (at < found.last[own][:, None])
                around = np.where(inside, found.data[np.clip(at, 0, len(found.data) - 1)], 0).astype(np.uint8)
                sides = np.stack([found.at[own] - found.first[own], found.last[own] - found.at[own]], 1).astype(np.uint8)
                held.append((docs[own], found.name[own], found.key[own], sides, around))
                size += around.size
                if size >= FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


def _repeats(strings: np.ndarray, told: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the same string (a row of bytes, with the name told) is in a smaller document, too."""
    out, rest = [], np.lexsort((docs, told))
    while len(rest):
        firsts = np.flatnonzero(np.r_[True, np.diff(told[rest]) != 0])
        heads = np.repeat(rest[firsts], np.diff(np.r_[firsts, len(rest)]))
        same = np.concatenate([(strings[rest[lo : lo + 65536]] == strings[heads[lo : lo + 65536]]).all(1) for lo in range(0, len(rest), 65536)])
        out.append(rest[same & (docs[rest] > docs[heads])])
        rest = rest[~same]  # other strings of the same name
    return np.concatenate(out) if out else rest


def _sort_around(shards: int):
    """Of each bucket: which of the 50-byte strings around an anchor a smaller document has, too, as masks of offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(MASKS, shards)
        for _, rows in _by_part(batches):
            docs = np.concatenate([np.frombuffer(r["a"], np.int64) for r in rows])
            name = np.concatenate([np.frombuffer(r["b"], np.uint64) for r in rows])
            key = np.concatenate([np.frombuffer(r["c"], np.uint64) for r in rows])
            sides = np.concatenate([np.frombuffer(r["d"], np.uint8) for r in rows]).reshape(-1, 2).astype(np.int64)
            around = np.frombuffer(b"".join(pa.decompress(r["e"], SPAN * (len(r["a"]) // 8), "zstd", asbytes=True) for r in rows), np.uint8).reshape(-1, SPAN)
            masks = np.zeros(len(docs), np.uint64)
            samples = np.concatenate([names(around[lo : lo + 8192]) for lo in range(0, len(docs), 8192)])
            for o in range(OFFSETS):
                whole = np.flatnonzero((o >= LEFT - sides[:, 0]) & (o + LENGTH <= LEFT + sides[:, 1]))
                if not len(whole):
                    continue
                told = name[whole]
                for s in (o, o + ANCHOR, o + 2 * ANCHOR, o + LENGTH - ANCHOR):
                    told = _pair(told, samples[whole, s])
                masks[whole[_repeats(around[whole, o : o + LENGTH], told, docs[whole])]] |= _U(1 << o)
            kept = np.flatnonzero(masks)
            marks.add(docs[kept], key[kept], masks[kept])
            yield from marks.rows(FLUSH // 16)
        yield from marks.rows()

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    offsets = np.arange(OFFSETS)
    for marked, row in _shards(batches, (FULL, MASKS)):
        for ids, texts in _texts(row):
            gone = np.zeros(sum(len(x or b"") for x in texts), bool)
            ends = np.r_[0, np.cumsum([len(x or b"") for x in texts])]
            if len(marked.by) and len(found := Anchors(texts)):
                masks = marked.of(ids[found.text], found.key)
                own = np.flatnonzero(masks)
                steps = np.zeros(len(gone) + 1, np.int32)
                for o in offsets:
                    start = found.at[own] - LEFT + o
                    start = start[((masks[own] >> _U(o)) & _U(1)).astype(bool) & (start >= found.first[own]) & (start + LENGTH <= found.last[own])]
                    np.add.at(steps, start, 1)
                    np.add.at(steps, start + LENGTH, -1)
                gone = np.cumsum(steps[:-1]) > 0
            out = []
            for i, text in enumerate(texts):
                own = gone[ends[i] : ends[i + 1]]
                n = int(own.sum())
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if n else 0
                kept = np.frombuffer(text, np.uint8)[~own].tobytes() if n else text or b""
                out.append((int(ids[i]), len(own), n, spans, kept))
            yield _rows(RESULT, out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs: kept are the UTF-8 bytes of the text less each
    byte that is covered by a 50-byte string which also starts in a document of smaller doc_id, judged on the input.

    Sampled suffixes, surroundings and texts are moved as packed arrays, a row for each bucket or shard and 8 MB of
    text; a bucket or shard is worked on alone, so that a task holds one of several hundred parts of the corpus. Copies
    need no comparison beyond the smallest one's: a byte string that thousands of documents hold is one name with one
    smallest document in each 8 MB of text. An anchor with all its surroundings has a name of 88 bits (at 10^12 anchors
    one false pair is expected about once in 600 such corpora); strings of anchors whose surroundings differ are compared
    byte by byte, and marks meet documents by doc_id and key, not by their hash alone.

    Null and empty texts, and those under 50 bytes, lose nothing; kept is then the text, empty for null. Repeats within
    a document, and between rows of the same doc_id, don't count. Other columns aren't read. Rows with a null doc_id count
    as one document after all others (the doc_id 2 ** 63 - 1 among them) and are returned with null.
    """
    n = common.tasks(docs.sparkSession)
    buckets = 4 * n
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def by_part(df: DataFrame) -> DataFrame:
        """Dealt by the part itself, so that each of the n tasks has as many parts as the others."""
        return df.repartitionById(n, "part").sortWithinPartitions("part", "kind")

    texts = rows.mapInArrow(_emit_texts(n), PACKED_SQL)
    marks = common.cut(by_part(rows.mapInArrow(_emit_anchors(buckets, n), PACKED_SQL)).mapInArrow(_sort_anchors(n), PACKED_SQL))
    around = by_part(marks.where(f"kind = {CHECK}").unionByName(texts)).mapInArrow(_emit_around(buckets), PACKED_SQL)
    masks = by_part(around).mapInArrow(_sort_around(n), PACKED_SQL)
    final = by_part(marks.where(f"kind = {FULL}").unionByName(masks).unionByName(texts))
    out = final.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL, F.col("doc_id")))
