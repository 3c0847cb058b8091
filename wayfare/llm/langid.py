"""Language ID by multilingual mixture inference: EM over n-gram likelihoods, the set of languages by penalised likelihood."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import common

CELLS = 1 << 15  # hashed byte trigrams
SEGMENT = 64  # bytes whose language is one draw from the document's mixture
ROUNDS = 15  # of EM
HELD = 32  # languages whose counts a task sums up at a time
SLICE = 1 << 22  # numbers that a step on one long text works on at a time
#: Overlapping trigrams tell the same bytes three times over.
TEMPER = 1 / 3
#: Letters and other non-ASCII bytes stay, A-Z lowered; all else is a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # CELLS x languages, float32


def cells(data: np.ndarray) -> np.ndarray:
    """The hashed trigram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    with np.errstate(over="ignore"):
        return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)


BLANK = int(cells(np.frombuffer(b"   ", np.uint8))[0])


def _padded(text: bytes | None) -> bytes:
    return b" " + (text or b"").translate(LETTERS) + b" "


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n) of the rows (lang, text): partial sums."""
    sums: dict[str, np.ndarray] = {}

    def summed() -> Iterator[pa.RecordBatch]:
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])], names=["lang", "cell", "n"])
        sums.clear()

    for batch, texts in common.chunks(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            if lang not in sums and len(sums) == HELD:
                yield from summed()
            found = cells(np.frombuffer(_padded(text), np.uint8)) if text else np.zeros(0, np.int64)
            own = np.bincount(found, minlength=CELLS).astype(np.int64)
            own[BLANK] += not own.any()  # a language of empty texts is learned, too; the cell isn't used
            sums[lang] = sums[lang] + own if lang in sums else own
    yield from summed()


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_language: int = 2000) -> Model:
    """Trigram counts of each language over at most per_language of its training rows: labelled, and not held out. The
    rows are those with the smallest hash of doc_id, then the smallest doc_id; of repeated ids all rows count. Rows that
    by the language's count can't be among them go first, so that a common language isn't ranked as a whole. The sums by
    language and cell are made on the executors. The driver holds one row for each language and 128 KB of sums, however
    many languages or rows there are. A row of null text counts nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").count().collect()
    # twice the share that is asked for: it holds per_language rows but for one chance in 10^100
    shares = spark.createDataFrame([(lang, min(1.0, 2 * per_language / n)) for lang, n in counts], "lang string, share double")
    by = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = rows.join(F.broadcast(shares), "lang").where(by < F.col("share") * (1 << 40))  # a row for each language
    ranked = near.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang ORDER BY pmod(xxhash64(doc_id), {1 << 40}), doc_id)"))
    chosen = ranked.where(F.col("rank") <= per_language).select("lang", "doc_id").distinct()
    chosen = F.broadcast(chosen) if per_language * len(counts) <= 1_000_000 else chosen
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = train.join(chosen, ["lang", "doc_id"], "left_semi").select("lang", "text").mapInArrow(_counter, "lang string, cell int, n long")
    sums: dict[str, np.ndarray] = {}
    for lang, at, n in parts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("cell"), F.collect_list("n")).collect():
        sums[lang] = np.zeros(CELLS, np.int64)
        sums[lang][at] = n
    languages = sorted(sums)
    logs = np.zeros((CELLS, len(languages)), np.float32)
    for i, lang in enumerate(languages):
        own = sums[lang]
        own[BLANK] = 0
        logs[:, i] = np.log((own + 0.5) / (own.sum() + 0.5 * CELLS))
    logs[BLANK] = 0
    return Model(languages, logs * np.float32(TEMPER))


def _slices(n: int, width: int) -> Iterator[slice]:
    step = max(1, SLICE // max(1, width))
    return (slice(lo, min(n, lo + step)) for lo in range(0, n, step))


def _em(score: np.ndarray, owner: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of each document; score: segments x languages, those of a document in a row; allowed:
    documents x languages. Works on some of the segments at a time."""
    shares = allowed / allowed.sum(1, keepdims=True)

    def over(f: Callable, out: np.ndarray) -> np.ndarray:
        for s in _slices(*score.shape):
            own = owner[s]
            top = np.where(allowed[own], score[s], -np.inf).max(1, keepdims=True)
            part = shares[own] * np.exp(np.minimum(score[s] - top, 0).astype(np.float64))
            starts = np.flatnonzero(np.r_[True, np.diff(own) != 0])
            out[own[starts]] += np.add.reduceat(f(part, top), starts, axis=0)
        return out

    for _ in range(ROUNDS):
        shares = over(lambda part, _: part / np.maximum(part.sum(1, keepdims=True), 1e-300), np.zeros(shares.shape)) / n[:, None]
    return shares, over(lambda part, top: np.log(np.maximum(part.sum(1), 1e-300)) + top[:, 0], np.zeros(len(n)))


def scores(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log-likelihood of each segment under each language, the text it is of, and the segments of each text."""
    data, ends = common.joined([_padded(x) for x in texts])
    n = np.maximum(1, -(-(np.diff(ends) - 2) // SEGMENT))
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(texts)), n)
    first = ends[owner] + (np.arange(len(owner)) - starts[owner]) * SEGMENT
    code = cells(data)
    cross = ends[1:-1]
    code[cross - 2], code[cross - 1] = BLANK, BLANK  # trigrams that run over from one text into the next tell nothing
    edge = np.r_[first, len(code)]
    score = np.empty((len(owner), len(model.languages)), np.float32)
    for s in _slices(len(owner), SEGMENT * len(model.languages)):
        score[s] = np.add.reduceat(model.logs[code[edge[s.start] : edge[s.stop]]], edge[s] - edge[s.start], axis=0)
    return score, owner, n


def infer(model: Model, texts: list[bytes | None], most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the order of its languages by share, their shares, 0 outside the chosen set, and the log-likelihood
    of the set."""
    score, owner, n = scores(model, texts)
    languages = len(model.languages)
    shares, _ = _em(score, owner, n, np.ones((len(texts), languages), bool))
    order = np.argsort(-shares, axis=1, kind="stable")
    upper = np.zeros(len(texts))  # no set of languages explains a segment better than its best one
    np.add.at(upper, owner, score.max(1).astype(np.float64))
    best, chosen = np.full(len(texts), -np.inf), np.zeros_like(shares)
    penalty = np.log(n + 1) + 4
    for k in range(1, min(most or languages, languages) + 1):
        open_ = np.flatnonzero(upper - (k - 1) * penalty > best)
        if not len(open_):
            break
        allowed = np.zeros((len(open_), languages), bool)
        allowed[np.arange(len(open_))[:, None], order[open_, :k]] = True
        own = np.isin(owner, open_) if len(open_) < len(n) else slice(None)
        of, like = _em(score[own], np.repeat(np.arange(len(open_)), n[open_]), n[open_], allowed)
        like = like - (k - 1) * penalty[open_]
        better = like > best[open_]
        best[open_[better]], chosen[open_[better]] = like[better], of[better]
    return np.argsort(-chosen, axis=1, kind="stable"), chosen, best


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    kept = text.translate(LETTERS)
    return not kept.isspace() and (not kept.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))) or any(97 <= b <= 122 for b in kept[:64]) or any(97 <= b <= 122 for b in set(kept)))


FOUND = "lang_pred string, score double, languages array<struct<lang: string, share: double>>, gain double"


def identify(docs: DataFrame, model: Model, most: int | None = None) -> DataFrame:
    """docs with the columns lang_pred, score, languages and gain (replaced, if docs has them in any case of letters),
    from the whole text alone.

    A document is cut into segments of 64 bytes, each written in one language of the document's mixture. EM gives the
    shares of all languages; then the k most used ones, for k from 1 to `most` (by default to as many as were learned, or
    until no further language could pay its penalty), are fitted again, and the k with the largest log-likelihood less a
    penalty for each further language is taken. languages are the (lang, share) of that set,
    largest first; lang_pred is the first of them and score its share. gain is the log-likelihood of the set, less that
    of letters drawn without any language, by segment: below 0, no learned language explains the text. A text that is null
    or has no letter gets `und` with score and gain 0 and no languages; if no language was learned, every text does.
    Repeated rows are judged each. A long text is worked on in slices; what is held of it are a sixteenth of its bytes for
    each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 128 KB for each language
    docs = docs.withColumn("text", F.col("text").cast("string"))
    kept, schema, kind = common.widened(docs, FOUND)
    level = -np.log(CELLS) * TEMPER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in common.chunks(batches, "text", 1 << 18):
            there = [bool(model.languages) and has_letter(x) for x in texts]
            pred, score, sets, gain = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts], [0.0] * len(texts)
            if at := [i for i, x in enumerate(there) if x]:
                own = [texts[i] for i in at]
                for i, o, s, like, text in zip(at, *infer(model, own, most), own, strict=True):
                    sets[i] = [{"lang": model.languages[j], "share": min(1.0, float(s[j]))} for j in o.tolist() if s[j] > 0]
                    pred[i], score[i] = sets[i][0]["lang"], sets[i][0]["share"]
                    code = cells(np.frombuffer(_padded(text), np.uint8))
                    gain[i] = float(like - level * (code != BLANK).sum()) / max(1, -(-len(text) // SEGMENT))
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind.field("languages").type), pa.array(gain, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], schema=kind)

    return docs.mapInArrow(run, schema)
