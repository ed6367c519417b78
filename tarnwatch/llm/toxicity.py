"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts. The ordinary one holds common words of
ordinary texts; the toxic one holds these and the strings that mark toxic texts: runs of byte grams
that stand in many different contexts there and in hardly any of the ordinary texts. Counting
contexts instead of texts keeps copied passages out. A text is cut into overlapping windows, each
compressed with either dictionary; the bytes saved by the toxic one are the evidence. A logistic
curve fitted on further labelled texts turns it into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, and between the starts of two windows.
WINDOW, STEP = 96, 72
#: Shortest match of the compressor and length of the marking grams, so that every match in the
#: toxic part of a dictionary is a marking gram.
GRAM = 5
#: Bound of the labelled sample: texts per class.
SAMPLE = {1: 1200, 0: 2400}
#: A marking gram stands in so many different contexts, and is so many times commoner in toxic texts.
CONTEXTS, CONTRAST = 6, 25.0
#: Words of the ordinary dictionary, and bytes of either part of a dictionary.
COMMON_WORDS, PART_BYTES = 3000, 12000
#: Bytes saved in one window that count as a hit.
HIT = 2


def held_out() -> Column:
    """Rows whose crc32 of the id's text leaves 2 when divided by 4 are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes of all texts, once per distinct context (the gram and six bytes before it)."""
    raw = np.frombuffer(b"".join(b"\0" * 6 + b" " + t.lower() + b" " for t in texts), np.uint8)
    gram = np.zeros(len(raw) - 6 - GRAM + 1, np.uint64)
    before = np.zeros(len(gram), np.uint64)
    # in place and freed early: these arrays take eight times the texts' bytes each
    for i in range(GRAM):
        gram <<= np.uint64(8)
        gram |= raw[6 + i:6 + i + len(gram)]
    for i in range(6):
        before <<= np.uint64(8)
        before |= raw[i:i + len(gram)]
    inside = (raw[6:6 + len(gram)] != 0) & (raw[6 + GRAM - 1:6 + GRAM - 1 + len(gram)] != 0)
    gram, before = gram[inside], before[inside]
    with np.errstate(over="ignore"):
        before ^= gram * np.uint64(0x9E3779B97F4A7C15)
        before *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(before, kind="stable")
    before = before[order]
    first = order[np.append(True, before[1:] != before[:-1])[:len(order)]]
    del before, order
    return np.unique(gram[first], return_counts=True)


def _fill(pieces: list[bytes], budget: int) -> bytes:
    """Pieces apart by a zero byte, the most useful last, where offsets are short."""
    held = b""
    for piece in pieces:
        if piece not in held:
            held = piece + b"\0" + held
        if len(held) > budget:
            break
    return held


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary."""
    words: Counter[bytes] = Counter()
    for text in ordinary:
        words.update(set(text.lower().split()))
    common = _fill([b" " + w + b" " for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS]], PART_BYTES)
    if not toxic:
        return common, common
    codes, counts = _grams(toxic)
    codes, counts = codes[counts >= CONTEXTS], counts[counts >= CONTEXTS]
    other_codes, other = _grams(ordinary) if ordinary else (codes[:0], counts[:0])
    place = np.minimum(np.searchsorted(other_codes, codes), max(0, len(other_codes) - 1))
    rivals = np.where(other_codes[place] == codes, other[place], 0) if len(other_codes) else np.zeros(len(codes))
    sizes = [max(1, sum(map(len, texts))) for texts in (toxic, ordinary)]
    marking = (counts / sizes[0]) / ((rivals + 0.5) / sizes[1]) > CONTRAST
    marks = {int(c).to_bytes(GRAM, "big"): int(k) for c, k in zip(codes[marking], counts[marking])}
    runs: Counter[bytes] = Counter()
    for text in toxic:
        found, text, at = set(), b" " + text.lower() + b" ", 0
        while at <= len(text) - GRAM:
            if text[at:at + GRAM] not in marks:
                at += 1
                continue
            end = at
            while text[end + 1:end + 1 + GRAM] in marks:
                end += 1
            # grams much rarer than the run's core belong to the neighbouring words
            weights = [marks[text[i:i + GRAM]] for i in range(at, end + 1)]
            core = [i for i, w in enumerate(weights, at) if w >= 0.3 * max(weights)]
            found.add(text[core[0]:core[-1] + GRAM])
            at = end + 1
        runs.update(found)
    marked = [r for r, k in sorted(runs.items(), key=lambda x: (-x[1], x[0])) if k >= 3]
    return common + _fill(marked, PART_BYTES), common


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per fold left out (-1: none) with both dictionaries; holds the bounded sample."""
    rows: list[tuple[int, int, bytes]] = []
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows += [(fold, toxic, text or b"") for fold, toxic, text in zip(batch.column("fold").to_pylist(), batch.column("toxic").to_pylist(), texts)]
    rows.sort()
    for out in (-1, 0, 1):
        made = train_dictionaries(*([t for fold, toxic, t in rows if toxic == label and fold != out] for label in (1, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.int32()), *(pa.array([m], pa.binary()) for m in made)], ["fold", "toxic", "ordinary"])


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstd.ZstdCompressor:
    parameters = zstd.ZstdCompressionParameters.from_level(
        5, min_match=GRAM, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstd.ZstdCompressor(
        dict_data=zstd.ZstdCompressionDict(content or b" ", dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=parameters)


def _sizes(content: bytes, windows: list[bytes]) -> np.ndarray:
    made = _compressor(content).multi_compress_to_buffer(windows, threads=0)
    return np.fromiter((len(made[i]) for i in range(len(made))), np.int64, len(made))


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows over a whole text; an empty text has one blank window."""
    padded = b" " + text.lower() + b" "
    return [padded[i:i + WINDOW] for i in range(0, max(1, len(padded) - (WINDOW - STEP)), STEP)]


def saved(texts: list[bytes], dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """Evidence of each text: most bytes saved in a window, hits, bytes saved by hits, windows."""
    out, held, owner = np.zeros((len(texts), 4)), [], []

    def flush() -> None:
        gain = _sizes(dictionaries[1], held) - _sizes(dictionaries[0], held)
        at = np.array(owner)
        np.maximum.at(out[:, 0], at, gain)
        np.add.at(out[:, 1], at, gain >= HIT)
        np.add.at(out[:, 2], at, np.where(gain >= HIT, gain, 0))
        np.add.at(out[:, 3], at, 1)
        held.clear()
        owner.clear()

    for number, text in enumerate(texts):
        for window in windows(text):
            held.append(window)
            owner.append(number)
            if len(held) == 4096:
                flush()
    if held:
        flush()
    return out


def _features(evidence: np.ndarray) -> np.ndarray:
    best, hits, total, count = evidence.T
    best = np.minimum(best, 8)
    return np.stack([np.ones_like(best), best, best**2 / 8, np.log1p(hits), np.log1p(total), np.log(count)], axis=1)


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, weights: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps."""
    x = _features(evidence)
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-3] * (x.shape[1] - 1)) * max(1.0, weights.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weights * (toxic - p)) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def probability(evidence: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(evidence) @ beta, -30, 30)))


def _evidence(dictionaries: dict[int, tuple[bytes, bytes]]):
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], batch.column("fold").to_pylist()
            found = [saved([text], dictionaries[fold])[0].tolist() for text, fold in zip(texts, folds)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "evidence"])

    return evidence


def learn(documents: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> tuple[tuple[bytes, bytes], np.ndarray]:
    """Dictionaries and curve from labelled rows that are not held out.

    Per class, at most ``sample`` texts are picked by hash of their id, in two folds. The curve is
    fitted on each fold's evidence under dictionaries trained on the other fold; the dictionaries
    returned are trained on both. Classes are weighed back to their share of all usable labels.
    Labels with a null id or value are left out, of several labels of a document the higher counts.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [
        usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        for label, bound in sample.items()
    ]
    ids = picked[0].unionByName(picked[1]).toArrow().to_pylist()
    own = {label: sorted(r["doc_id"] for r in ids if r["toxic"] == label) for label in sample}
    folds = [(doc_id, label, i % 2) for label, numbers in own.items() for i, doc_id in enumerate(numbers)]
    chosen = documents.sparkSession.createDataFrame(folds, "_id long, toxic int, fold int")
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic", "fold")
    made = rows.repartition(1).mapInArrow(_train, "fold int, toxic binary, ordinary binary").collect()
    dictionaries = {r["fold"]: (bytes(r["toxic"]), bytes(r["ordinary"])) for r in made}
    fitted = rows.mapInArrow(_evidence(dictionaries), "toxic int, evidence array<double>").toArrow()
    toxic = np.array(fitted["toxic"].to_pylist(), float)
    if not len(toxic):
        return (b"", b""), np.array([-3.0, 0, 0, 0, 0, 0])
    evidence = np.array(fitted["evidence"].to_pylist())
    per_class = {label: totals.get(label, 0) / max(1, int((toxic == label).sum())) for label in sample}
    weights = np.where(toxic == 1, per_class[1], per_class[0])
    return dictionaries[-1], fit_curve(evidence, toxic, weights / weights.mean())


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, windows, hits``.

    Only the text decides the score. Defined cases: null or empty text is one blank window; rows
    repeating a ``doc_id`` are scored separately; without usable labels nothing is toxic; an empty
    table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionaries, beta = learn(rows, labels, sample)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = saved([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], dictionaries)
            chance = probability(found, beta)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(chance), pa.array((chance >= threshold).astype(np.int32)),
                 pa.array(found[:, 3].astype(np.int64)), pa.array(found[:, 1].astype(np.int64))],
                ["doc_id", "held_out", "score", "predicted", "windows", "hits"])

    return rows.withColumn("held_out", held_out()).mapInArrow(
        scores, "doc_id long, held_out boolean, score double, predicted int, windows long, hits long")


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """The rows of ``documents``, all columns, that :func:`score` does not predict as toxic.

    Labels decide what is learned, never whether a row stays.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionaries, beta = learn(rows, labels, sample)
    place = documents.columns.index("text")

    def stays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).cast(pa.binary()).to_pylist()
            chance = probability(saved([t or b"" for t in texts], dictionaries), beta)
            yield batch.filter(pa.array(chance < threshold))

    return documents.mapInArrow(stays, documents.schema)
