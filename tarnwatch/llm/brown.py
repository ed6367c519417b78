"""Brown class n-grams: exchange clustering and smoothed class-bigram scores.

A token's probability is P(class | class before) * P(token | class). All words with a training count
are put into classes by the exchange algorithm: counts of the classes before and after every word are
summed over the whole corpus in Spark, then words move to the class that raises the class-bigram
likelihood, half of the words in each round so that neighbours don't swap in step (after Martin et
al. 1998 and Uszkoreit & Brants 2008). The end of a text is a class of its own, another is for words
without a training count.

The most frequent words (the head, of fixed size) and their counts are arrays on the driver. All other
words (the tail) move by the same rule in the executors: their neighbours, counts and classes are
tables keyed by word, and only tables of classes x classes are sent to the tasks.

Counts are exact for every word: the head's are sent to all tasks, all others are found by a join.
The tail is clustered by 64-bit hashes of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.scratch import discard
from tarnwatch.session import stage

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words kept as arrays instead of table rows, and the classes of all words.
HEAD, CLASSES = 1 << 15, 32
#: Rounds of exchange.
ROUNDS = 4
#: Distinct words a counting task holds before it sends them on.
HELD_WORDS = 200_000
#: Neighbours of tail words a task holds before it sends them on.
HELD_NEIGHBOURS = 1 << 20
#: Weight of the class distribution in smoothed transitions.
SMOOTHING = 10.0


def held_out() -> Column:
    """Rows whose crc32 of the id's text leaves 2 when divided by 7 are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ``[\\x20\\x09-\\x0D]``."""
    return (text or b"").translate(LOWER).split()


def word_key(word: bytes) -> int:
    """Spark's ``xxhash64`` of a word."""
    return xxhash.xxh64_intdigest(word, seed=42)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            held.update(words_of(text.as_py()))
            if len(held) > HELD_WORDS:
                yield send()
    yield send()


@dataclass
class Head:
    """The most frequent words by rank; then the index of the tail's words and of the end."""

    index: dict[bytes, int]

    def __post_init__(self) -> None:
        self.size = len(self.index)
        self.rare, self.end = self.size, self.size + 1


ENCODED = "row long, doc_id long, held_out boolean, ids array<int>, rare array<binary>"


def _encode(head):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, rare_id, end = head.value.index, head.value.rare, head.value.end
        serial = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, rare = [], []
                for text in part.column("text"):
                    words = words_of(text.as_py())
                    own = [index.get(w, rare_id) for w in words]
                    rare.append([w for w, i in zip(words, own) if i == rare_id])
                    own.append(end)
                    ids.append(np.array(own, np.int32))
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(serial, serial + part.num_rows)), part.column("doc_id"), part.column("held_out"),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array(rare, pa.list_(pa.binary()))],
                    ["row", "doc_id", "held_out", "ids", "rare"])
                serial += part.num_rows

    return encode


def _sequences(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of a batch, those before them (the end opens a text), and row offsets."""
    lists = batch.column("ids")
    offsets = lists.offsets.to_numpy()
    ids = lists.values.to_numpy()[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[offsets[:-1]] = end
    return ids, before, offsets


def _tail_keys(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of a batch's tail words, in the order of their tokens."""
    words = batch.column("rare").flatten()
    return np.fromiter((word_key(w.as_py()) for w in words), np.uint64, len(words)).view(np.int64)


NEIGHBOURS = "word long, codes array<int>, ns array<int>, other long, n long"


def _runs(keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of the keys, and how many times each occurs."""
    order = np.lexsort((others, keys))
    keys, others = keys[order], others[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])))
    return keys[first], others[first], np.diff(np.append(first, len(keys)))


def _neighbours(size: int):
    """Neighbours of tail words: codes of the head's words and of the end (with ``size`` + 2 added
    for those that follow), or the tail word that follows."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, end, total = size, size + 1, size + 2
        near, pairs, held = [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            if near:
                keys, codes, ns = _runs(*map(np.concatenate, zip(*near)))
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
                none = pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first]), pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(ns.astype(np.int32))), none, none], ["word", "codes", "ns", "other", "n"])
            if pairs:
                keys, others, ns = _runs(*map(np.concatenate, zip(*pairs)))
                none = pa.nulls(len(keys), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys), none, none, pa.array(others), pa.array(ns.astype(np.int64))], ["word", "codes", "ns", "other", "n"])
            near.clear()
            pairs.clear()

        for batch in batches:
            ids, before, _ = _sequences(batch, end)
            at = np.flatnonzero(ids == rare)
            if not len(at):
                continue
            keys = np.zeros(len(ids), np.int64)
            keys[at] = _tail_keys(batch)
            # the end closes every text, so a tail word always has a token behind it
            for there, shift in ((before[at], 0), (ids[at + 1], total)):
                known = there != rare
                if known.any():
                    near.append((keys[at[known]], there[known] + shift))
            second = at[before[at] == rare]
            if len(second):
                pairs.append((keys[second - 1], keys[second]))
            held += 2 * len(at)
            if held > HELD_NEIGHBOURS:
                yield from send()
                held = 0
        yield from send()

    return neighbours


BLOCK = 1 << 10
CONTEXTS = "word long, class int, codes array<int>, ns array<long>, block int, salt int, counts binary"


def _blocks(held: np.ndarray, width: int) -> list[pa.Array]:
    """Columns ``block, salt, counts`` of a task's counts, in blocks of tokens."""
    from pyspark import TaskContext

    parts = held.reshape(2, -1, BLOCK * width)
    rows = [(i, parts[:, i].astype(np.uint32).tobytes()) for i in range(parts.shape[1]) if parts[:, i].any()]
    salt = TaskContext.get().partitionId() % 256
    return [pa.array([r[0] for r in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())]


def _table(total: int, width: int) -> np.ndarray:
    """Empty counts before and after each token of the head, and the tail's words by their class."""
    return np.zeros((2, -(-(total + width) // BLOCK) * BLOCK * width), np.int64)


def _contexts(classes, width: int):
    """Counts of classes before and after each token where neither is of the tail."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classes.value
        size = len(own)
        held = _table(size, width)
        for batch in batches:
            ids, before, _ = _sequences(batch, size - 1)
            kept = (ids != size - 2) & (before != size - 2)
            ids, before = ids[kept], before[kept]
            if len(ids):
                for side, code in enumerate((ids.astype(np.int64) * width + own[before], before.astype(np.int64) * width + own[ids])):
                    seen, n = np.unique(code, return_counts=True)
                    held[side][seen] += n
        yield pa.RecordBatch.from_arrays(_blocks(held, width), ["block", "salt", "counts"])

    return contexts


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of all list elements; a null list has none."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False)


def _tail_contexts(classes, width: int):
    """Counts of classes beside each tail word (codes: class before, or ``width`` + class after); at
    the end of a task what its words add to the counts of the head and of their own classes."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classes.value
        total = len(own)
        held = _table(total, width)
        for batch in batches:
            of = batch.column("class").to_numpy()
            (row, code), (_, n) = _flat(batch.column("codes")), _flat(batch.column("ns"))
            (more_row, more_code), (_, more_n) = _flat(batch.column("tail_codes")), _flat(batch.column("tail_ns"))
            side, token = code // total, code % total
            np.add.at(held, (1 - side, token * np.int64(width) + of[row]), n)
            rows, codes = np.concatenate([row, more_row]), np.concatenate([side * width + own[token], more_code]).astype(np.int64)
            seen, place = np.unique(rows * (2 * width) + codes, return_inverse=True)
            sums = np.bincount(place, np.concatenate([n, more_n]), len(seen)).astype(np.int64)
            rows, codes = seen // (2 * width), seen % (2 * width)
            np.add.at(held, (codes // width, (total + of[rows]).astype(np.int64) * width + codes % width), sums)
            offsets = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("class"), pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(sums)), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())],
                ["word", "class", "codes", "ns", "block", "salt", "counts"])
        parts = _blocks(held, width)
        none = pa.nulls(len(parts[0]))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.list_(pa.int32())), none.cast(pa.list_(pa.int64())), *parts],
            ["word", "class", "codes", "ns", "block", "salt", "counts"])

    return contexts


def _moved(bigrams, targets: int, turn: int):
    """Classes of tail words after an exchange step."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bigrams.value
        width = len(table)
        for batch in batches:
            (row, code), (_, n) = _flat(batch.column("codes")), _flat(batch.column("ns"))
            counts = np.zeros((batch.num_rows, 2 * width))
            counts[row, code] = n
            words, own = batch.column("word").to_numpy(), batch.column("class").to_numpy()
            movable = np.full(len(words), True) if not turn else (words >> 7) % 2 == turn % 2
            best = best_classes(counts[:, :width], counts[:, width:], own, table, targets)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(np.where(movable, best, own).astype(np.int32))], ["word", "class"])

    return moved


def _add(parts: pa.Table) -> pa.Table:
    """Sum of the blocks of one group, as 64-bit counts; 4-byte parts are a task's own."""
    total = None
    for salt, counts in zip(parts["salt"].to_pylist(), parts["counts"].to_pylist()):
        part = np.frombuffer(counts, np.int64 if salt < 0 else np.uint32).astype(np.int64)
        total = part if total is None else total + part
    return pa.table([parts["block"].slice(0, 1), pa.array([-1], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "salt", "counts"])


def context_counts(encoded: DataFrame, tail: DataFrame, classes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables token x class of what stands before and after each token of the head, the end, and the
    tail's words by their class. ``tail`` is a staged result of ``_tail_contexts``.

    Summed in two levels, so that no group grows with the number of tasks.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(classes)
    schema = "block int, salt int, counts binary"
    parts = encoded.select("ids").mapInArrow(_contexts(shared, width), schema)
    parts = parts.unionByName(tail.where("block IS NOT NULL").select("block", "salt", "counts"))
    summed = parts.groupBy("block", "salt").applyInArrow(_add, schema).groupBy("block").applyInArrow(_add, schema).toArrow()
    size = len(classes) + width
    out = np.zeros((2, -(-size // BLOCK) * BLOCK, width), np.int64)
    for block, counts in zip(summed["block"].to_pylist(), summed["counts"].to_pylist()):
        out[:, block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(counts, np.int64).reshape(2, BLOCK, width)
    return out[0, :size], out[1, :size]


def class_bigrams(after: np.ndarray, classes: np.ndarray, width: int) -> np.ndarray:
    table = np.zeros((width, after.shape[1]))
    np.add.at(table, classes, after)
    return table


def likelihood(bigrams: np.ndarray) -> float:
    """Part of the class-bigram log likelihood that depends on the classes."""
    log = lambda x: np.log(np.maximum(x, 1))
    return float((bigrams * log(bigrams)).sum() - (bigrams.sum(1) * log(bigrams.sum(1))).sum() - (bigrams.sum(0) * log(bigrams.sum(0))).sum())


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, movable: np.ndarray, targets: int, width: int) -> np.ndarray:
    """Classes after the movable words went where the likelihood gains most.

    A word's own counts are taken out of its class first, so staying has no unfair advantage.
    """
    best = best_classes(before, after, classes, class_bigrams(after, classes, width), targets)
    return np.where(movable, best, classes).astype(np.int32)


def best_classes(before: np.ndarray, after: np.ndarray, own: np.ndarray, bigrams: np.ndarray, targets: int) -> np.ndarray:
    """The class of the largest gain for each word, by its counts and the class bigrams."""
    floor = 0.5
    follow, lead = np.log(bigrams + floor), np.log(bigrams.T + floor)
    rows, columns = bigrams.sum(1), bigrams.sum(0)
    n_after, n_before = after.sum(1), before.sum(1)
    gain = after @ follow.T + before @ lead.T - n_after[:, None] * np.log(rows + floor) - n_before[:, None] * np.log(columns + floor)
    without = lambda table, counts: np.log(np.maximum(table[own] - counts, 0) + floor)
    gain[np.arange(len(own)), own] = (
        (after * without(bigrams, after)).sum(1) + (before * without(bigrams.T, before)).sum(1)
        - n_after * np.log(np.maximum(rows[own] - n_after, 0) + floor) - n_before * np.log(np.maximum(columns[own] - n_before, 0) + floor)
    )
    return gain[:, :targets].argmax(1)


@dataclass
class Model:
    """Everything a task needs to score: bounded by the head and the number of classes."""

    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    base: np.ndarray
    known: np.ndarray


def cluster(encoded: DataFrame, tail: DataFrame, size: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Classes of the head's tokens, class bigrams, and ``word, class`` of the tail, of the best round.

    ``tail`` has the hash of every tail word as ``word``.
    """
    spark = encoded.sparkSession
    width, total = classes + 2, size + 2
    own = np.append(np.arange(size) % classes, [classes, classes + 1]).astype(np.int32)
    placed = stage(tail.select("word").distinct().withColumn("class", F.pmod(F.shiftright("word", 20), F.lit(classes)).cast("int")), "brown-classes")
    found = stage(encoded.select("ids", "rare").mapInArrow(_neighbours(size), NEIGHBOURS), "brown-found")
    near = stage(found.where("other IS NULL").groupBy("word").agg(F.flatten(F.collect_list("codes")).alias("codes"), F.flatten(F.collect_list("ns")).alias("ns")), "brown-near")
    pairs = stage(found.where("other IS NOT NULL").groupBy("word", "other").agg(F.sum("n").alias("n")), "brown-pairs")
    discard(found)
    both = pairs.select("word", "other", F.lit(width).alias("side"), "n").unionByName(
        pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.lit(0).alias("side"), "n"))
    best = (-np.inf, own, np.zeros((width, width)), placed)
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(own)
        beside = (
            both.join(placed.select(F.col("word").alias("other"), "class"), "other")
            .groupBy("word", (F.col("side") + F.col("class")).alias("code")).agg(F.sum("n").alias("n"))
            .groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("beside"))
            .select("word", F.col("beside.code").alias("tail_codes"), F.col("beside.n").alias("tail_ns"))
        )
        joined = placed.join(near, "word", "left").join(beside, "word", "left")
        contexts = stage(joined.mapInArrow(_tail_contexts(shared, width), CONTEXTS), "brown-contexts")
        before, after = context_counts(encoded, contexts, own, width)
        every = np.append(own, np.arange(width)).astype(np.int32)
        bigrams = class_bigrams(after, every, width)
        reached = likelihood(bigrams)
        last = placed
        if reached > best[0]:
            if best[3] is not placed:
                discard(best[3])
            best = (reached, own, bigrams, placed)
        if turn < rounds:
            movable = np.arange(total + width) < size
            if turn:
                # (a fixed mixing of the rank) half of the words in turn
                movable &= (np.arange(total + width) * 2654435761 >> 7) % 2 == turn % 2
            own = exchange(before, after, every, movable, classes, width)[:total]
            step = _moved(spark.sparkContext.broadcast(bigrams), classes, turn)
            placed = stage(contexts.where("word IS NOT NULL").select("word", "class", "codes", "ns").mapInArrow(step, "word long, class int"), "brown-classes")
        if best[3] is not last:
            discard(last)
        discard(contexts)
        spark._jvm.System.gc()  # lets Spark remove the shuffle files of the round
    discard(near, pairs)
    return best[1], best[2], best[3]


def _score(model):
    """What the head's tokens and the ends add; ``score`` lacks transitions from and to the tail."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        rare, end = len(m.classes) - 2, len(m.classes) - 1
        for batch in batches:
            ids, before, offsets = _sequences(batch, end)
            add = lambda values: np.add.reduceat(values, offsets[:-1]) if len(values) else np.zeros(0)
            steps = np.where((ids == rare) | (before == rare), 0.0, m.transition[m.classes[before], m.classes[ids]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offsets).astype(np.int64)),
                 pa.array(add(m.known[ids]).astype(np.int64)), pa.array(add(m.base[ids])),
                 pa.array(add(steps + m.emission[ids]))],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def _tail_tokens(classes):
    """Tail words with the classes beside them; the number of classes for another tail word."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classes.value
        rare, end = len(own) - 2, len(own) - 1
        for batch in batches:
            ids, before, offsets = _sequences(batch, end)
            at = np.flatnonzero(ids == rare)
            row = np.repeat(batch.column("row").to_numpy(), np.diff(offsets))
            beside = [pa.array(np.where(there == rare, own[end] + 1, own[there])) for there in ((before[at], ids[at + 1]) if len(at) else (ids[:0], ids[:0]))]
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), batch.column("rare").flatten(), *beside], ["row", "word", "left", "right"])

    return tokens


def _tail_pairs(size: int):
    """Hashes of tail words that stand next to each other."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, before, offsets = _sequences(batch, size + 1)
            keys = np.zeros(len(ids), np.int64)
            keys[ids == size] = _tail_keys(batch)
            second = np.flatnonzero((ids == size) & (before == size))
            row = np.repeat(batch.column("row").to_numpy(), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([pa.array(row[second]), pa.array(keys[second - 1]), pa.array(keys[second])], ["row", "x", "y"])

    return pairs


def _outside(head):
    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = head.value.index
        for batch in batches:
            yield batch.filter(pa.array([w.as_py() not in index for w in batch.column("word")], pa.bool_()))

    return outside


def score(documents: DataFrame, head: int = HEAD, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    ``score`` is the log10 probability of the text and its end under the class bigrams, ``base_score``
    that of add-one unigrams. Both learn from all rows that are not held out. Words have add-one
    counts in their class; a word without a training count may be the one unseen word of any class,
    and what follows it doesn't depend on it.

    ``head`` only says how many words are kept as arrays: all words are put into classes.

    Defined cases: null text is empty (one token, the end); a null id is learned from; rows repeating
    a ``doc_id`` are separate texts; without any text to learn from all tokens are unknown; an empty
    table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = rows.where(~F.col("held_out")).select("text").mapInArrow(_count, "word binary, n long")
    vocabulary = stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "brown-words")
    top = vocabulary.orderBy(F.desc("n"), "word").limit(head).toArrow()
    words = {w: i for i, w in enumerate(top["word"].to_pylist())}
    shared = Head(words)
    index = spark.sparkContext.broadcast(shared)
    encoded = stage(rows.mapInArrow(_encode(index), ENCODED), "brown-encoded")
    learned = encoded.where(~F.col("held_out"))
    tail = vocabulary.mapInArrow(_outside(index), "word binary, n long").withColumn("key", F.xxhash64("word"))
    own, bigrams, classed = cluster(learned, tail.select(F.col("key").alias("word")), shared.size, classes, rounds)
    placed = stage(tail.join(classed.withColumnRenamed("word", "key"), "key").select("word", "n", "class"), "brown-placed")

    ends = learned.count()
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] + ends, sums["v"] + (1 if ends else 0)
    counts = np.append(np.array(top["n"].to_pylist(), float), [0, ends])
    in_class = np.bincount(own[:shared.size], counts[:shared.size] + 1, classes) + 1
    for r in placed.groupBy("class").agg(F.sum(F.col("n") + 1).alias("n")).collect():
        in_class[r["class"]] += r["n"]
    # the class of unseen words, which has no bigrams, is reached by way of all others
    unseen = classes
    per_class = bigrams.sum(0) + 1
    per_class[unseen] = 0
    prior = per_class / per_class.sum()
    steps = (bigrams + SMOOTHING * prior) / (bigrams.sum(1, keepdims=True) + SMOOTHING)
    steps[:, unseen] = steps[:, :classes] @ (1 / in_class)
    transition = np.log10(steps)
    emission = np.zeros(len(own))
    emission[:shared.size] = np.log10((counts[:shared.size] + 1) / in_class[own[:shared.size]])
    # the tail's tokens get their part for c = 0 here; the join below adds log10(c + 1)
    base = np.log10((counts + 1) / (n + v + 1))
    known = (counts > 0).astype(np.int64)
    model = spark.sparkContext.broadcast(Model(own, transition, emission, base, known))
    scored = encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(
        _score(model), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    # one row and column more, of zeros, for steps from and to tail words: these are added as pairs
    width = classes + 3
    step = F.array(*map(F.lit, np.pad(transition, (0, 1)).ravel().tolist()))
    within = F.array(*map(F.lit, np.append(-np.log10(in_class), [0.0, 0.0]).tolist()))
    between = lambda a, b: F.element_at(step, a * width + b + 1)
    class_of = F.coalesce("class", F.lit(unseen))
    token = F.coalesce(F.log10(F.col("n") + 1), F.lit(0.0))
    found = (
        encoded.select("row", "ids", "rare").mapInArrow(_tail_tokens(spark.sparkContext.broadcast(own)), "row long, word binary, left int, right int")
        .join(placed, "word", "left")
        .select("row", F.col("class").isNotNull().cast("long").alias("known"), token.alias("base"), (
            token + F.element_at(within, class_of + 1)
            + between(F.col("left"), class_of) + between(class_of, F.col("right"))).alias("more"))
    )
    side = lambda name: classed.select(F.col("word").alias(name), F.col("class").alias(f"{name}_class"))
    beside = (
        encoded.select("row", "ids", "rare").mapInArrow(_tail_pairs(shared.size), "row long, x long, y long")
        .join(side("x"), "x", "left").join(side("y"), "y", "left")
        .select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"),
                between(F.coalesce("x_class", F.lit(unseen)), F.coalesce("y_class", F.lit(unseen))).alias("more"))
    )
    added = found.unionByName(beside).groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("more").alias("more"))
    joined = scored.join(added, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
