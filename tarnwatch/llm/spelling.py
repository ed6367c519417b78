"""Spelling variants of words by a reduced alphabet.

Letters are hashed to a few symbols. One edit of a word is at most one edit of its reduced word, so
all words one edit apart are found by generating the whole one-edit neighbourhood of every reduced
word (over the few symbols, not over all letters) and joining it with the reduced vocabulary. The
original strings decide. Three things keep this bounded:

* Reduced words are represented by polynomial hashes of 64 bits. The hash of every neighbour follows
  from prefix sums, so a word of L letters costs time and memory in proportion to L, not to L * L.
* An edit leaves one half of the original word as it is. The intact half is part of the join key, so
  words that share a reduced form only by chance, or a frequent reduced form, rarely meet.
* Candidates are pairs of word ids; strings are fetched once per distinct pair.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.session import stage

RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LETTERS = 6
MIN_COUNT = 5
SYMBOLS = 6
#: Words a counting task holds before it sends their counts on.
HELD = 1 << 18
#: Letters of a slice of neighbours: bounds the arrays of a task.
SLICE = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """64 well-spread bits of 64-bit values (a bijection)."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Polynomial hashes (sum of code[j] * base ** j, modulo 2 ** 64) of parts of words laid end to end."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, longest: int):
        self.codes, self.up, self.down = codes, _powers(_BASE, longest + 2), _powers(_INVERSE, longest + 2)
        lengths = np.diff(np.append(starts, len(codes)))
        self.at = np.arange(len(codes)) - np.repeat(starts, lengths)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.up[self.at], dtype=np.uint64)])

    def suffix(self, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hash of the letters from ``begin`` (place ``place`` of the word) to ``end`` as a word of its own."""
        return (self.sums[end] - self.sums[begin]) * self.down[place]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.cumsum(lengths) - lengths, lengths


def _prepared(words: list[str], symbols: int):
    """Hashes of the original and of the reduced letters, and the code of each symbol."""
    points, starts, lengths = _letters(words)
    longest = int(lengths.max())
    symbol = (_mixed(points + np.uint64(1)) % np.uint64(symbols)).astype(np.int64)
    codes = _mixed(np.arange(symbols, dtype=np.uint64) + np.uint64(0x5EED))
    return Hashes(_mixed(points + np.uint64(77)), starts, longest), Hashes(codes[symbol], starts, longest), symbol, codes, starts, lengths


#: Kinds of keys: the partner has as many letters or more / one less; the half that is intact.
HEAD_SAME, TAIL_SAME, HEAD_LESS, TAIL_LESS = (np.uint64(k) for k in (0x11, 0x23, 0x35, 0x47))


def _key(kind: np.uint64, reduced: np.ndarray, half: np.ndarray) -> np.ndarray:
    return _mixed(reduced + _mixed(half + kind)).view(np.int64)


def vocabulary_keys(words: list[str], symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Four keys a word: for partners that reach it by replacing or deleting a letter, or by inserting one."""
    original, reduced, _, _, starts, lengths = _prepared(words, symbols)
    ends = starts + lengths
    whole = reduced.sums[ends] - reduced.sums[starts]
    keys = []
    for shorter, head, tail in ((0, HEAD_SAME, TAIL_SAME), (1, HEAD_LESS, TAIL_LESS)):
        cut = (lengths - shorter) // 2  # of the shorter of the two words
        keys.append(_key(head, whole, original.sums[starts + cut] - original.sums[starts]))
        begin = cut + shorter
        keys.append(_key(tail, whole, original.suffix(starts + begin, ends, begin)))
    return np.tile(np.arange(len(words)), 4), np.concatenate(keys)


def neighbour_keys(words: list[str], symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the whole one-edit neighbourhoods of the reduced words, in slices of places."""
    original, reduced, symbol, codes, starts, lengths = _prepared(words, symbols)
    total = len(symbol)
    # places to edit: every letter, and the end of every word for insertions
    word_of = np.repeat(np.arange(len(words)), lengths + 1)
    place_of = np.arange(total + len(words)) - np.repeat(starts + np.arange(len(words)), lengths + 1)
    for at in range(0, len(word_of), SLICE):
        word, place = word_of[at:at + SLICE], place_of[at:at + SLICE]
        begin, length = starts[word], lengths[word]
        end, here = begin + length, begin + place
        before = reduced.sums[here] - reduced.sums[begin]
        after = reduced.sums[end] - reduced.sums[here]
        out = []

        def add(rows, values, cut, gone, head, tail, first=0):
            """``cut``: letters of the head; ``gone``: where this word's own tail begins beyond it."""
            w, b, e, p = word[rows], begin[rows], end[rows], place[rows]
            intact = p >= cut
            heads = original.sums[b + cut] - original.sums[b]
            tails = original.suffix(np.minimum(b + cut + gone, e), e, np.minimum(cut + gone, length[rows]))
            out.append((w, np.where(intact, _key(head, values, heads), _key(tail, values, tails))))

        own = place < length
        letter = np.minimum(here, total - 1)
        code, power = codes[symbol[letter]], reduced.up[place]
        rest = after - np.where(own, code * power, np.uint64(0))
        # a letter less: what follows moves down by one place
        add(own, (before + rest * reduced.down[1])[own], ((length - 1) // 2)[own], 1, HEAD_SAME, TAIL_SAME)
        for c in range(symbols):
            # another letter, the same symbol included: letters of one symbol replace each other
            add(own, (before + codes[c] * power + rest)[own], (length // 2)[own], 0, HEAD_SAME, TAIL_SAME)
            # one more letter before this place, or at the end
            every = np.ones(len(word), bool)
            add(every, before + codes[c] * power + after * reduced.up[1], length // 2, 0, HEAD_LESS, TAIL_LESS)
        rows, keys = (np.concatenate(parts) for parts in zip(*out))
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
        yield rows[new], keys[new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of whole texts, one in 199 runs of a document with a letter deleted."""
    held: Counter = Counter()

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            if not text.is_valid:
                continue
            # bytes are lower-cased in ASCII only
            runs = Counter(RUN.findall(text.as_py().lower().decode()))
            seed = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
            for run, n in runs.items():
                if len(run) >= MIN_LETTERS:
                    h = zlib.crc32(run.encode(), seed)
                    if h % 199 == 0:
                        cut = h % len(run)
                        run = run[:cut] + run[cut + 1:]
                        if len(run) < MIN_LETTERS:
                            continue
                    held[run] += n
            if len(held) >= HELD:
                yield sent()
                held.clear()
    if held:
        yield sent()


def word_counts(documents: DataFrame) -> DataFrame:
    """``word, n`` for every word of all texts with at least ``MIN_LETTERS`` letters."""
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(symbols: int, neighbours: bool):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            if not words:
                continue
            for rows, keys in neighbour_keys(words, symbols) if neighbours else [vocabulary_keys(words, symbols)]:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[rows])], ["key", "id"])

    return keyed


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, near, near_n`` for all words of ``vocabulary`` (distinct ``word``, ``n``) one edit apart.

    Both directions are returned. ``vocabulary`` is read several times: stage it.
    """
    named = vocabulary.select(F.xxhash64("word").alias("id"), "word", "n")
    words = named.select("id", "word")
    around = words.mapInArrow(_keyed(symbols, True), "key long, id long")
    have = words.mapInArrow(_keyed(symbols, False), "key long, id long").withColumnRenamed("id", "near_id")
    pairs = around.join(have, "key").where("id <> near_id").select("id", "near_id").distinct()
    near = named.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.join(named, "id").join(near, "near_id")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def variants(vocabulary: DataFrame, ratio: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of ``vocabulary`` (distinct ``word``, ``n``).

    ``form`` is the most frequent word one edit away (ties: the smallest by code points) if it occurs
    at least ``ratio`` times as often, else null. ``root`` follows the forms to the last.

    Counts grow by ``ratio`` with every form, so a chain has at most log(max n) / log(ratio) steps;
    doubling follows it in the logarithm of that.
    """
    vocabulary = stage(vocabulary, "spelling-words")
    # a word has at most (2 * letters + 1) * alphabet near words, so groups are small
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    top = near_words(vocabulary, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.rank")).alias("near_n")
    )
    is_form = F.col("near_n") >= ratio * F.col("n")
    formed = stage(
        vocabulary.join(top, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
        ), "spelling-forms")
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most, 2), ratio)))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stage(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return formed.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(documents: DataFrame, ratio: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """Variant groups of the words of whole texts: ``word, form, root, n, n_near, form_n``.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, with at least ``MIN_LETTERS`` letters
    and ``MIN_COUNT`` occurrences, after the deletion of one letter in the runs whose CRC with their
    document's id is a multiple of 199.

    Defined cases: null text has no words; a null id counts as the empty text in the CRC; repeated
    rows count repeatedly; words of any length take part; an empty table, or one without words,
    gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
    """
    return variants(word_counts(documents).where(F.col("n") >= MIN_COUNT), ratio, symbols)
