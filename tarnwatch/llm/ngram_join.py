"""N-gram Jaccard self-join with prefix filters under several global token orders.

Tokens are the distinct word n-grams of a text, as 64-bit hashes. Two sets with Jaccard similarity
of at least t share a token among the first ``size - ceil(t * size) + 1`` tokens of each, under any
total order of all tokens. So a linked pair must meet under every order; a pair that misses under
one of them is dropped before its sets are compared.

Proposals come from a family of orders, each of which puts one part of all tokens first: parts are
dealt by hash, and sets that differ in at most d tokens have one of any d + 1 parts in common, whole.
How many parts there are depends on the sizes of a linked pair, so sizes are cut into levels and a set
takes part in its own level and, if a linked set may be there, in the next one. A part holds several
tokens, so sets that share only a passage or some common tokens hardly ever propose each other.

The orders that filter pairs put rare tokens first: tokens are ranked by how heavy their bucket is in
a table of fixed size that counts all sets, then by a hash of their own per order. Shared passages and
the words of large groups of copies come last, so they only link texts that consist of little else.

Sets that are equal are one class from the start. Between classes, every part first offers its members
to one pivot (the member that shares most parts, usually the common origin), which costs one pair per
member instead of all pairs. Pairs whose odd sketches differ in more bits than linked sets may differ
in tokens are dropped before their texts are read again for prefixes and whole sets. Classes found
linked become one component, and a part whose members all belong to one component has nothing left to
offer. After that, only pairs across components are left; all of these are compared unless other
pairs have linked their components already.

Parts of more than ``CROWD`` members would offer too many pairs across components that nearly link, as
copies with many edits do. Their members are told apart by how they differ from the part's pivot: where
two sets differ from it in a and b tokens, they differ in a + b less twice what the differences have in
common. If a + b alone allows a link, one member per part (with the most room for that) links all such
members; all other linked pairs have tokens in common in their differences, and these are found by
prefixes of the differences, those first that few members have. No candidate or partner is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.bits import bit_filter, passes
from tarnwatch.llm.scratch import discard
from tarnwatch.session import shuffles_freed, stage

#: log2 of the number of counters in the table of token weights (4 MiB as 64-bit counters).
COUNTER_BITS = 19
#: Orders whose prefixes are intersected before sets are compared.
MORE_ORDERS = 2
#: Ratio of the sizes at both ends of a level, if sets may link at all over that ratio.
LEVEL_RATIO = 1.25
#: Share of sets that may have more empty parts than their level has to spare.
SPARSE = 1e-2
#: Bytes of text whose parts are counted at once: some 20 million parts, so that a filter is nearly empty.
SLICE_BYTES = 256 << 20
#: Members of a part up to which its pairs across components are all proposed.
CROWD = 32
#: Members of crowds that are compared at once: so many, or a share of all sets if that is more.
CROWD_ROWS, CROWD_SHARE = 20_000, 1 / 16
#: Copies of a pivot among which its members are dealt.
SALTS = 16
#: Bytes of text whose sets are held as arrays at once.
HELD_BYTES = 1 << 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values, different for each seed."""
    with np.errstate(over="ignore"):
        x = values + np.uint64(seed + 1) * ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text.

    A-Z are lower-cased, words are split at ``[\\x20\\x09-\\x0D]``. A text with fewer than n words
    is one n-gram; null, or no words, has none.
    """
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(hashes))
    with np.errstate(over="ignore"):
        grams = np.full(len(hashes) - n + 1, np.uint64(n), np.uint64)
        for i in range(n):
            grams = (grams ^ (grams >> np.uint64(29))) * ODD + hashes[i:len(hashes) - n + 1 + i]
        return np.unique(mix(grams))


def set_key(grams: np.ndarray) -> bytes | None:
    """128 bits that identify a set; None for the empty set."""
    if not len(grams):
        return None
    low, high = mix(grams, 101).sum(dtype=np.uint64), mix(grams, 103).sum(dtype=np.uint64)
    return int(low).to_bytes(8, "big") + int(high).to_bytes(8, "big")


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def weight_classes(counters: np.ndarray) -> np.ndarray:
    """Class of each counter: log2 of how many times the mean it holds, 0 up to twice the mean."""
    mean = max(1.0, float(counters.mean()))
    return np.clip(np.floor(np.log2(np.maximum(counters, 1) / mean)), 0, 63).astype(np.uint64)


def prefix(grams: np.ndarray, classes: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The tokens of a set's prefix under one order: light classes first, then by a hash."""
    length = len(grams) - -(-percent * len(grams) // 100) + 1
    if length >= len(grams):
        return grams
    rank = (classes[_bucket(grams)] << np.uint64(58)) | (mix(grams, 1000 + order) >> np.uint64(6))
    return grams[np.argpartition(rank, length - 1)[:length]]


#: Bits of an odd sketch: each is the parity of the tokens that fall on it.
SKETCH_BITS = 512


def odd_sketches(grams: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Parities of each set as 64-bit words. Two sketches differ in at most as many bits as the sets in tokens."""
    at = owner * SKETCH_BITS + (mix(grams, 77) >> np.uint64(55)).astype(np.int64)
    parity = np.bincount(at, minlength=count * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(count, -1)


@lru_cache(maxsize=8)
def levels(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest size of each level, its number of parts (0: only equal sets link) and how many may be empty.

    Sets that link are in the same level or in two that follow each other. Linked sets of a level differ
    in at most ``2 * size * (100 - percent) / (100 + percent)`` tokens; with one part more than that and
    one for each part that may be empty, they have a part in common that is not empty.
    """
    percent = max(1, percent)
    ratio, tops, parts, spare = max(LEVEL_RATIO, 100 / percent), [0], [0], [0]
    while tops[-1] < 1 << 32:
        top = max(tops[-1] + 1, ceil(tops[-1] * ratio))
        differ = 2 * top * (100 - percent) // (100 + percent)
        least, empty = percent * (tops[-1] + 1) / 100, 0
        while differ and empty <= differ:
            # Poisson tail: more than ``empty`` of the parts are empty
            mean = (differ + 1 + empty) * exp(-least / (differ + 1 + empty))
            if mean > 500:
                empty = ceil(mean + 4 * mean**0.5)
                break
            term, below = exp(-mean), exp(-mean)
            for k in range(1, empty + 1):
                term *= mean / k
                below += term
            if 1 - below <= SPARSE:
                break
            empty += max(1, empty // 8)
        tops.append(top)
        parts.append(differ + 1 + empty if differ else 0)
        spare.append(empty)
    return np.array(tops), np.array(parts), np.array(spare)


def part_keys(grams: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of each set in its levels, and the set of each; ``grams`` are of all sets in turn.

    Keys are equal if level and part are, and all tokens of the part. Empty parts have a key only in
    sets that have more of them than their level has to spare.
    """
    tops, parts, spare = levels(percent)
    own = np.searchsorted(tops, sizes)
    hashes, spot = mix(grams, 211), mix(grams, 223) >> np.uint64(32)
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.float64), (hashes >> np.uint64(32)).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys, sets = [], []
    for level, takes in ((own, np.full(len(sizes), True)), (own + 1, 100 * sizes >= percent * (tops[own] + 1))):
        width = np.where(takes, parts[level], 0)
        start = np.concatenate([[0], np.cumsum(width)])
        inside = width[owner] > 0
        of = owner[inside]
        at = start[of] + ((spot[inside] * width[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        # sums of fewer than 2 ** 20 tokens' halves are exact; a part of more is still summed the same way in both sets
        held = np.bincount(at, minlength=start[-1])
        sums = [np.bincount(at, half[inside], start[-1]).astype(np.uint64) for half in (low, high)]
        part_of = np.repeat(np.arange(len(sizes)), width)
        number = np.arange(start[-1]) - start[part_of]
        empty = np.bincount(part_of[held == 0], minlength=len(sizes))
        wanted = (held > 0) | (empty > spare[level])[part_of]
        with np.errstate(over="ignore"):
            key = mix(sums[0], 227) + mix(sums[1], 229) + mix((level[part_of].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64), 233)
        keys.append(mix(key)[wanted])
        sets.append(part_of[wanted])
    return np.concatenate(keys), np.concatenate(sets)


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``HELD_BYTES`` of text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + HELD_BYTES, "right")))
        yield start, stop
        start = stop


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


SETS = "doc_id long, text_hash long, node binary, size long, sketch array<long>, block int, counts binary"


def _parts_schema(slices: int) -> str:
    return ", ".join(f"parts{k} array<long>" for k in range(slices))


def _sets(n: int, percent: int, slices: int, rows: int = 256):
    """Keys, sizes, sketches and parts of all sets, and at the end of a task its token counters in blocks.

    Parts are dealt by their key to a column for each slice.
    """

    names = [c.split()[0] for c in f"{SETS}, {_parts_schema(slices)}".split(", ")]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for start, stop in _portions(batch.column(1)):
                part = batch.slice(start, stop - start)
                found = [shingles(text.as_py(), n) for text in part.column(1)]
                sizes = np.array([len(g) for g in found], np.int64)
                grams, owner = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
                held += np.bincount(_bucket(grams), minlength=1 << COUNTER_BITS)
                keys, of = part_keys(grams, sizes, percent)
                # by low bits, as filters tell keys apart by the high ones
                dealt = ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64) * len(found) + of
                keys = keys[np.argsort(dealt, kind="stable")].view(np.int64)
                counts = np.bincount(dealt, minlength=slices * len(found)).reshape(slices, -1)
                cuts = np.cumsum(counts.sum(axis=1))[:-1]
                sketches = odd_sketches(grams, owner, len(found))
                none = pa.nulls(len(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([set_key(g) for g in found], pa.binary()), pa.array(sizes),
                     _lists(sketches.ravel(), np.full(len(found), sketches.shape[1])), none.cast(pa.int32()), none.cast(pa.binary()),
                     *map(_lists, np.split(keys, cuts), counts)], names)
        blocks = [(i, part.astype(np.uint32).tobytes()) for i, part in enumerate(held.reshape(rows, -1)) if part.any()]
        none = pa.nulls(len(blocks))
        longs = none.cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), longs,
             pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary()), *[longs] * slices], names)

    return sets


def _add_counters(parts: pa.Table) -> pa.Table:
    total = np.zeros(len(parts["counts"][0].as_py()) // 4, np.int64)
    for counts in parts["counts"]:
        total += np.frombuffer(counts.as_py(), np.uint32)
    return pa.table([parts["block"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])


def _token_weights(sets: DataFrame) -> np.ndarray:
    """Classes of all counters; ``2 ** COUNTER_BITS`` numbers whatever the input."""
    counters = np.zeros(1 << COUNTER_BITS, np.int64)
    with shuffles_freed(sets.sparkSession):
        added = sets.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(_add_counters, "block int, counts binary").toArrow()
    for block, counts in zip(added["block"].to_pylist(), added["counts"].to_pylist()):
        part = np.frombuffer(counts, np.int64)
        counters[block * len(part):(block + 1) * len(part)] = part
    return weight_classes(counters).astype(np.uint8)


ORDERS = [f"order{k}" for k in range(1, MORE_ORDERS + 1)]
WHOLE = "node binary, grams array<long>, " + ", ".join(f"{o} array<int>" for o in ORDERS)


def _whole_sets(n: int, percent: int, classes, words):
    """Sets of the rows whose id may be wanted (null ids always may), and their prefixes, 32 bits a token."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = classes.value.astype(np.uint64)
        for batch in batches:
            ids = batch.column(0)
            hashes = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            wanted = batch.filter(pa.array(passes(words.value, hashes) | ids.is_null().to_numpy(zero_copy_only=False)))
            for start, stop in _portions(wanted.column(1)):
                sets = [g for t in wanted.column(1).slice(start, stop - start) if len(g := shingles(t.as_py(), n))]
                others = [[(prefix(g, weight, percent, k) >> np.uint64(32)).astype(np.uint32).view(np.int32) for g in sets] for k in range(1, MORE_ORDERS + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(g) for g in sets], pa.binary()), pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64())),
                     *(pa.array(o, pa.list_(pa.int32())) for o in others)], ["node", "grams", *ORDERS])

    return whole


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x_grams"), batch.column("y_grams")):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return linked


MEMBERS = "pivot binary, node binary, size int, label binary, room long, differ array<long>"


def _differing(percent: int):
    """What members have and their pivot has not, or the other way round; and the room that this
    leaves: two members whose rooms sum to 0 or more link by it alone."""

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                differ = [np.setxor1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True) for x, y in zip(part.column("x_grams"), part.column("y_grams"))]
                counts = np.array([len(d) for d in differ], np.int64)
                room = (100 - percent) * part.column("size").to_numpy().astype(np.int64) - (100 + percent) * counts
                yield pa.RecordBatch.from_arrays(
                    [part.column("y"), part.column("x"), part.column("size"), part.column("label"), pa.array(room), pa.array(differ, pa.list_(pa.int64()))],
                    ["pivot", "node", "size", "label", "room", "differ"])

    return differing


def across_crowds(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``x, y`` pairs of different labels, enough to find all links among members of the same pivot.

    ``members`` are distinct ``pivot, node, size, label`` with the pivot among its members, ``sets`` have
    ``node, grams`` of all of them.
    """
    salted = F.pmod(F.xxhash64("x"), F.lit(SALTS))
    grams = sets.select(F.col("node").alias("y"), F.col("grams").alias("y_grams")).join(members.select(F.col("pivot").alias("y")).distinct(), "y", "left_semi")
    grams = grams.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = members.select(F.col("pivot").alias("y"), F.col("node").alias("x"), "size", "label").withColumn("salt", salted)
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("grams").alias("x_grams")), "x").join(grams, ["y", "salt"])
    compared = both.select("y", "x", "size", "label", "x_grams", "y_grams").mapInArrow(_differing(percent), MEMBERS)
    members = rows = stage(compared.withColumn("member", F.monotonically_increasing_id()), "ngram-members")
    most = rows.groupBy("pivot").agg(F.max(F.struct("room", "node", "label")).alias("most"))
    rows = rows.join(most.select("pivot", F.col("most.room").alias("most"), F.col("most.node").alias("hub"), F.col("most.label").alias("hub_label")), "pivot")
    star = F.col("room") + F.col("most") >= 0
    hubs = rows.where(star & (F.col("label") != F.col("hub_label"))).select(F.col("node").alias("x"), F.col("hub").alias("y"))
    # tokens that two differences must have in common: by the partner's room, at most that of the hub
    # or, for members that link with the hub, less than what would link the partner with it, too
    other = F.when(star, F.col("most") + 1 - F.col("room")).otherwise(-F.col("room") - F.col("most"))
    count = F.size("differ")
    common = F.greatest(F.ceil(other / (2 * (100 + percent))), count - F.floor((100 - percent) * F.col("size") / max(1, percent)), F.lit(1))
    length = F.greatest(count - common + 1, F.lit(0)).cast("int")
    # rare is what few members of the pivot have: what it has alone is in all differences; pivots stand
    # as hashes, as two that are taken for one only offer more pairs
    crowd = F.xxhash64("pivot").alias("crowd")
    shared = rows.select(crowd, F.explode("differ").alias("token")).groupBy("crowd", "token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    tokens = rows.select(crowd, "member", count.alias("count"), length.alias("length"), F.explode("differ").alias("token")).join(shared, ["crowd", "token"])
    # tokens of one member alone come first and meet nobody
    mine = Window.partitionBy("member")
    alone = F.col("count") - F.count(F.lit(1)).over(mine)
    tokens = tokens.withColumn("place", alone + F.row_number().over(mine.orderBy("members", "token"))).where("place <= length")
    tokens = stage(tokens.select("crowd", "token", "member", (F.col("count") - F.col("place") + 1).alias("rest")), "ngram-differ")
    whose = tokens.join(members.select("member", "node", "size", "label", "room"), "member")
    side = lambda s: whose.select("crowd", "token", F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("size", "label", "room", "rest")))
    # from the first token that two have in common on, both must hold as many as their rooms ask for
    enough = 2 * (100 + percent) * F.least("x_rest", "y_rest") + F.col("x_room") + F.col("y_room") >= 0
    meet = side("x").join(side("y"), ["crowd", "token"]).where((F.col("x_label") < F.col("y_label")) & _sizes_allow("x_size", "y_size", percent) & enough)
    pairs = stage(meet.select("x", "y").unionByName(hubs).distinct(), "ngram-crowds")
    discard(members, tokens)
    return pairs


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of all nodes in ``x, y`` edges; the label is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), as joins with each
    node's smallest neighbour, until the edges stay the same. No neighbour list is ever gathered.
    """
    state = None
    edges = stage(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        smallest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(smallest, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(smallest.withColumnRenamed("m", "y")).distinct()
        last, edges = edges, stage(small, "edges")
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(x, y))")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(
        edges.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())


def similar_documents(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, n_texts``.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets.
    ``component_id`` is the smallest ``doc_id`` reachable by links, ``n_texts`` the number of
    different sets in the component.

    Defined cases: null, empty or blank texts have no n-grams and link with nothing (component: own
    id); rows that repeat a ``doc_id`` are separate documents; null ids take part in links but name a
    component only if no other id does; an empty table gives an empty result; other columns are not
    read. Tokens are 64-bit hashes and sets are told apart by 128 bits.
    """
    return marked_documents(documents, n, percent).drop("text_hash", "component")


def marked_documents(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``similar_documents`` with ``text_hash``, Spark's ``xxhash64`` of the row's text, and with
    ``component``, which tells components of the same name apart (null: no n-grams)."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    slices = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES))
    sets = stage(rows.mapInArrow(_sets(n, percent, slices), f"{SETS}, {_parts_schema(slices)}"), "ngram-sets")
    classes = spark.sparkContext.broadcast(_token_weights(sets))
    measured = stage(sets.where("block IS NULL").select("doc_id", "text_hash", "node", "size"), "ngram-measured")
    nodes = measured.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"))

    filters = stage(sets.where("node IS NOT NULL").select("node", "size", "sketch").dropDuplicates(["node"]), "ngram-filters")
    # slices of the parts one after another: a filter of fixed size is for a bounded number of parts, and
    # what is shuffled at once does not grow
    shared = None
    for k in range(slices):
        parts = sets.where("node IS NOT NULL").select("node", F.col("size").cast("int").alias("size"), F.explode(f"parts{k}").alias("part"))
        repeated = spark.sparkContext.broadcast(bit_filter(parts.groupBy("part").count().where("count > 1"), "part"))
        maybe = parts.mapInArrow(_passing("part", repeated), "node binary, size int, part long")
        shared = stage(maybe.groupBy("part", "node").agg(F.max("size").alias("size")), "ngram-shared", shared)
        repeated.destroy()
    discard(sets)

    def side(sets: DataFrame, s: str, columns: list[str]) -> DataFrame:
        return sets.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns))

    def close(pairs: DataFrame, name: str) -> DataFrame:
        """Proposed pairs that pass the sketches."""
        small = ["size", "sketch"]
        sketched = pairs.join(side(filters, "x", small), "x").join(side(filters, "y", small), "y")
        apart = " + ".join(f"bit_count(x_sketch[{i}] ^ y_sketch[{i}])" for i in range(SKETCH_BITS // 64))
        return stage(sketched.where(f"{100 + percent} * ({apart}) <= {100 - percent} * (x_size + y_size)").select("x", "y"), f"{name}-close")

    def whole(pairs: DataFrame, name: str) -> DataFrame:
        """Prefixes and sets of all that stand in pairs."""
        ends = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
        ids = ends.join(nodes, "node").where("first_id IS NOT NULL").select("first_id")
        wanted = spark.sparkContext.broadcast(bit_filter(ids.mapInArrow(_hashed_ids, "hash long"), "hash"))
        found = rows.select("doc_id", "text").mapInArrow(_whole_sets(n, percent, classes, wanted), WHOLE)
        return stage(found.dropDuplicates(["node"]), f"{name}-sets")

    def meeting(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """Pairs that meet under all orders that put rare tokens first."""
        meet = pairs.join(side(sets, "x", ORDERS), "x").join(side(sets, "y", ORDERS), "y")
        for order in ORDERS:
            meet = meet.where(F.arrays_overlap(f"x_{order}", f"y_{order}"))
        return stage(meet.select("x", "y"), f"{name}-met")

    def verified(met: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among pairs, by comparing whole sets."""
        both = met.join(side(sets, "x", ["grams"]), "x").join(side(sets, "y", ["grams"]), "y").select("x", "y", "x_grams", "y_grams")
        return stage(both.mapInArrow(_linked(percent), "x binary, y binary"), "ngram-links")

    # (what passed the filter wrongly is the only member of its part)
    shares = shared.groupBy("node").agg(F.count(F.lit(1)).alias("shares"))
    pivots = shared.join(shares, "node").groupBy("part").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("shares", "node", "size")).alias("pivot"))
    pivots = stage(pivots.where("members > 1").select("part", "members", F.col("pivot.node").alias("y"), F.col("pivot.size").alias("y_size")), "ngram-pivots")
    offered = shared.join(pivots, "part").where((F.col("node") != F.col("y")) & _sizes_allow("size", "y_size", percent))
    pivot_pairs = close(offered.select(F.col("node").alias("x"), "y").distinct(), "ngram-pivot")
    pivot_sets = whole(pivot_pairs, "ngram-pivot")
    links = verified(meeting(pivot_pairs, pivot_sets, "ngram-pivot"), pivot_sets)
    labels = stage(components(links), "ngram-labels")
    discard(pivot_pairs, pivot_sets)

    marked = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = marked.groupBy("part").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("part")
    open_parts = stage(marked.join(mixed, "part").join(pivots.select("part", "members", F.col("y").alias("pivot")), "part"), "ngram-open")
    few = open_parts.where(F.col("members") <= CROWD)
    left = few.select("part", F.col("node").alias("x"), F.col("size").alias("x_size"), F.col("label").alias("x_label"))
    right = few.select("part", F.col("node").alias("y"), F.col("size").alias("y_size"), F.col("label").alias("y_label"))
    across = left.join(right, "part").where((F.col("x_label") < F.col("y_label")) & _sizes_allow("x_size", "y_size", percent)).select("x", "y")
    crowds = stage(open_parts.where(F.col("members") > CROWD).select("pivot", "node", "size", "label").distinct(), "ngram-crowds")
    if not crowds.isEmpty():
        crowd_sets = whole(crowds.select(F.col("node").alias("x"), F.col("pivot").alias("y")), "ngram-crowd")
        turns = ceil(crowds.count() / max(CROWD_ROWS, CROWD_SHARE * filters.count()))
        for k in range(turns):
            some = crowds.where(F.pmod(F.xxhash64("pivot"), F.lit(turns)) == k)
            across = across.unionByName(across_crowds(some, crowd_sets, percent))
        discard(crowd_sets)
    cross_pairs = close(across.distinct(), "ngram-cross")
    cross_sets = whole(cross_pairs, "ngram-cross")
    open_pairs = meeting(cross_pairs, cross_sets, "ngram-cross")
    # Two components need one link, so a few pairs of each two are verified first, and eight times
    # as many in each further round; pairs that fall inside one component need no verification.
    share = 1
    while True:
        ranked = stage(
            open_pairs.join(labels.select(F.col("node").alias("x"), F.col("label").alias("a")), "x", "left")
            .join(labels.select(F.col("node").alias("y"), F.col("label").alias("b")), "y", "left")
            .withColumns({"a": F.coalesce("a", "x"), "b": F.coalesce("b", "y")})
            .where("a <> b")
            .withColumn("place", F.row_number().over(Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(F.xxhash64("x", "y"))))
            .select("x", "y", "place"),
            "ngram-ranked",
        )
        if ranked.isEmpty():
            break
        links = stage(links.unionByName(verified(ranked.where(F.col("place") <= share).select("x", "y"), cross_sets)), "ngram-links")
        labels = stage(components(links), "ngram-labels")
        open_pairs, share = ranked.where(F.col("place") > share).select("x", "y"), share * 8
    discard(shared, filters, pivots, open_parts, cross_pairs, cross_sets)

    named = (
        nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("node", "first_id", "label")
    )
    names = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_texts"))
    by_node = named.select("node", "label").join(names, "label").select("node", "component_id", "n_texts", F.col("label").alias("component"))
    return measured.join(by_node, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_texts", F.lit(1)).cast("long").alias("n_texts"), "text_hash", "component",
    )


def _passing(column: str, words):
    """Rows whose hash may be in a filter of fixed size. It only saves shuffles: what passes wrongly
    is a token of one set, or a set that no pair asks for, and finds no partner."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(words.value, batch.column(column).to_numpy().view(np.uint64))))

    return passing


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(mix(ids).view(np.int64))], ["hash"])
