"""Sampled sub-word segmentations without replacement: Gumbel top-k over the piece lattice.

A text's lattice holds every way to write it in pieces of a SentencePiece vocabulary (bytes where no
piece fits). The paths are searched in order of their Gumbel-perturbed log probability: a set of
paths is a node of the search, its key is the largest perturbed value in it, and popping a node
splits it into the path that has this value and the sets that leave this path at one step. The keys
of those sets are truncated Gumbels, so the first k paths popped are exactly k draws without
replacement (perturbed A*; Maddison et al. 2014, Kool et al. 2019). The value of the next path,
kappa, gives the inclusion scores 1 - exp(-exp(log_prob - kappa)), reported as logarithms.

The vocabulary file of a BPE model holds ranks instead of probabilities; pieces get Zipf-Mandelbrot
probabilities of their rank. Pieces hold white space only in front, so the lattice falls into chunks
at white space, and the lattice of a chunk is built once per task while it fits. Lattices are built
and paths drawn for all texts of a batch together, with numpy. Random numbers are hashes of seed, row key, draw and place in the text, so
results don't depend on how rows are spread over tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file; a path or a file of the public tokenizers' package.
MODEL = "piece_bpe_32k.model"
#: Segmentations per text.
SAMPLES = 2
#: Shift of the Zipf-Mandelbrot law.
SHIFT = 10.0
#: Texts and characters handled together.
TEXTS, CHARS = 400, 500_000
#: Edges of the lattices a task keeps (16 bytes each).
MOST_EDGES = 4_000_000
#: Base of the prefix hashes.
BASE = 0x9E3779B97F4A7C15
#: Buckets of the prefixes of pieces, as a power of two.
BUCKET_BITS = 18
SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
NONE = -np.inf


class Vocabulary:
    """Pieces, their probabilities and their bytes."""

    def __init__(self, model: str):
        if "/" not in model:
            import public_tokenizers

            model = public_tokenizers.path(model)
        held = sentencepiece.SentencePieceProcessor(model_file=model)
        size = held.get_piece_size()
        self.byte = np.zeros(256, np.int32)
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = []
        for i in range(size):
            piece = held.id_to_piece(i)
            if held.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif held.is_control(i) or held.is_unknown(i) or held.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.raw.append(piece.encode())
        weights = 1 / (np.arange(len(self.ids)) + 1 + SHIFT)
        total = weights.sum() + 256 * weights[-1]
        self.probability = np.zeros(size)
        self.probability[list(self.ids.values())] = weights / total
        self.byte_probability = float(weights[-1] / total)
        self.longest = max(map(len, self.ids))
        self.log_probability = np.log(np.where(self.probability > 0, self.probability, 1.0))
        self.raw_array = np.array(self.raw, object)
        # hashes of all prefixes of pieces, and the piece a prefix is (or -1)
        prefixes: dict[int, int] = {}
        for piece, i in self.ids.items():
            code = 0
            for end, char in enumerate(piece, 1):
                code = (code * BASE + ord(char) + 1) % 2**64
                prefixes[code] = i if end == len(piece) else prefixes.get(code, -1)
        # in buckets by their upper bits once mixed; first and last place of each bucket
        self.prefix, self.prefix_piece = np.array(list(prefixes), np.uint64), np.array(list(prefixes.values()), np.int64)
        bucket = self._bucket(self.prefix)
        order = np.argsort(bucket)
        self.prefix, self.prefix_piece = self.prefix[order], self.prefix_piece[order]
        bounds = np.searchsorted(bucket[order], np.arange(2**BUCKET_BITS + 1)).astype(np.int32)
        self.bucket_first, self.bucket_last = bounds[:-1], bounds[1:]

    @staticmethod
    def _bucket(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are prefixes of pieces, and of those the piece (or -1)."""
        bucket = self._bucket(codes)
        place, last = self.bucket_first[bucket], self.bucket_last[bucket]
        found = np.full(len(codes), -1, np.int64)
        open_ = np.flatnonzero(place < last)
        while len(open_):
            at = place[open_]
            hit = self.prefix[at] == codes[open_]
            found[open_[hit]] = at[hit]
            open_, at = open_[~hit], at[~hit] + 1
            place[open_] = at
            open_ = open_[at < last[open_]]
        known = np.flatnonzero(found >= 0)
        return known, self.prefix_piece[found[known]]

    def lattices(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Lengths of the chunks, and the edges of all their lattices ordered by end.

        Ends are numbered along all chunks: edges per end, and of each edge its start within the
        chunk, piece and probability given its end. A character without a piece has the edge
        ``-1 - code point``. Forward masses are summed in logarithms, one place of all chunks at a time.
        """
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.array([len(c) for c in chunks], np.int64)
        first = np.repeat(np.cumsum(length) - length, length)
        left = first + np.repeat(length, length) - np.arange(len(code))
        active, held = np.arange(len(code)), np.zeros(len(code), np.uint64)
        single = np.zeros(len(code), bool)
        starts, ends, ids = [], [], []
        for size in range(1, self.longest + 1):
            inside = left[active] >= size
            active = active[inside]
            with np.errstate(over="ignore"):
                held = held[inside] * np.uint64(BASE) + (code[active + size - 1] + 1).astype(np.uint64)
            known, piece = self.known(held)
            active, held = active[known], held[known]
            whole = piece >= 0
            starts.append(active[whole])
            ends.append(active[whole] + size - 1)
            ids.append(piece[whole])
            if size == 1:
                single[active[whole]] = True
        lone = np.flatnonzero(~single)
        starts, ends, ids = (np.concatenate((*held, more)) for held, more in ((starts, lone), (ends, lone), (ids, -1 - code[lone])))
        width = 1 + (code[lone] > 0x7F) + (code[lone] > 0x7FF) + (code[lone] > 0xFFFF)
        weight = np.concatenate((self.log_probability[ids[:len(ids) - len(lone)]], width * np.log(self.byte_probability)))
        level = ends - first[ends]
        # whole keys without ties: the order within a chunk must not depend on the chunks around it
        bits = self.longest.bit_length()
        order = np.argsort(((level * len(code) + ends) << bits) + (ends - starts))
        starts, ends, ids, weight, level = (x[order] for x in (starts, ends, ids, weight, level))
        edges = np.bincount(ends, minlength=len(code))
        mass, part = np.zeros(len(code)), np.empty(len(starts))
        origin = first[starts]
        opens = starts == origin
        before = np.maximum(starts - 1, 0)
        cuts = np.concatenate((np.flatnonzero(np.diff(level, prepend=-1)), [len(level)]))
        for low, high in zip(cuts, cuts[1:]):
            value = weight[low:high] + np.where(opens[low:high], 0.0, mass[before[low:high]])
            bounds = np.flatnonzero(np.diff(ends[low:high], prepend=-1))
            counts = np.diff(np.append(bounds, high - low))
            most = np.maximum.reduceat(value, bounds)
            value = np.exp(value - np.repeat(most, counts))
            total = np.add.reduceat(value, bounds)
            mass[ends[low:high][bounds]] = most + np.log(total)
            part[low:high] = value / np.repeat(total, counts)
        # by end, likely edges first, in steps of 2^-24
        order = np.argsort((((ends << 25) + ((1 - part) * 2**24).astype(np.int64)) << bits) + (ends - starts))
        return length, edges, (starts - origin)[order], ids[order], part[order]

    def expand(self, ids: np.ndarray) -> np.ndarray:
        """Piece ids with characters that have no piece written as bytes."""
        lone = ids < 0
        if not lone.any():
            return ids
        if not (lone & (ids < -128)).any():
            return np.where(lone, self.byte[np.where(lone, -1 - ids, 0)], ids).astype(np.int32)
        out: list[int] = []
        for i in ids.tolist():
            out.extend([i] if i >= 0 else self.byte[list(chr(-1 - i).encode())].tolist())
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of piece ids; inverse of the encoding."""
        text = b"".join(self.raw_array[ids].tolist()).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeds(keys: np.ndarray, number: int, place: np.ndarray) -> np.ndarray:
    """Row keys combined with two counters."""
    with np.errstate(over="ignore"):
        return keys + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)


def uniform_at(seed: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from seeds and a third counter."""
    with np.errstate(over="ignore"):
        x = seed + position.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    return ((_mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform(keys: np.ndarray, number: int, place: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from row keys and three counters."""
    return uniform_at(seeds(keys, number, place), position)


class Numbers(dict):
    """Numbers of keys in order of their first use."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Lattices:
    """Lattices of the chunks a task has met, as flat arrays; emptied when they outgrow a bound.

    The arrays grow by half at a time, so what lies behind ``chunks``, ``ends`` and ``edges`` is unused.
    """

    def __init__(self, words: Vocabulary, most_edges: int = MOST_EDGES):
        self.words, self.most_edges = words, most_edges
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.chunks = self.ends = self.edges = 0
        self.length, self.base, self.edge_end, self.edge_first = (np.zeros(0, np.int64) for _ in range(4))
        self.edge_start, self.edge_id, self.part = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks; those not met yet get their lattices."""
        if self.edges > self.most_edges:
            self.clear()
        held = np.array(list(map(self.index.__getitem__, chunks)), np.int64)
        if new := list(islice(self.index, self.chunks, None)):
            self._add(new)
        return held

    def _append(self, name: str, used: int, more: np.ndarray) -> None:
        held, size = getattr(self, name), used + len(more)
        if size > len(held):
            grown = np.empty(max(size, len(held) * 3 // 2), held.dtype)
            grown[:used] = held[:used]
            setattr(self, name, held := grown)
        held[used:size] = more

    def _add(self, new: list[str]) -> None:
        length, ends, start, ids, part = self.words.lattices(new)
        last = np.cumsum(ends)
        self._append("length", self.chunks, length)
        self._append("base", self.chunks, self.ends + np.cumsum(length) - length)
        self._append("edge_end", self.ends, self.edges + last)
        self._append("edge_first", self.ends, self.edges + last - ends)
        for name, more in (("edge_start", start), ("edge_id", ids), ("part", part)):
            self._append(name, self.edges, more)
        self.chunks, self.ends, self.edges = self.chunks + len(length), self.ends + len(ends), self.edges + len(part)


class Search:
    """Perturbed A* over the lattices of a batch of texts (all with at least one chunk)."""

    def __init__(self, lattices: Lattices, chunks: list[list[str]], keys: np.ndarray):
        self.keys = keys
        # chunks run backwards within a text, as paths are drawn from the end
        self.chunk = lattices.numbers([c for own in chunks for c in own[::-1]])
        counts = np.array([len(own) for own in chunks])
        self.bounds = np.concatenate(([0], np.cumsum(counts)))
        self.text = np.repeat(np.arange(len(chunks)), counts)
        self.place = np.arange(len(self.chunk)) - self.bounds[self.text]
        for name in ("length", "base", "edge_end", "edge_first", "edge_start", "edge_id", "part"):
            setattr(self, name, getattr(lattices, name))

    def edges_into(self, occurrence: int, position: int) -> tuple[int, int]:
        group = int(self.base[self.chunk[occurrence]]) + position - 1
        return int(self.edge_end[group - 1]) if group else 0, int(self.edge_end[group])

    def draw(self, position: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths of all occurrences from their positions: edges, the positions they end at, counts."""
        steps, active, turn = [], np.flatnonzero(position > 0), 0
        at = position[active]
        base = self.base[self.chunk[active]] - 1
        seed = seeds(self.keys[self.text[active]], number, self.place[active])
        counts = np.zeros(len(position), np.int64)
        while len(active):
            group = base + at
            u = uniform_at(seed, at)
            edge = self.edge_first[group]
            # the edge whose share of the mass the number falls into; sums start anew at each end
            other = np.flatnonzero(u >= self.part[edge])
            upto, final = self.part[edge[other]], self.edge_end[group[other]] - 1
            while len(other):
                further = np.flatnonzero(edge[other] < final)
                other, upto, final = other[further], upto[further], final[further]
                edge[other] += 1
                upto += self.part[edge[other]]
                beyond = np.flatnonzero(u[other] >= upto)
                other, upto, final = other[beyond], upto[beyond], final[beyond]
            steps.append((active, edge, at))
            counts[active] += 1
            at = self.edge_start[edge]
            going = np.flatnonzero(at > 0)
            active, at, base, seed, turn = active[going], at[going], base[going], seed[going], turn + 1
        offset = np.cumsum(counts) - counts
        edges, ends = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64)
        for i, (occurrence, edge, end) in enumerate(steps):
            edges[offset[occurrence] + i] = edge
            ends[offset[occurrence] + i] = end
        return edges, ends, counts

    def truncated(self, location: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Gumbels with the given locations, conditioned to lie below a bound; -inf stays."""
        # -log(exp(-below) + exp(log(-log(u)) - location)), without overflow
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            free = location - np.log(-np.log(u))
            value = np.where(free < below - 50, free, below - np.log1p(np.exp(np.minimum(below - free, 60.0))))
        return np.where(np.isneginf(location), NONE, value)

    def top(self, k: int) -> tuple[list[list[dict]], np.ndarray]:
        """For each text its first k paths: edges from the end, log probability, perturbed value.

        Also the value of the path that would come next (-inf: none is left), which needs no drawing.
        """
        n = len(self.keys)
        found: list[list[dict]] = [[] for _ in range(n)]
        ones = np.ones(n, np.int64)
        value = -np.log(-np.log(uniform(self.keys, 0, ones * (1 << 41), ones)))
        position, fixed = self.length[self.chunk], [None] * n
        start = np.zeros(n)
        for number in range(k):
            edges, ends, counts = self.draw(position, number)
            occurrence = np.repeat(np.arange(len(counts)), counts)
            cut = np.searchsorted(occurrence, self.bounds)
            text = self.text[occurrence]
            with np.errstate(divide="ignore"):
                parts, rest = self.part[edges], np.log1p(-np.minimum(self.part[edges], 1.0))
            # sums of each text by itself, so that they don't depend on its neighbours
            logs = np.log(parts)
            before, log_prob = np.empty(len(edges)), start.copy()
            for t in np.flatnonzero(np.diff(cut)):
                running = np.cumsum(logs[cut[t]:cut[t + 1]])
                before[cut[t]] = start[t]
                before[cut[t] + 1:cut[t + 1]] = running[:-1] + start[t]
                log_prob[t] += running[-1]
            u = uniform(self.keys[text], number, self.place[occurrence], ends + (1 << 40))
            following = self.truncated(before + rest, value[text], u)
            for t in np.flatnonzero(~np.isneginf(value)):
                own = slice(cut[t], cut[t + 1])
                path = {"edges": edges[own], "ends": ends[own], "occurrence": occurrence[own], "before": before[own], "next": following[own]}
                if fixed[t] is not None:
                    old, step, edge = fixed[t]
                    for name, kept in (("edges", np.append(old["edges"][:step], edge)), ("ends", old["ends"][:step + 1]), ("occurrence", old["occurrence"][:step + 1]),
                                       ("before", old["before"][:step + 1]), ("next", np.full(step + 1, NONE))):
                        path[name] = np.concatenate((kept, path[name]))
                path["log_prob"], path["value"], path["taken"] = float(log_prob[t]), float(value[t]), {}
                found[t].append(path)
            position = np.zeros(len(self.chunk), np.int64)
            for t in np.flatnonzero(~np.isneginf(value)):
                old = max(found[t], key=lambda p: p["next"].max())
                step = int(old["next"].argmax())
                value[t] = old["next"][step]
                if number + 1 == k or np.isneginf(value[t]):
                    continue
                where, end = int(old["occurrence"][step]), int(old["ends"][step])
                taken = old["taken"].setdefault(step, {int(old["edges"][step])})
                low, high = self.edges_into(where, end)
                others = [e for e in range(low, high) if e not in taken]
                weights = np.cumsum(self.part[others])
                place = self.place[where:where + 1]
                u = uniform(self.keys[t:t + 1], number, place, ones[:1] * end + (2 << 40))
                edge = others[min(int(np.searchsorted(weights, u[0] * weights[-1], side="right")), len(others) - 1)]
                taken.add(edge)
                rest = sum(float(self.part[e]) for e in others if e != edge)
                location = old["before"][step] + np.log(rest) if rest > 0 else NONE
                u = uniform(self.keys[t:t + 1], number, place, ones[:1] * end + (3 << 40))
                old["next"][step] = self.truncated(np.array([location]), value[t], u)[0]
                fixed[t] = (old, step, edge)
                start[t] = old["before"][step] + np.log(self.part[edge])
                position[where + 1:self.bounds[t + 1]] = self.length[self.chunk[where + 1:self.bounds[t + 1]]]
                position[where] = self.edge_start[edge]
        return found, value


def log_inclusion(distance: float) -> float:
    """log(1 - exp(-exp(distance))), also where the score itself is too small for a double."""
    if distance < -30:
        return float(distance)
    return float(np.log(-np.expm1(-np.exp(min(50.0, distance)))))


def chunks_of(text: str) -> list[str]:
    """Chunks of a text with its spaces marked and one in front; an empty text has none."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if SPACE + SPACE in marked or SPACE + "\n" in marked or marked.endswith(SPACE):
        return CHUNK.findall(marked)
    # no runs of marks: every mark opens a chunk
    lines = marked.split("\n")
    out = [SPACE + part for part in lines[0].split(SPACE)[1:]]
    for line in lines[1:]:
        out.append("\n")
        first, *rest = line.split(SPACE)
        if first:
            out.append(first)
        out += [SPACE + part for part in rest]
    return out


def sample_batch(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k tuples of piece ids, log probability, perturbed value, log inclusion.

    A text with at most k segmentations gives all of them, surely included.
    """
    out: list[list] = [[] for _ in texts]
    chunks = [chunks_of(t) for t in texts]
    some = [i for i, own in enumerate(chunks) if own]
    if some:
        search = Search(lattices, [chunks[i] for i in some], keys[some])
        for i, paths, kappa in zip(some, *search.top(k)):
            for path in paths:
                inclusion = 0.0 if np.isneginf(kappa) else log_inclusion(path["log_prob"] - kappa)
                out[i].append((lattices.words.expand(search.edge_id[path["edges"]][::-1]), path["log_prob"], float(path["value"]), inclusion))
    return [own or [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for own in out]


ENCODED = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_sha256 string, round_trip boolean"


def sampled_pieces(
    documents: DataFrame, k: int = SAMPLES, model: str = MODEL, seed: int = 0, with_ids: bool = False, per_row: bool = False
) -> DataFrame:
    """Up to ``k`` distinct segmentations per row, in order of their perturbed value.

    Columns ``doc_id, sample`` (from 1), ``n_pieces, log_prob`` (of the segmentation given the text),
    ``perturbed, log_inclusion`` (logarithm of the
    inclusion score), ``ids_sha256`` (of the little-endian 32-bit ids), ``round_trip`` (decoding
    gives back the text) and, if asked for, ``ids``. With ``per_row`` every row is encoded to one row:
    its first segmentation, and the further ones as structs of the same columns in ``others``.

    Defined cases: null or empty text has one segmentation without pieces; a text with fewer than k
    segmentations gives all it has; the mark U+2581 in a text reads as a space, as in SentencePiece;
    rows repeating a ``doc_id`` draw the same numbers; an empty table gives an empty result; columns
    other than ``doc_id`` and ``text`` are not read.
    """
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in ENCODED.split(", ")] + ["ids"] * with_ids
    types += [pa.list_(pa.int32())] * with_ids
    schema, own_names = ENCODED + ", ids array<int>" * with_ids, names[1:]
    if per_row:
        inner = ", ".join(c.replace(" ", ": ") for c in schema.split(", ")[1:])
        types.append(pa.list_(pa.struct(list(zip(own_names, types[1:])))))
        names, schema = [*names, "others"], f"{schema}, others array<struct<{inner}>>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        lattices = Lattices(words)

        def send(ids: list, texts: list[str]) -> pa.RecordBatch:
            keys = np.array([xxhash.xxh3_64_intdigest(f"{seed}/{'' if i is None else i}") for i in ids], np.uint64)
            rows = []
            for doc_id, text, own in zip(ids, texts, sample_batch(lattices, texts, keys, k)):
                plain = text.replace(SPACE, " ")
                told = []
                for number, (pieces, log_prob, value, included) in enumerate(own, 1):
                    row = (number, len(pieces), round(log_prob, 6), round(value, 6), round(included, 6), hashlib.sha256(pieces.astype("<i4").tobytes()).hexdigest(), words.decode(pieces) == plain)
                    told.append((*row, pieces) if with_ids else row)
                if per_row:
                    rows.append((doc_id, *told[0], [dict(zip(own_names, t)) for t in told[1:]]))
                else:
                    rows += [(doc_id, *t) for t in told]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                if len(texts) == TEXTS or size > CHARS:
                    yield send(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield send(ids, texts)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, schema)
