"""Elements of the large arrays of JSON responses, read by many tasks.

A response is an object with one long array of objects (features, products, map elements). A plain
JSON reader gives such a file to one task. Here the text reader cuts files by byte range at closing
braces, whatever they mean, and what they mean follows from counts that add up:

1. Pieces are joined to chunks of about a megabyte. For each chunk, both for a start inside and
   outside of a string: whether its quotes toggle that, and by how much braces and brackets nest.
2. Running sums over the chunks of a file, one small row each, give every chunk its true start.
3. Each chunk then names its complete elements and the parts of elements that reach beyond it, and
   numbers them relative to its start; running sums of these numbers make them absolute. Parts of
   one element are put together, whatever number of chunks it covers.

Any store that Spark can read will do, since no file is opened here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.session import stage

CHUNK_BYTES = 1 << 20
PLACE = "path string, block long, no int"
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)


def _quotes(data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that open or close a string: not escaped by an odd run of backslashes."""
    quotes = data == 34
    slashes = data == 92
    if slashes.any():
        places = np.arange(len(data))
        other = np.maximum.accumulate(np.where(slashes, -1, places))
        run = places - 1 - np.concatenate(([-1], other[:-1]))
        quotes &= run % 2 == 0
    return quotes


def _nesting(data: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps of brace and bracket nesting at every byte, if the text starts inside a string or not."""
    outside = (np.cumsum(_quotes(data)) + inside) % 2 == 0
    braces = ((data == 123).astype(np.int8) - (data == 125)) * outside
    brackets = ((data == 91).astype(np.int8) - (data == 93)) * outside
    return braces, brackets


def _chunks(size: int):
    names = ["path", "block", "no", "data", "toggles", "braces0", "brackets0", "braces1", "brackets1"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_size, place, no = [], 0, None, 0

        def sent() -> pa.RecordBatch:
            text = b"}".join(held) + b"}"
            data = np.frombuffer(text, np.uint8)
            sums = [int(step.sum(dtype=np.int64)) for inside in (0, 1) for step in _nesting(data, inside)]
            row = [*place, no, text, int(_quotes(data).sum()) % 2, *sums]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 5]
        for batch in batches:
            for path, block, value in zip(*(batch.column(i) for i in range(3))):
                at = path.as_py(), block.as_py()
                if at != place or held_size >= size:
                    if held:
                        yield sent()
                    no = no + 1 if at == place else 0
                    held, held_size, place = [], 0, at
                held.append(value.as_buffer().to_pybytes())
                held_size += len(held[-1]) + 1
        if held:
            yield sent()

    return chunks


#: What a chunk holds: a whole object of the second level, a part of one (turn 1 if it begins there),
#: the start of an array (with its key), text outside of these objects, or its counts of arrays,
#: objects and documents that begin or end in it.
PARTS = f"{PLACE}, kind string, turn int, array long, element long, document long, text string"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARTS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for row in batch.to_pylist():
            rows = _parts_of(row["data"], row["inside"], row["brace"], row["bracket"])
            columns = [[row[c]] * len(rows) for c in ("path", "block", "no")] + list(map(list, zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _parts_of(text: bytes, inside: int, brace: int, bracket: int) -> list[tuple]:
    """The parts of one chunk that starts inside a string or not, at a nesting of braces and brackets."""
    data = np.frombuffer(text, np.uint8)
    braces, brackets = _nesting(data, inside)
    depth, level = brace + np.cumsum(braces, dtype=np.int64), bracket + np.cumsum(brackets, dtype=np.int64)
    opens = np.flatnonzero((braces == 1) & (depth == 2))
    closes = np.flatnonzero((braces == -1) & (depth == 1)) + 1
    starts = np.flatnonzero((brackets == 1) & (depth == 1) & (level == 1))
    ends = np.flatnonzero((braces == -1) & (depth == 0)) + 1
    out: list[tuple] = []
    # text outside of objects, and of an array no more than its brackets; members keep their braces
    rest = (depth <= 1) & ~((depth == 1) & (level >= 1) & ~((brackets == 1) & (level == 1)))
    rest[closes - 1] = level[closes - 1] == 0
    rest[opens] = level[opens] == 0

    def put(kind: str, turn: int, at: int, element: int, what: bytes | None) -> None:
        out.append((kind, turn, int(np.searchsorted(starts, at, "right")), element, int(np.searchsorted(ends, at, "right")), what and what.decode()))

    done = 0
    if brace >= 2:
        put("part", 0, 0, 0, text[:closes[0]] if len(closes) else text)
        done = min(1, len(closes))
    for i, start in enumerate(opens):
        whole = done < len(closes)
        stop = int(closes[done]) if whole else len(text)
        if level[start] == 1:
            put("whole" if whole else "part", 1, int(start), done, text[int(start):stop])
        done += whole
    for start in starts:
        key = KEY.search(text[max(0, int(start) - 4096):int(start)])
        put("array", 0, int(start), 0, key.group(1) if key else None)
    cuts = [0, *ends.tolist(), len(text)]
    for turn, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if (outer := data[a:b][rest[a:b]].tobytes()).strip():
            out.append(("rest", turn, 0, 0, turn, outer.decode()))
    out.append(("count", 0, len(starts), len(closes), len(ends), None))
    return out


def read_array(
    spark: SparkSession, path: str, array: str, element: T.DataType | str, outer: T.StructType | str | None = None, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per object of the array ``array`` of every response: ``outer.*`` and ``element``.

    Responses are JSON objects, one or several in a file, on any number of lines; the array is one of
    their own members. ``outer`` has scalar members that every element of the response repeats.

    Defined cases: a response without the array, or with an empty or null one, has no rows; values in
    the array that are not objects are left out; an element that doesn't fit its schema has nulls, as
    with any JSON reader. Keys of arrays are compared as they are written.
    """
    place = ["path", "block", "no"]
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    counts = ", ".join(f"{c} long" for c in ("toggles", "braces0", "brackets0", "braces1", "brackets1"))
    chunks = stage(pieces.mapInArrow(_chunks(chunk_bytes), f"{PLACE}, data binary, {counts}"), "json-chunks")
    before = Window.partitionBy("path").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column) -> F.Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    inside = chunks.drop("data").withColumn("inside", so_far("toggles") % 2)
    steps = inside.select(*place, "inside", *(F.when(F.col("inside") == 1, F.col(f"{n}1")).otherwise(F.col(f"{n}0")).alias(n) for n in ("braces", "brackets")))
    states = steps.select(*place, "inside", so_far("braces").alias("brace"), so_far("brackets").alias("bracket"))
    parts = stage(chunks.select(*place, "data").join(states, place).mapInArrow(_parts, PARTS), "json-parts")
    numbers = ("array", "element", "document")
    offsets = parts.where("kind = 'count'").select(*place, *(so_far(n).alias(f"{n}s") for n in numbers))
    placed = parts.where("kind <> 'count'").join(offsets, place).withColumns({n: F.col(n) + F.col(f"{n}s") for n in numbers})

    def joined(rows: DataFrame, *key: str) -> DataFrame:
        """Texts of a key put together in order, with the array in which the first of them begins."""
        return rows.groupBy("path", *key).agg(
            F.max(F.when(F.col("turn") == 1, F.col("array"))).alias("array"),
            F.array_join(F.expr("transform(array_sort(collect_list(struct(block, no, turn, text))), part -> part.text)"), "").alias("text"),
        )

    arrays = placed.where((F.col("kind") == "array") & (F.col("text") == array)).select("path", "array", "document")
    whole = placed.where("kind = 'whole'").select("path", "array", "text")
    cut = joined(placed.where("kind = 'part'"), "element").where("array IS NOT NULL").select("path", "array", "text")
    elements = whole.unionByName(cut).join(arrays, ["path", "array"])
    parsed = F.from_json("text", element).alias("element")
    if outer is None:
        return elements.select(parsed)
    rest = joined(placed.where("kind = 'rest'"), "document").select("path", "document", F.from_json("text", outer).alias("outer"))
    return elements.join(rest, ["path", "document"], "left").select("outer.*", parsed)
