"""Splitting documents into chunks, and the document tables around them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.functions.text import REGION_KEYWORDS, chunk_id, infer_region
from tarnwatch.operators.nearby import rank_within

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
# Separators from coarse to fine; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")

# Document type and collection by file stem.
ROUTES = {
    "epa_permits": ("permits", "permits"),
    "who_guidelines": ("guidelines", "permits"),
    "agricultural_zones": ("agriculture", "agriculture"),
    "watershed_maps": ("watershed", "watershed"),
    "historical_incidents": ("incidents", "watershed"),
}


def route_documents(documents: DataFrame, routes: DataFrame) -> DataFrame:
    """Attach document type and collection; documents of unknown source are skipped."""
    return documents.join(routes, "source")


def fixed_chunks(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap`` characters, over the whole text."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(stride))
    cut = F.transform(starts, lambda start: F.substring(F.col("text"), start + 1, F.lit(size)))
    return documents.where(F.length("text") > 0).select("*", F.posexplode(cut).alias("chunk_index", "chunk"))


def _cut(text: str, mark: str) -> list[str]:
    """Cut before every occurrence of ``mark``, so a part keeps the separator it begins with."""
    if not mark:
        return list(text)
    head, *rest = text.split(mark)
    return [part for part in [head, *(mark + r for r in rest)] if part]


def _pack(parts: Iterable[str], size: int, overlap: int) -> list[str]:
    """Join parts greedily; a new chunk begins with the last parts of the one before it.

    As many are repeated as fit into ``overlap`` characters and leave room for the next part.
    """
    chunks: list[str] = []
    held: deque[str] = deque()
    length = 0
    for part in parts:
        if held and length + len(part) > size:
            chunks.append("".join(held).strip())
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.popleft())
        held.append(part)
        length += len(part)
    chunks.append("".join(held).strip())
    return [chunk for chunk in chunks if chunk]


def split_recursive(
    text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS
) -> list[str]:
    """Chunks of at most ``size`` characters cut at natural breaks.

    The text is cut at the coarsest separator it contains. Runs of small parts are packed into
    chunks; a part that is still too long is split on its own, at finer separators.
    """
    level = next(i for i, mark in enumerate(separators) if mark in text)
    chunks: list[str] = []
    for small, run in groupby(_cut(text, separators[level]), key=lambda part: len(part) < size):
        if small:
            chunks += _pack(run, size, overlap)
        else:
            for part in run:
                chunks += split_recursive(part, size, overlap, separators[level + 1 :])
    return chunks


def recursive_chunks(
    documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, keep: tuple[str, ...] = ("doc_id", "source")
) -> DataFrame:
    """One row per chunk of each document, with its index."""
    kept = documents.select(*keep, "text")
    schema = T.StructType(
        [*kept.select(*keep).schema.fields, T.StructField("chunk_index", T.IntegerType()),
         T.StructField("chunk", T.StringType())]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            rows, indexes, chunks = [], [], []
            for row, text in enumerate(texts.to_pylist()):
                for index, chunk in enumerate(split_recursive(text or "", size, overlap)):
                    rows.append(row)
                    indexes.append(index)
                    chunks.append(chunk)
            take = pa.array(rows, pa.int64())
            columns = [batch.column(batch.schema.get_field_index(c)).take(take) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(indexes, pa.int32()), pa.array(chunks, pa.string())],
                names=schema.fieldNames(),
            )

    return kept.mapInArrow(split, schema)


def describe_chunks(chunks: DataFrame, regions: dict[str, list[str]] = REGION_KEYWORDS) -> DataFrame:
    """Add the chunk id and the region inferred from the chunk's words."""
    return chunks.withColumns(
        {
            "chunk_id": chunk_id(F.col("source"), F.col("chunk_index")),
            "region": infer_region(F.col("chunk"), regions),
        }
    )


def upsert_latest(stored: DataFrame, incoming: DataFrame, key: str, version: str, *ties: Column | str) -> DataFrame:
    """Union of both tables with the highest version of each key.

    The ranked filter is applied before the shuffle too, so repeated versions of one key collapse
    on the map side.
    """
    newest = rank_within([key], F.desc(version), *ties)
    return (
        stored.unionByName(incoming)
        .withColumn("_newest", newest)
        .where(F.col("_newest") == 1)
        .drop("_newest")
    )


def collection_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"))
