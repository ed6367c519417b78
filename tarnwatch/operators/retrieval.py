"""Vector retrieval over document collections, and the context and prompt built from it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, IDF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tarnwatch.functions.geo import number_text
from tarnwatch.operators.nearby import rank_within
from tarnwatch.session import stage

TOP_K = 3
CONTEXT_CHARS = 8000
SEPARATOR = "\n---\n"
# Query sets up to this size are shared with every task; larger ones are scored in blocks.
QUERY_BYTES = 64 << 20
DOCUMENTS_PER_BLOCK = 100_000
# Distances a task holds at once: queries and documents are multiplied in tiles of this many cells.
TILE_CELLS, TILE_QUERIES = 1 << 22, 4096


def retrieval_queries(events: DataFrame) -> DataFrame:
    """Four query texts per event, for four angles of attribution."""
    where = F.concat(number_text(F.col("lat")), F.lit(", "), number_text(F.col("lon")))
    region = F.replace(F.col("region_id").cast("string"), F.lit("_"), F.lit(" "))
    texts = F.array(
        F.concat(F.lit("pollution sources near "), where, F.lit(" water contamination")),
        F.concat(
            F.lit("agricultural runoff nutrient loading "), F.col("weather_context"),
            F.lit(" chlorophyll "), F.date_format("date", "yyyy-MM-dd"),
        ),
        F.concat(F.lit("industrial discharge permits violations near "), region),
        F.concat(F.lit("watershed downstream communities drinking water intake "), region),
    )
    return events.select("event_id", F.posexplode(texts).alias("query_no", "query"))


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two arrays, as a column expression for single pairs."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    query_id: Sequence[str] = ("query_id",),
    per: str = "collection",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``k`` documents closest to each query in each collection, by cosine distance.

    Exact: every document is scored. Tasks multiply their documents with a matrix of queries and
    emit only their own ``k`` best per query and collection, so pairs are never materialised; a
    ranked filter merges the task results. The product is made in tiles of fixed size, so a task's
    memory does not depend on how many queries or documents meet in it. A query set of at most ``query_bytes`` is shared with
    all tasks. A larger one never leaves the executors: queries and documents are cut into blocks
    and every pair of blocks is scored on its own.
    """
    prepared = stage(
        queries.where(F.col("embedding").isNotNull()).select(*query_id, F.col("embedding").cast("array<double>")),
        "retrieval-queries",
    )
    documents = corpus.where(F.col("embedding").isNotNull()).select(
        "doc_id", per, F.col("embedding").cast("array<double>")
    )
    first = prepared.select(F.size("embedding").alias("width")).first()
    shared = max(1, query_bytes // (8 * (first["width"] if first else 1)))
    table = prepared.limit(shared + 1).toArrow()
    id_fields = [f for f in prepared.schema.fields if f.name in query_id]
    schema = T.StructType(
        [*id_fields, documents.schema[per], documents.schema["doc_id"], T.StructField("distance", T.DoubleType())]
    )
    score = _block_scorer(schema, [f.name for f in id_fields], per, k)
    if table.num_rows <= shared:
        best = _score_shared(table, documents, schema, score)
    else:
        best = _score_blocks(prepared, documents, schema, score, shared)
    ranked = best.withColumn("rank", rank_within([*query_id, per], "distance", "doc_id"))
    return ranked.where(F.col("rank") <= k)


def _block_scorer(schema: T.StructType, ids: list[str], per: str, k: int):
    """Function of a query table and document batches giving the ``k`` best per query and group."""
    arrow_types = [to_arrow_type(f.dataType) for f in schema.fields]

    def score(queries: pa.Table, batches: Iterable[pa.RecordBatch | pa.Table]) -> pa.Table:
        vectors = _unit(_matrix(queries["embedding"]))
        held: dict = {}
        for batch in batches:
            if batch.num_rows == 0 or len(vectors) == 0:
                continue
            doc = np.array(batch.column("doc_id").to_pylist(), dtype=object)
            group = pd.Series(batch.column(per).to_pylist())
            units = _unit(_matrix(batch.column("embedding")))
            members = group.groupby(group, sort=False).indices.items()
            for first in range(0, len(vectors), TILE_QUERIES):
                tile = vectors[first:first + TILE_QUERIES].T
                rows_per_tile = max(1, TILE_CELLS // tile.shape[1])
                for name, all_rows in members:
                    for start in range(0, len(all_rows), rows_per_tile):
                        rows = all_rows[start:start + rows_per_tile]
                        values = 1.0 - units[rows] @ tile
                        names = np.broadcast_to(doc[rows][:, None], values.shape)
                        if (name, first) in held:
                            names = np.concatenate([names, held[name, first][0]])
                            values = np.concatenate([values, held[name, first][1]])
                        held[name, first] = _smallest(names, values, k)
        pieces = [pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, arrow_types)})]
        for (name, first), (names, values) in held.items():
            columns = np.tile(np.arange(first, first + values.shape[1]), len(values))
            taken = queries.select(ids).take(pa.array(columns))
            found = [pa.array([name] * len(columns)), pa.array(names.ravel().tolist()), pa.array(values.ravel())]
            arrays = [*(taken[c].combine_chunks() for c in ids), *found]
            pieces.append(pa.table([a.cast(t) for a, t in zip(arrays, arrow_types)], names=schema.fieldNames()))
        return pa.concat_tables(pieces)

    return score


def _score_shared(table: pa.Table, documents: DataFrame, schema: T.StructType, score) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from score(shared.value, batches).to_batches()

    return documents.mapInArrow(run, schema)


def _score_blocks(
    queries: DataFrame, documents: DataFrame, schema: T.StructType, score, per_block: int
) -> DataFrame:
    """Every block of queries against every block of documents, co-grouped."""
    n_query = -(-queries.count() // per_block)
    n_document = -(-documents.count() // DOCUMENTS_PER_BLOCK)

    def blocks(df: DataFrame, own: str, count: int, other: str, copies: int, *identity: str) -> DataFrame:
        numbered = df.withColumn(own, F.pmod(F.xxhash64(*identity), F.lit(count)).cast("int"))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(copies, 1) - 1))))

    ids = [c for c in queries.columns if c != "embedding"]
    left = blocks(queries, "_q", n_query, "_d", n_document, *ids)
    right = blocks(documents, "_d", max(n_document, 1), "_q", n_query, "doc_id")
    pair = ["_q", "_d"]

    def run(query_block: pa.Table, document_block: pa.Table) -> pa.Table:
        return score(query_block, [document_block])

    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(run, schema)


def _smallest(names: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` smallest entries of each column; equal values keep the smaller name."""
    if len(values) <= k:
        return names, values
    cut = np.partition(values, k - 1, axis=0)[k - 1]
    tied = (values <= cut).sum(axis=0)
    order = np.argpartition(values, k - 1, axis=0)[:k]
    top_names = np.take_along_axis(names, order, axis=0)
    top_values = np.take_along_axis(values, order, axis=0)
    for column in np.nonzero(tied > k)[0]:
        rows = np.nonzero(values[:, column] <= cut[column])[0]
        best = sorted(rows, key=lambda r: (values[r, column], names[r, column]))[:k]
        top_names[:, column], top_values[:, column] = names[best, column], values[best, column]
    return top_names, top_values


def text_embeddings(texts: DataFrame, column: str, width: int = 256) -> DataFrame:
    """Add ``embedding``: unit-length TF-IDF over hashed words, without a model download."""
    words = Tokenizer(inputCol=column, outputCol="_words").transform(texts)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width).transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counts).transform(counts)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit").transform(weighted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
        "_words", "_tf", "_tfidf", "_unit"
    )


def unique_documents(hits: DataFrame) -> DataFrame:
    """Retrieved texts of an event without repeats, in order of first appearance.

    ``hits`` has ``event_id, position, text``; an event has at most queries x collections x k hits.
    """
    return hits.where(F.col("text") != "").groupBy("event_id", "text").agg(F.min("position").alias("position"))


def context(unique: DataFrame, limit: int = CONTEXT_CHARS) -> DataFrame:
    """The texts of each event joined in order and cut to the size of the prompt's context."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    joined = F.array_join(F.transform(ordered, lambda d: d["text"]), SEPARATOR)
    return unique.groupBy("event_id").agg(
        F.substring(joined, 1, limit).alias("context"), F.count(F.lit(1)).alias("n_documents")
    )


PROMPT = """Write a community water quality report for the anomaly below as JSON.

Event
  region: {region_id}
  place: {location_name}
  date: {date}
  coordinates: {lat}, {lon}
  severity: {severity}
  chlorophyll-a: {chl_a_value} mg/m³, baseline {chl_a_baseline}
  z-score: {z_score}
  weather: {weather_context}

Mapped facilities nearby (real places; name no others)
{facilities}

Background documents
{context}

Fields: alert_level, alert_summary, probable_sources, drinking_water_impact, recommended_actions,
historical_context. Answer with the JSON object only."""

NO_FACILITIES = "(No nearby facilities found in OpenStreetMap data)"


def render_prompts(events: DataFrame, facility_texts: DataFrame, contexts: DataFrame, template: str = PROMPT) -> DataFrame:
    """The prompt text of each event, from its facility list and retrieved context."""
    values = {
        "region_id": F.col("region_id").cast("string"),
        "location_name": F.col("location_name"),
        "date": F.date_format("date", "yyyy-MM-dd"),
        "lat": number_text(F.col("lat")),
        "lon": number_text(F.col("lon")),
        "severity": F.col("severity"),
        "chl_a_value": number_text(F.col("chl_a_value")),
        "chl_a_baseline": number_text(F.col("chl_a_baseline")),
        "z_score": number_text(F.bround("z_score", 2)),
        "weather_context": F.col("weather_context"),
        "facilities": F.coalesce("facilities_text", F.lit(NO_FACILITIES)),
        "context": F.coalesce("context", F.lit("")),
    }
    parts = []
    for piece in template.split("{"):
        name, closing, rest = piece.partition("}")
        if closing:
            parts += [F.coalesce(values[name], F.lit("")), F.lit(rest)]
        else:
            parts.append(F.lit(piece))
    return (
        events.join(facility_texts, "event_id", "left")
        .join(contexts, "event_id", "left")
        .select("event_id", F.concat(*parts).alias("prompt"))
    )
