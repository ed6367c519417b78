"""Queries over documents and embeddings: chunks, collections, retrieval, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.functions import geo, text
from tarnwatch.operators import chunks, facilities, retrieval
from tarnwatch.plans import views
from tarnwatch.plans.registry import query

# Keywords that occur in the invented vocabulary of the documents, in tie-breaking order.
KEYWORDS = {"fr": ["tion", "eau"], "de": ["sch", "ich"], "en": ["the", "ing"]}


@query("SELECT collection, COUNT(*) AS n_documents, CAST(SUM(LENGTH(text)) AS BIGINT) AS n_chars FROM routed GROUP BY collection", ("routed",))
def doc_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.routed_documents(spark, sf_dir).groupBy("collection").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.length("text")).alias("n_chars")
    )


@query("SELECT doc_id, REPLACE(source, '.', '_') || printf('_%04d', chunk_index) AS chunk_id, chunk_index, md5(chunk) AS digest, LENGTH(chunk) AS n_chars FROM chunks", ("chunks",))
def doc_chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = chunks.fixed_chunks(documents)
    return rows.select(
        "doc_id", text.chunk_id(F.col("source"), F.col("chunk_index")).alias("chunk_id"), "chunk_index",
        F.md5("chunk").alias("digest"), F.length("chunk").cast("long").alias("n_chars"),
    )


@query()
def doc_chunks_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return chunks.describe_chunks(chunks.recursive_chunks(documents))


_SCORES = {
    region: " + ".join(f"CAST(contains(LOWER(text), '{word}') AS INTEGER)" for word in words)
    for region, words in KEYWORDS.items()
}


@query(f"""
SELECT doc_id, CASE WHEN GREATEST(fr, de, en) = 0 THEN 'global' WHEN fr >= de AND fr >= en THEN 'fr' WHEN de >= en THEN 'de' ELSE 'en' END AS region
FROM (SELECT doc_id, {', '.join(f'{s} AS {r}' for r, s in _SCORES.items())} FROM documents) d""")
def region_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.infer_region(F.col("text"), KEYWORDS).alias("region"))


@query("""
SELECT collection, chunk_id, version, md5(chunk) AS digest FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY version DESC) AS rn FROM (
    SELECT collection, source || '_' || doc_id || printf('_%04d', chunk_index) AS chunk_id, version, CASE version WHEN 1 THEN 'revised: ' || chunk ELSE chunk END AS chunk
    FROM (SELECT c.*, r.collection FROM chunks c JOIN routed r USING (doc_id)) x
    JOIN (SELECT doc_id AS d, 0 AS version FROM documents UNION ALL SELECT doc_id, 1 FROM labels WHERE quality = 1) v ON v.d = x.doc_id) u) t
WHERE rn = 1""", ("chunks", "routed"))
def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks overwritten by the revised chunks of well-rated documents."""
    rows = chunks.fixed_chunks(views.routed_documents(spark, sf_dir))
    file_name = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    rows = rows.select(
        "doc_id", "collection", text.chunk_id(file_name, F.col("chunk_index")).alias("chunk_id"), "chunk"
    )
    good = views.table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    revised = rows.join(good, "doc_id", "left_semi").withColumn("chunk", F.concat(F.lit("revised: "), "chunk"))
    merged = chunks.upsert_latest(
        rows.withColumn("version", F.lit(0)), revised.withColumn("version", F.lit(1)), "chunk_id", "version"
    )
    return merged.select("collection", "chunk_id", "version", F.md5("chunk").alias("digest"))


_MEANS = """
, q AS (SELECT {keys}, list(m ORDER BY i) AS qv FROM (
  SELECT {keys}, i, AVG(v) AS m FROM (SELECT {source}, UNNEST(embedding) AS v, UNNEST(range(1, len(embedding) + 1)) AS i FROM vectors) e GROUP BY {keys}, i) a GROUP BY {keys}),
hits AS (SELECT * FROM (
  SELECT {qkeys}, c.collection, c.doc_id, 1e0 - list_cosine_similarity(q.qv, c.embedding) AS distance,
    ROW_NUMBER() OVER (PARTITION BY {qkeys}, c.collection ORDER BY 1e0 - list_cosine_similarity(q.qv, c.embedding), c.doc_id) AS rank
  FROM q CROSS JOIN vectors c) h WHERE rank <= 3)"""


@query(_MEANS.format(keys="label", source="label", qkeys="q.label") + """
SELECT label, collection, doc_id, CAST(rank AS INTEGER) AS rank, ROUND(distance, 6) AS distance FROM hits""", ("vectors",))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors closest to the mean of each label, per collection."""
    corpus = views.vectors(spark, sf_dir)
    hits = retrieval.vector_topk(views.mean_vectors(corpus, "label"), corpus, query_id=("label",))
    return hits.select("label", "collection", "doc_id", "rank", F.round("distance", 6).alias("distance"))


@query(_MEANS.format(keys="label, query_no", source="label, CAST(doc_id % 4 AS INTEGER) AS query_no", qkeys="q.label, q.query_no") + """
SELECT event_id, n_documents, SUBSTRING(joined, 1, 8000) AS context FROM (
  SELECT event_id, COUNT(*) AS n_documents, string_agg(text, chr(10) || '---' || chr(10) ORDER BY position) AS joined FROM (
    SELECT h.label AS event_id, d.text, MIN((h.query_no * 3 + h.collection) * 3 + h.rank) AS position FROM hits h JOIN documents d ON d.doc_id = h.doc_id
    WHERE d.text <> '' GROUP BY h.label, d.text) u GROUP BY event_id) j""", ("vectors",))
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four queries per event against three collections, merged into one context."""
    corpus = views.vectors(spark, sf_dir)
    numbered = corpus.withColumn("query_no", (F.col("doc_id") % 4).cast("int"))
    hits = retrieval.vector_topk(
        views.mean_vectors(numbered, "label", "query_no"), corpus, query_id=("label", "query_no")
    )
    position = (F.col("query_no") * 3 + F.col("collection")) * 3 + F.col("rank")
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits.select(F.col("label").alias("event_id"), "doc_id", position.alias("position")).join(documents, "doc_id")
    return retrieval.context(retrieval.unique_documents(found))


@query("""
SELECT event_id, CAST(n AS INTEGER) AS query_no, CASE n WHEN 0 THEN 'pollution sources near ' || CAST(lat AS VARCHAR) || ', ' || CAST(lon AS VARCHAR) || ' water contamination'
  WHEN 1 THEN 'agricultural runoff nutrient loading ' || weather_context || ' chlorophyll ' || strftime(date, '%Y-%m-%d')
  WHEN 2 THEN 'industrial discharge permits violations near ' || region_id ELSE 'watershed downstream communities drinking water intake ' || region_id END AS query
FROM anomaly_events CROSS JOIN (SELECT UNNEST(range(0, 4)) AS n) k""", ("anomaly_events",))
def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieval_queries(views.anomaly_events(spark, sf_dir))


@query()
def text_embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks closest to the mean text vector of each language, per collection."""
    documents = views.routed_documents(spark, sf_dir)
    languages = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    embedded = retrieval.text_embeddings(documents.join(languages, "doc_id"), "text")
    hits = retrieval.vector_topk(views.mean_vectors(embedded, "lang"), embedded, query_id=("lang",))
    return hits.select("lang", "collection", "doc_id", "rank", "distance")


@query()
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all events with their facilities and the context of their group."""
    events = views.anomaly_events(spark, sf_dir).withColumn(
        "location_name", geo.location_label(F.col("lat"), F.col("lon"))
    )
    near = facilities.nearest_facilities(events, views.facility_elements(spark, sf_dir))
    corpus = views.vectors(spark, sf_dir)
    topics = corpus.select("label").distinct()
    contexts = retrieval_context(spark, sf_dir).withColumnRenamed("event_id", "label")
    count = topics.count()
    linked = events.select("event_id", F.pmod("event_id", F.lit(count)).cast("int").alias("label"))
    return retrieval.render_prompts(
        events, facilities.facility_lines(near), linked.join(contexts, "label").select("event_id", "context")
    )
