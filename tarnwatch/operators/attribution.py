"""Attribution from events to nested reports: search, context, prompt, model and enrichment.

Embedding and language models are hooks: a factory without arguments that returns a function of a
list of texts. The factory is called once per Python worker, the function once per batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.operators import modeloutput, retrieval
from tarnwatch.operators.facilities import facility_lines
from tarnwatch.operators.nearby import rank_within
from tarnwatch.operators.report import COLLECTIONS, match_source_coordinates
from tarnwatch.session import stage
from tarnwatch.sources.buckets import BucketStore, upsert

#: Gives vectors (texts x width) for texts.
Embedder = Callable[[], Callable[[list[str]], np.ndarray]]
#: Gives raw answers for prompts.
Model = Callable[[], Callable[[list[str]], Sequence[str]]]

_LOADED: dict[str, Callable] = {}
EMBEDDING = "digest string, embedding array<double>, ordinal long"
#: Texts a hook is given at once.
BATCH = 64


def _hooked(factory: Callable, arrow: pa.DataType, column: str, name: str):
    """Batches of (key, text) to (key, what the hook says of the text)."""
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tarnwatch.operators import attribution

        if token not in attribution._LOADED:  # kept as long as the worker lives
            attribution._LOADED.clear()
            attribution._LOADED[token] = factory()
        hook = attribution._LOADED[token]
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                part = batch.slice(first, BATCH)
                said = [v.tolist() if isinstance(v, np.ndarray) else v for v in hook([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, arrow)], [column, name])

    return run


def embedded(texts: DataFrame, key: str, column: str, embedder: Embedder) -> DataFrame:
    """``key`` and the ``embedding`` of every text."""
    rows = texts.select(key, column)
    field = T.StructField("embedding", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(_hooked(embedder, pa.list_(pa.float64()), key, "embedding"), T.StructType([rows.schema[key], field]))


def digest(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def open_embeddings(spark, path: str, buckets: int = 64) -> BucketStore:
    """Embeddings by the digest of their text; the store belongs to one embedder."""
    return BucketStore(spark, path, T.StructType.fromDDL(EMBEDDING), buckets, cluster=("digest",))


def embed_changed(chunks: DataFrame, store: BucketStore, embedder: Embedder, column: str = "chunk") -> DataFrame:
    """``chunks`` with ``digest`` and ``embedding``; only texts the store doesn't know are embedded.

    Texts are compared by digest, so a chunk that moved, or occurs again, isn't embedded again either.
    A null text has neither digest nor embedding.
    """
    named = stage(chunks.withColumn("digest", digest(F.col(column))), "named-chunks")
    known = store.read().select("digest")
    fresh = named.where("digest IS NOT NULL").select("digest", column).join(known, "digest", "left_anti").groupBy("digest").agg(F.any_value(column).alias(column))
    new = stage(embedded(fresh, "digest", column, embedder), "new-embeddings")
    upsert(store, new.withColumn("ordinal", F.lit(0).cast("long")), ("digest",), "ordinal")
    return named.join(store.read().select("digest", "embedding"), "digest", "left")


def _in_order(rows: DataFrame, column: str) -> F.Column:
    """A column of text or whole numbers as texts of the same order; null comes first."""
    value = F.col(column)
    if not isinstance(rows.schema[column].dataType, T.StringType):
        value = F.lpad((value.cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0")
    return F.coalesce(value, F.lit(""))


def search(events: DataFrame, corpus: DataFrame, embedder: Embedder, k: int = retrieval.TOP_K) -> DataFrame:
    """The retrieval queries of all events against ``corpus`` (``doc_id, collection, digest, embedding``, with ``n_chars``).

    One row per hit: ``event_id, position, digest, n_chars``; positions follow the order of queries,
    collections and ranks.

    Exact, as :func:`retrieval.vector_topk`: queries that ask for the same vector are searched once,
    and so are documents of one text. At most ``k`` of these, the first by id, can be among the best.
    """
    queries = stage(retrieval.retrieval_queries(events).select("event_id", "query_no", "query", digest(F.col("query")).alias("digest")), "attribution-queries")
    vectors = stage(embedded(queries.select("digest", "query").distinct(), "digest", "query", embedder), "query-vectors")
    searched = vectors.where(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min("digest").alias("vector"))
    searched = stage(searched, "searched-vectors")
    asked = queries.select("event_id", "query_no", "digest").join(vectors, "digest").join(searched, "embedding").select("event_id", "query_no", "vector")

    own = ["collection", "digest"]
    known = corpus.where(F.col("embedding").isNotNull()).select("doc_id", *own, "n_chars", "embedding")
    copies = stage(known.withColumn("copy", rank_within(own, "doc_id")).where(F.col("copy") <= k), "searched-texts")
    # a text goes by the id of its first copy, which decides between equal distances, and its digest
    named = F.concat(_in_order(copies, "doc_id"), F.lit("\0"), F.col("digest")).alias("doc_id")
    best = retrieval.vector_topk(searched, copies.where("copy = 1").select(named, "collection", "embedding"), k, ("vector",))
    found = best.select("vector", "collection", "distance", F.substring_index("doc_id", "\0", -1).alias("digest"))
    all_copies = found.join(copies.select(*own, "doc_id", "n_chars"), own)
    hits = all_copies.withColumn("rank", rank_within(["vector", "collection"], "distance", "doc_id")).where(F.col("rank") <= k).drop("rank")
    # rows that repeat an event's id share its ranks
    ranked = asked.join(hits, "vector").withColumn("rank", rank_within(["event_id", "query_no", "collection"], "distance", "doc_id")).where(F.col("rank") <= k)
    order = F.array_position(F.array(*map(F.lit, COLLECTIONS)), F.col("collection")) - 1
    position = ((F.col("query_no") * len(COLLECTIONS) + order) * k + F.col("rank")).cast("int")
    return ranked.withColumn("position", position).select("event_id", "position", "digest", "n_chars")


def budgeted_context(hits: DataFrame, texts: DataFrame, limit: int = retrieval.CONTEXT_CHARS) -> DataFrame:
    """The texts of each event joined in order of first appearance and cut to ``limit`` characters.

    ``hits`` has ``event_id, position, digest, n_chars``, ``texts`` one text per digest. Which texts
    fit is decided on digests and lengths; only those are fetched, each cut to what is left for it.
    Empty texts are left out. ``n_documents`` counts all of them.
    """
    unique = hits.where("n_chars > 0").groupBy("event_id", "digest").agg(F.min("position").alias("position"), F.max("n_chars").alias("n_chars"))
    # an event has at most queries x collections x k hits
    along = Window.partitionBy("event_id").orderBy("position")
    gap = len(retrieval.SEPARATOR)
    before = F.coalesce(F.sum(F.col("n_chars") + gap).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = unique.withColumn("begin", before).withColumn("n_documents", F.count(F.lit(1)).over(Window.partitionBy("event_id")))
    fitting = placed.where(F.col("begin") < limit)
    fetched = fitting.join(texts.select("digest", "text"), "digest").withColumn("text", F.expr(f"substring(text, 1, cast({limit} - begin as int))"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    joined = F.array_join(F.transform(ordered, lambda d: d["text"]), retrieval.SEPARATOR)
    return fetched.groupBy("event_id").agg(F.substring(joined, 1, limit).alias("context"), F.max("n_documents").alias("n_documents"))


def answered(prompts: DataFrame, model: Model) -> DataFrame:
    """``event_id`` and the model's ``raw`` answer to its prompt."""
    rows = prompts.select("event_id", "prompt")
    return rows.mapInArrow(_hooked(model, pa.string(), "event_id", "raw"), T.StructType([rows.schema["event_id"], T.StructField("raw", T.StringType())]))


def enrich_reports(reports: DataFrame, facilities: DataFrame, events: DataFrame) -> DataFrame:
    """Parsed reports (``event_id, report``) with coordinates of named facilities and what was found.

    Sources are taken out, matched and put back at their places; a report without sources, or with a
    null among them, keeps it so. Metadata gets ``osm_facilities_found`` and ``location_name``.
    """
    reports = stage(reports, "parsed-reports")
    kind = reports.schema["report"].dataType["probable_sources"].dataType
    fields = [f.name for f in kind.elementType.fields]
    sources = reports.select("event_id", F.posexplode("report.probable_sources").alias("source_rank", "_source"))
    flat = sources.where(F.col("_source").isNotNull()).select("event_id", "source_rank", "_source.*")
    matched = match_source_coordinates(flat, facilities).select("event_id", "source_rank", F.struct(*fields).alias("_told"))
    back = sources.join(matched, ["event_id", "source_rank"], "left").groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("source_rank", "_told"))).alias("_list")
    )
    counts = facilities.groupBy("event_id").agg(F.count(F.lit(1)).alias("_found"))
    named = events.select("event_id", F.col("location_name").alias("_place"))
    joined = reports.join(back, "event_id", "left").join(counts, "event_id", "left").join(named, "event_id", "left")
    told = F.when(F.col("_list").isNotNull(), F.transform("_list", lambda s: s["_told"])).otherwise(F.col("report.probable_sources"))
    added = {"osm_facilities_found": F.coalesce("_found", F.lit(0)).cast("string"), "location_name": F.col("_place")}
    own = F.coalesce(F.col("report.metadata"), F.create_map().cast("map<string,string>"))
    other = F.map_filter(own, lambda name, value: ~name.isin(list(added)))
    metadata = F.map_concat(other, F.create_map(*[part for name, value in added.items() for part in (F.lit(name), value)]))
    report = F.col("report").withField("probable_sources", told).withField("metadata", metadata)
    return joined.withColumn("report", report).select(*reports.columns)


def attribution_reports(events: DataFrame, facilities: DataFrame, corpus: DataFrame, embedder: Embedder, model: Model) -> DataFrame:
    """One report per event (``event_id, parsed, report``), from its search to the enriched answer.

    ``events`` have a ``location_name``; ``facilities`` are the listed ones of each event; ``corpus``
    has ``doc_id, collection, digest, text, embedding``, as from :func:`embed_changed`.
    """
    facilities = stage(facilities, "listed-facilities")
    sized = corpus.withColumn("n_chars", F.length("text"))
    texts = sized.groupBy("digest").agg(F.any_value("text").alias("text"))
    contexts = budgeted_context(search(events, sized, embedder), texts)
    prompts = retrieval.render_prompts(events, facility_lines(facilities), contexts)
    parsed = modeloutput.parse_reports(answered(prompts, model)).select("event_id", "parsed", "report")
    return enrich_reports(parsed, facilities, events)
