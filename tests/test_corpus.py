"""Chunks, collections, retrieval."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import chunks, retrieval
from tarnwatch.sources import documents


def squeezed(text):
    return "".join(text.split())


@pytest.mark.parametrize("seed", range(6))
def test_splitter_loses_nothing(seed):
    rng = random.Random(seed)
    words = [f"w{i}" + "a" * rng.randrange(1, 30) for i in range(400)] + ["".join(chr(200 + i) for i in range(1700))]
    rng.shuffle(words)
    text = "".join(w + rng.choice([" ", " ", ". ", "\n", "\n\n"]) for w in words)
    plain = chunks.split_recursive(text, 500, 0)
    assert squeezed("".join(plain)) == squeezed(text)
    lapped = chunks.split_recursive(text, 500, 50)
    assert all(0 < len(c) <= 500 for c in plain + lapped)
    # Every chunk is a piece of the text, and together they cover it.
    at = 0
    for chunk in lapped:
        found = text.find(chunk, max(0, at - 100))
        assert found != -1 and squeezed(text[at:found]) == ""
        at = max(at, found + len(chunk))
    assert squeezed(text[at:]) == ""


def test_splitter_edges():
    assert chunks.split_recursive("") == []
    assert chunks.split_recursive("short") == ["short"]
    assert chunks.split_recursive("one\n\ntwo", 4, 0) == ["one", "two"]
    assert [len(c) for c in chunks.split_recursive("z" * 1200, 500, 0)] == [500, 500, 200]


def test_chunk_indexes_are_dense(spark):
    table = spark.createDataFrame([(1, "a", "word " * 500), (2, "b", ""), (3, "c", "x")], "doc_id long, source string, text string")
    rows = chunks.recursive_chunks(table).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("m")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {1: pytest.approx(6, abs=1), 3: 1}
    assert all(r["m"] == r["n"] - 1 for r in rows)


def test_corpus_build_and_upsert(spark, tmp_path):
    source = tmp_path / "docs"
    source.mkdir()
    (source / "epa_permits.md").write_text("Toledo permits. " * 60)
    (source / "watershed_maps.md").write_text("The Mekong delta.")
    (source / "unknown.md").write_text("skipped")
    (source / "notes.txt").write_text("skipped too")
    built = documents.build_chunks(documents.read_documents(spark, str(source)), documents.routes(spark)).cache()
    first = built.where("chunk_index = 0").orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["collection"], r["region"]) for r in first] == [
        ("epa_permits_md_0000", "permits", "lake_erie"), ("watershed_maps_md_0000", "watershed", "mekong_delta")]
    documents.write_collections(built, str(tmp_path / "v1"))
    stored = spark.read.parquet(str(tmp_path / "v1")).select(built.columns)
    changed = built.where("collection = 'watershed'").withColumn("chunk", F.lit("new"))
    documents.upsert_collections(stored, changed, str(tmp_path / "v2"))
    merged = spark.read.parquet(str(tmp_path / "v2"))
    assert merged.count() == built.count()
    assert [r["chunk"] for r in merged.where("collection = 'watershed'").collect()] == ["new"]
    counts = {r["collection"]: r["n_chunks"] for r in chunks.collection_counts(merged).collect()}
    assert counts["watershed"] == 1 and counts["permits"] >= 2


def exact_topk(queries, corpus, k):
    want = {}
    for q, qv in queries:
        qv = np.array(qv)
        for group in {g for _, g, _ in corpus}:
            scored = sorted(
                (round(1 - float(qv @ np.array(v)) / (np.linalg.norm(qv) * np.linalg.norm(v)), 9), d)
                for d, g, v in corpus if g == group)
            want[(q, group)] = [d for _, d in scored[:k]]
    return want


def test_scores_are_made_in_tiles_of_bounded_memory():
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    rng = np.random.default_rng(4)
    schema = T.StructType([T.StructField("query_id", T.IntegerType()), T.StructField("collection", T.StringType()),
                           T.StructField("doc_id", T.LongType()), T.StructField("distance", T.DoubleType())])
    queries = pa.table({"query_id": pa.array(range(9000), pa.int32()), "embedding": list(rng.normal(size=(9000, 8)))})
    documents = pa.table({"doc_id": range(9000), "collection": ["a", "b"] * 4500, "embedding": list(rng.normal(size=(9000, 8)))})
    tracemalloc.start()
    found = retrieval._block_scorer(schema, ["query_id"], "collection", 3)(queries, [documents])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 9000 * 2 * 3
    assert peak < 0.5 * 9000 * 9000 * 8  # one dense matrix would be 648 MB


@pytest.mark.parametrize("query_bytes", [64 << 20, 200])
def test_vector_topk_is_exact(spark, query_bytes, monkeypatch):
    monkeypatch.setattr(retrieval, "DOCUMENTS_PER_BLOCK", 150)
    rng = np.random.default_rng(3)
    corpus = [(i, f"c{i % 3}", [float(v) for v in rng.normal(size=8)]) for i in range(400)]
    queries = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(7)]
    hits = retrieval.vector_topk(
        spark.createDataFrame(queries, "query_id int, embedding array<double>"),
        spark.createDataFrame(corpus, "doc_id long, collection string, embedding array<double>").repartition(5),
        query_bytes=query_bytes,
    )
    got = {}
    for r in hits.orderBy("rank").collect():
        got.setdefault((r["query_id"], r["collection"]), []).append(r["doc_id"])
    assert got == exact_topk(queries, corpus, 3)


def test_equal_vectors_keep_the_smaller_id(spark):
    corpus = [(i, "c", [1.0, 0.0]) for i in range(50)]
    hits = retrieval.vector_topk(
        spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, embedding array<double>"),
        spark.createDataFrame(corpus, "doc_id long, collection string, embedding array<double>").repartition(4, "doc_id"),
    )
    assert [r["doc_id"] for r in hits.orderBy("rank").collect()] == [0, 1, 2]


def test_cosine_distance_column(spark):
    row = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0])], "a array<float>, b array<float>")
    assert row.select(retrieval.cosine_distance(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.2)


def test_context_keeps_first_appearance_and_length(spark):
    hits = spark.createDataFrame([(1, 5, "b"), (1, 1, "a"), (1, 2, "b"), (1, 9, "c" * 9000), (1, 3, "")], "event_id int, position int, text string")
    row = retrieval.context(retrieval.unique_documents(hits)).first()
    assert row["context"].startswith("a\n---\nb\n---\nccc") and len(row["context"]) == 8000
    assert row["n_documents"] == 3


def test_text_embeddings_find_shared_words(spark):
    texts = spark.createDataFrame([(0, "river nutrient runoff"), (1, "river runoff nutrient nutrient"), (2, "tax office opening hours")], "doc_id int, text string")
    rows = {r["doc_id"]: np.array(r["embedding"]) for r in retrieval.text_embeddings(texts, "text").collect()}
    assert rows[0] @ rows[1] > rows[0] @ rows[2]
    assert np.isclose(np.linalg.norm(rows[0]), 1.0, atol=1e-5)
