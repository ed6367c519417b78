"""Hooks, budgeted contexts and nested enrichment."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch import schemas
from tarnwatch.operators import attribution, retrieval

FACILITY = "event_id long, rank int, name string, type string, direction string, lat double, lon double, distance_km double, tags map<string,string>"


def counting_embedder(folder):
    """An embedder that leaves a file for each start and a line for each text."""
    def factory():
        import uuid
        from pathlib import Path

        mark = Path(folder) / uuid.uuid4().hex
        mark.write_text("")

        def embed(texts):
            with mark.open("a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return np.array([[len(t), t.count("a") + 1.0] for t in texts])

        return embed

    return factory


def test_only_changed_chunks_are_embedded(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    seen = lambda: sorted(line for f in marks.iterdir() for line in f.read_text().splitlines())
    path = str(tmp_path / "store")
    rows = [(i, f"text {i % 7}") for i in range(300)] + [(900, None)]
    frame = spark.createDataFrame(rows, "doc_id int, chunk string").repartition(8)
    first = attribution.embed_changed(frame, attribution.open_embeddings(spark, path), counting_embedder(str(marks)))
    assert first.count() == 301 and {r["embedding"] and tuple(r["embedding"]) for r in first.collect()} == {(6.0, 1.0), None}
    assert seen() == [f"text {i}" for i in range(7)]
    assert len(list(marks.iterdir())) <= 8  # once per worker, not per batch or text
    changed = frame.withColumn("chunk", F.when(F.col("doc_id") == 3, "banana").otherwise(F.col("chunk")))
    again = attribution.embed_changed(changed, attribution.open_embeddings(spark, path), counting_embedder(str(marks)))
    assert {r["doc_id"]: list(r["embedding"]) for r in again.where("doc_id in (3, 4)").collect()} == {3: [6.0, 4.0], 4: [6.0, 1.0]}
    assert seen() == sorted([f"text {i}" for i in range(7)] + ["banana"])


@pytest.mark.parametrize("kind", ["string", "long"])
def test_search_equals_brute_force_and_compares_each_vector_once(spark, monkeypatch, kind):
    rng, table = random.Random(11), {}
    place = lambda n: (f"r_{n % 4}", dt.date(2020, 6, 1 + n % 2), 40.0 + n % 3, -83.0, ["calm_conditions", "wind"][n % 2])
    events = spark.createDataFrame([(n % 20, *place(n)) for n in range(24)], "event_id long, region_id string, date date, lat double, lon double, weather_context string")
    vector = lambda t: table.setdefault(t, [float(len(t) % 3 + 1), float(t.count("a") % 4 + 1), 1.0])
    texts = ["one a", "two aa", "three aaa", "x", "a" * 9, "b a b a", "same length"]
    ids = [-3, 2, 10, 9] * 8
    rows = [(i if kind == "long" else str(i), retrieval_group, t, vector(t)) for i, retrieval_group, t in zip(ids, ["permits", "agriculture", "watershed"] * 11, rng.choices(texts, k=32))]
    corpus = spark.createDataFrame(rows, f"doc_id {kind}, collection string, text string, embedding array<double>").repartition(5)
    corpus = corpus.withColumn("digest", attribution.digest(F.col("text"))).withColumn("n_chars", F.length("text"))
    compared = []
    topk = retrieval.vector_topk

    def counted(queries, documents, *rest):
        compared.append((queries.count(), documents.count()))
        return topk(queries, documents, *rest)

    monkeypatch.setattr(retrieval, "vector_topk", counted)
    found = attribution.search(events, corpus, lambda: lambda ts: np.array([[len(t) % 3 + 1.0, t.count("a") % 4 + 1.0, 1.0] for t in ts]))
    found = sorted((r["event_id"], r["position"], r["n_chars"]) for r in found.collect())
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    queries, expected = retrieval.retrieval_queries(events).collect(), []
    for event, number in {(q["event_id"], q["query_no"]) for q in queries}:
        asked = [q["query"] for q in queries if (q["event_id"], q["query_no"]) == (event, number)]  # an id may stand for several rows
        for c, name in enumerate(["permits", "agriculture", "watershed"]):
            near = sorted((round(1 - float(unit(v) @ unit(vector(text))), 12), i, len(t)) for text in asked for i, own, t, v in rows if own == name)[:3]
            expected += [(event, (number * 3 + c) * 3 + rank, km[:2]) for rank, km in enumerate(near, 1)]
    assert [e[:2] for e in sorted(expected)] == [f[:2] for f in found]
    lengths = {(name, i): {len(t) for j, own, t, _ in rows if (j, own) == (i, name)} for i, name in {(r[0], r[1]) for r in rows}}
    names = ["permits", "agriculture", "watershed"]
    assert all(f[2] in lengths[names[(f[1] - 1) // 3 % 3], e[2][1]] for e, f in zip(sorted(expected), found))
    assert compared == [(len({tuple(vector(q["query"])) for q in queries}), len({(r[1], r[2]) for r in rows}))]


def brute_context(hits, texts, limit):
    out = {}
    for event in {h[0] for h in hits}:
        unique = []
        for _, _, digest in sorted((h for h in hits if h[0] == event), key=lambda h: h[1]):
            if texts[digest] and texts[digest] not in unique:
                unique.append(texts[digest])
        if unique:
            out[event] = (retrieval.SEPARATOR.join(unique)[:limit], len(unique))
    return out


@pytest.mark.parametrize("limit", [8000, 57, 1])
def test_contexts_equal_whole_texts_cut(spark, limit):
    rng = random.Random(limit)
    texts = {f"d{i}": "é" * rng.choice([0, 3, 30, 56, 57, 58]) + (str(i) if i else "") for i in range(12)}
    hits = [(e, p, f"d{rng.randrange(12)}") for e in range(20) for p in range(rng.randrange(1, 9))]
    found = attribution.budgeted_context(
        spark.createDataFrame([(e, p, d, len(texts[d])) for e, p, d in hits], "event_id int, position int, digest string, n_chars int"),
        spark.createDataFrame(list(texts.items()), "digest string, text string"), limit)
    assert {r["event_id"]: (r["context"], r["n_documents"]) for r in found.collect()} == brute_context(hits, texts, limit)


def test_texts_that_do_not_fit_are_not_fetched(spark, tmp_path):
    hits = spark.createDataFrame([(1, 1, "a", 50), (1, 2, "b", 50), (1, 3, "c", 50)], "event_id int, position int, digest string, n_chars int")
    # a missing text shows which ones were asked for: only "a" and "b" begin within the limit
    texts = spark.createDataFrame([("a", "x" * 50), ("b", "y" * 50)], "digest string, text string")
    row = attribution.budgeted_context(hits, texts, 60).first()
    assert row["context"] == "x" * 50 + "\n---\n" + "y" * 5 and row["n_documents"] == 3
    plan = attribution.budgeted_context(hits, texts, 60)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("Window" in line for line in lines[join:]) and not any("Window" in line for line in lines[:join])


def test_nested_reports_keep_their_order_and_nulls(spark):
    kind = schemas.COMMUNITY_REPORT
    source = lambda name, km=None, at=None: {"source_name": name, "distance_km": km, "coordinates": at, "source_type": "t"}
    reports = {
        1: {"probable_sources": [source("zzz"), source("PLANT ONE"), None, source("the farm near", 0.0), source("Plant one", 3.0, [1.0, 2.0]), source(None)], "metadata": {"location_name": "?", "own": "1"}},
        2: {"probable_sources": []}, 3: {"probable_sources": None, "alert_level": "HIGH"}, 4: {"probable_sources": [source("plant one")]},
    }
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in reports.items()], "event_id long, raw string")
    parsed = frame.select("event_id", F.lit(True).alias("parsed"), F.from_json("raw", kind).alias("report"))
    near = spark.createDataFrame([(1, 1, "Plant One", "works", "N", 5.0, 6.0, 1.5, None), (1, 2, "Farm", "farmland", "N", 7.0, 8.0, 2.5, None), (2, 1, "X", "works", "N", 0.0, 0.0, 0.1, None)], FACILITY)
    events = spark.createDataFrame([(i, f"place {i}") for i in range(1, 5)], "event_id long, location_name string")
    found = {r["event_id"]: r["report"] for r in attribution.enrich_reports(parsed, near, events).collect()}
    told = [s and (s["source_name"], s["distance_km"], s["coordinates"]) for s in found[1]["probable_sources"]]
    assert told == [("zzz", None, None), ("PLANT ONE", 1.5, [5.0, 6.0]), None, ("the farm near", 2.5, [7.0, 8.0]), ("Plant one", 3.0, [1.0, 2.0]), (None, None, None)]
    assert found[1]["metadata"] == {"own": "1", "osm_facilities_found": "2", "location_name": "place 1"}
    assert found[2]["probable_sources"] == [] and found[2]["metadata"]["osm_facilities_found"] == "1"
    assert found[3]["probable_sources"] is None and found[3]["alert_level"] == "HIGH"
    assert found[4]["probable_sources"][0]["coordinates"] is None and found[4]["metadata"]["osm_facilities_found"] == "0"


def test_events_become_reports(spark):
    events = spark.createDataFrame([(1, "r_1", dt.date(2020, 6, 1), 41.5, -83.0, "severe", 0.7, 9.0, 3.0, 2.5, "calm_conditions", "the lake")],
                                   "event_id long, region_id string, date date, lat double, lon double, severity string, confidence double, chl_a_value double, chl_a_baseline double, z_score double, weather_context string, location_name string")
    near = spark.createDataFrame([(1, 1, "Plant", "works", "N", 5.0, 6.0, 1.5, {"man_made": "works"})], FACILITY)
    rows = [(f"c{i}", ["permits", "agriculture", "watershed"][i % 3], f"passage {i}" + " a" * i) for i in range(12)]
    corpus = spark.createDataFrame(rows, "doc_id string, collection string, text string").withColumn("digest", attribution.digest(F.col("text")))
    embed = lambda: lambda texts: np.array([[t.count("a") + 1.0, len(t)] for t in texts])
    corpus = corpus.join(attribution.embedded(corpus, "doc_id", "text", embed), "doc_id")

    def model():
        def answer(prompts):
            assert all("passage" in p and "- Plant: works, 1.5km N" in p and "  place: the lake" in p for p in prompts)
            return ["broken" if "nothing" in p else json.dumps({"alert_level": "HIGH", "probable_sources": [{"source_name": "plant"}]}) for p in prompts]
        return answer

    row = attribution.attribution_reports(events, near, corpus, embed, model).first()
    assert row["parsed"] and row["report"]["probable_sources"][0]["coordinates"] == [5.0, 6.0]
    assert row["report"]["metadata"] == {"osm_facilities_found": "1", "location_name": "the lake"}
