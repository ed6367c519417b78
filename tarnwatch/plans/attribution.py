"""The query of whole attributions, with hooks that SQL can follow."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.functions import geo
from tarnwatch.operators import attribution, chunks, facilities
from tarnwatch.plans import views
from tarnwatch.plans.registry import query
from tarnwatch.plans.stores import fresh

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts():
    """An embedder that counts letters; a constant keeps texts without any from having no direction."""
    def embed(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) + t.count(c.upper()) for c in LETTERS] + [1] for t in texts], np.float64)

    return embed


def quoting_model():
    """A model that names the first two facilities of its prompt, and the digest of its context."""
    def answer(prompts: list[str]) -> list[str]:
        out = []
        for number, prompt in enumerate(prompts):
            severity = re.search(r"^  severity: (.*)$", prompt, re.MULTILINE).group(1)
            listed, rest = prompt.split("no others)\n", 1)[1].split("\n\nBackground documents\n", 1)
            context = rest.rsplit("\n\nFields: ", 1)[0]
            names = re.findall(r"^- (.*?): ", listed, re.MULTILINE)
            sources = [{"source_name": "zzz", "distance_km": 7.5}]
            if names:
                sources.insert(0, {"source_name": names[0].upper(), "distance_km": 0})
            if len(names) > 1:
                sources.append({"source_name": f"The {names[1]} site"})
            report = {"alert_level": severity.upper(), "probable_sources": sources, "historical_context": hashlib.md5(context.encode()).hexdigest(), "metadata": {"location_name": "unknown", "model": "quoting"}}
            text = json.dumps(report)
            out.append(f"```json\n{text}\n```" if number % 2 else f"The report: {text} Done.")
        return out

    return answer


_COUNTS = ", ".join(f"LENGTH({{t}}) - LENGTH(REPLACE(REPLACE({{t}}, '{c}', ''), '{c.upper()}', ''))" for c in LETTERS)
_VECTOR = "CAST([" + _COUNTS + ", 1] AS DOUBLE[])"


@query(f"""
, asked AS (SELECT event_id, n, {_VECTOR.format(t='query')} AS v FROM (
  SELECT event_id, n, CASE n WHEN 0 THEN 'pollution sources near ' || CAST(lat AS VARCHAR) || ', ' || CAST(lon AS VARCHAR) || ' water contamination'
    WHEN 1 THEN 'agricultural runoff nutrient loading ' || weather_context || ' chlorophyll ' || strftime(date, '%Y-%m-%d')
    WHEN 2 THEN 'industrial discharge permits violations near ' || region_id ELSE 'watershed downstream communities drinking water intake ' || region_id END AS query
  FROM anomaly_events CROSS JOIN (SELECT UNNEST(range(0, 4)) AS n) k) q),
corpus AS (SELECT r.collection, c.doc_id || '_' || c.chunk_index AS id, c.chunk, {_VECTOR.format(t='c.chunk')} AS v FROM chunks c JOIN routed r USING (doc_id)),
hits AS (SELECT event_id, chunk, (n * 3 + CASE collection WHEN 'permits' THEN 0 WHEN 'agriculture' THEN 1 ELSE 2 END) * 3 + rank AS position FROM (
  SELECT a.event_id, a.n, c.collection, c.chunk, ROW_NUMBER() OVER (PARTITION BY a.event_id, a.n, c.collection ORDER BY 1e0 - list_cosine_similarity(a.v, c.v), c.id) AS rank
  FROM asked a CROSS JOIN corpus c) h WHERE rank <= 3),
contexts AS (SELECT event_id, SUBSTRING(string_agg(chunk, chr(10) || '---' || chr(10) ORDER BY position), 1, 8000) AS context
  FROM (SELECT event_id, chunk, MIN(position) AS position FROM hits GROUP BY event_id, chunk) u GROUP BY event_id),
told AS (
  SELECT event_id, 0 AS turn, UPPER(fname) AS source_name, 0e0 AS km FROM nearest WHERE rank = 1
  UNION ALL SELECT event_id, 1, 'zzz', 75e-1 FROM anomaly_events
  UNION ALL SELECT event_id, 2, 'The ' || fname || ' site', NULL FROM nearest WHERE rank = 2),
named AS (SELECT * FROM (SELECT *, LOWER(fname) AS lname, MIN(rank) OVER (PARTITION BY event_id, LOWER(fname)) AS first_rank,
  ROW_NUMBER() OVER (PARTITION BY event_id, LOWER(fname) ORDER BY rank DESC) AS from_last FROM nearest) l WHERE from_last = 1 AND lname <> ''),
matched AS (SELECT * FROM (
  SELECT t.event_id, t.turn, f.distance_km, f.lat, f.lon, ROW_NUMBER() OVER (PARTITION BY t.event_id, t.turn ORDER BY CASE WHEN f.lname = LOWER(t.source_name) THEN 0 ELSE 1 END, f.first_rank) AS rn
  FROM told t JOIN named f ON f.event_id = t.event_id AND (contains(LOWER(t.source_name), f.lname) OR contains(f.lname, LOWER(t.source_name)))) m WHERE rn = 1)
SELECT e.event_id, TRUE AS parsed, UPPER(e.severity) AS alert_level, md5(c.context) AS historical_context, CAST(COALESCE(n.n, 0) AS VARCHAR) AS osm_facilities_found, 'quoting' AS model,
  CAST(ROW_NUMBER() OVER (PARTITION BY e.event_id ORDER BY t.turn) - 1 AS INTEGER) AS source_no, t.source_name,
  CASE WHEN m.event_id IS NOT NULL AND COALESCE(t.km, 0) = 0 THEN m.distance_km ELSE t.km END AS distance_km, m.lat, m.lon
FROM anomaly_events e JOIN contexts c USING (event_id) JOIN told t USING (event_id) LEFT JOIN (SELECT event_id, COUNT(*) AS n FROM nearest GROUP BY event_id) n USING (event_id)
  LEFT JOIN matched m ON m.event_id = t.event_id AND m.turn = t.turn""", ("nearest", "chunks", "routed"))
def attribution_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event from its search to the nested report, one row per probable source."""
    events = views.anomaly_events(spark, sf_dir).withColumn("location_name", geo.location_label(F.col("lat"), F.col("lon")))
    rows = chunks.fixed_chunks(views.routed_documents(spark, sf_dir))
    rows = rows.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("doc_id"), "collection", F.col("chunk").alias("text"))
    corpus = attribution.embed_changed(rows, attribution.open_embeddings(spark, fresh(spark, "embeddings"), 8), letter_counts, "text")
    near = facilities.nearest_facilities(events, views.facility_elements(spark, sf_dir))
    reports = attribution.attribution_reports(events, near, corpus, letter_counts, quoting_model)
    flat = reports.select("event_id", "parsed", "report", F.posexplode("report.probable_sources").alias("source_no", "s"))
    return flat.select(
        "event_id", "parsed", "report.alert_level", "report.historical_context", F.col("report.metadata")["osm_facilities_found"].alias("osm_facilities_found"),
        F.col("report.metadata")["model"].alias("model"), "source_no", "s.source_name", "s.distance_km",
        F.get("s.coordinates", F.lit(0)).alias("lat"), F.get("s.coordinates", F.lit(1)).alias("lon"),
    )
