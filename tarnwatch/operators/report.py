"""Community reports: probable sources, actions, impact and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import schemas
from tarnwatch.functions import wording
from tarnwatch.functions.geo import location_label, number_text
from tarnwatch.functions.text import fixed
from tarnwatch.operators.nearby import rank_within
from tarnwatch.session import stage

# Provenance recorded with every rule-based report.
COLLECTIONS = ["permits", "agriculture", "watershed"]
GENERATED_BY = "gemini-2.0-flash"
PIPELINE_VERSION = "2.0.0"
DATA_SOURCE = "NASA MODIS-Aqua Ocean Color via ERDDAP + Copernicus Sentinel-3 catalog"


def probable_sources(facilities: DataFrame, limit: int = 5) -> DataFrame:
    """The most relevant facilities of each event by type, then distance."""
    ranked = facilities.withColumn(
        "source_rank",
        rank_within(
            ["event_id"], wording.type_priority(F.col("type")), "distance_km", "rank"
        ),
    ).where(F.col("source_rank") <= limit)
    kind, distance = F.col("type"), F.col("distance_km")
    return ranked.select(
        "event_id",
        "source_rank",
        F.col("name").alias("source_name"),
        F.col("source_category").alias("source_type"),
        wording.likelihood(kind, distance, F.col("source_category")).alias("likelihood"),
        wording.evidence(F.col("name"), kind, distance, F.col("direction"), F.col("tags")).alias("evidence"),
        "distance_km",
        F.array("lat", "lon").alias("coordinates"),
    )


def fallback_sources(events: DataFrame, facilities: DataFrame) -> DataFrame:
    """Generic sources, by severity, for the events that have no facility."""
    without = events.join(facilities.select("event_id").distinct(), "event_id", "left_anti")
    return without.select(
        "event_id", F.posexplode(wording.generic_sources(F.col("severity"), F.col("chl_a_value")))
    ).select("event_id", (F.col("pos") + 1).alias("source_rank"), "col.*")


def all_sources(events: DataFrame, facilities: DataFrame) -> DataFrame:
    return probable_sources(facilities).unionByName(fallback_sources(events, facilities))


def nest_sources(sources: DataFrame) -> DataFrame:
    """Sources of an event (at most five) as an array in rank order."""
    fields = [f.name for f in schemas.PROBABLE_SOURCE]
    ordered = F.array_sort(F.collect_list(F.struct("source_rank", F.struct(*fields).alias("source"))))
    return sources.groupBy("event_id").agg(
        F.transform(ordered, lambda s: s["source"]).alias("probable_sources")
    )


def report_summary(events: DataFrame, place: Column | None = None) -> DataFrame:
    """Scalar parts of the report of each event."""
    chl, where = F.col("chl_a_value"), place if place is not None else location_label(F.col("lat"), F.col("lon"))
    return events.withColumn("location_name", where).select(
        "event_id",
        wording.alert_level(F.col("severity")).alias("alert_level"),
        wording.alert_summary(
            F.col("severity"), chl, F.col("chl_a_baseline"), F.col("z_score"), F.col("location_name"),
            F.date_format("date", "yyyy-MM-dd"), F.col("weather_context"),
        ).alias("alert_summary"),
        "location_name",
        wording.exceeds_guideline(chl).alias("who_threshold_exceeded"),
        wording.contaminant(chl).alias("contaminant_type"),
        wording.monitoring_advice(chl).alias("recommended_monitoring"),
        wording.historical_context(F.col("location_name")).alias("historical_context"),
    )


def report_actions(events: DataFrame, place: Column | None = None) -> DataFrame:
    where = place if place is not None else location_label(F.col("lat"), F.col("lon"))
    return events.select(
        "event_id",
        F.posexplode(wording.recommended_actions(F.col("severity"), where, F.col("chl_a_value"))),
    ).select("event_id", F.col("pos").alias("step"), "col.*")


def community_reports(events: DataFrame, facilities: DataFrame, place: Column | None = None) -> DataFrame:
    """The nested report of every event, built by rule from its facilities.

    The arrival time at intakes is left empty: nothing in the data determines it. The facility
    lists are read for the sources, for the events without any, and for their number, so they are
    staged.
    """
    facilities = stage(facilities, "facilities")
    where = place if place is not None else location_label(F.col("lat"), F.col("lon"))
    named = events.withColumn("location_name", where)
    counts = facilities.groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("n_facilities"))
    full = (
        named.join(report_summary(events, place).drop("location_name"), "event_id")
        .join(nest_sources(all_sources(events, facilities)), "event_id", "left")
        .join(counts, "event_id", "left")
    )
    impact = F.struct(
        F.array(F.concat(F.lit("Communities near "), "location_name")).alias("at_risk_communities"),
        F.lit(None).cast("double").alias("estimated_arrival_hours"),
        "contaminant_type",
        "who_threshold_exceeded",
        "recommended_monitoring",
    )
    metadata = {
        "region_id": F.col("region_id").cast("string"),
        "event_date": F.date_format("date", "yyyy-MM-dd"),
        "event_coordinates": F.concat(
            F.lit("["), number_text(F.col("lat")), F.lit(", "), number_text(F.col("lon")), F.lit("]")
        ),
        "location_name": F.col("location_name"),
        "generated_by": F.lit(GENERATED_BY),
        "sources_consulted": (F.size("probable_sources") * 4).cast("string"),
        "osm_facilities_found": F.coalesce("n_facilities", F.lit(0)).cast("string"),
        "rag_collections_queried": F.lit(", ".join(COLLECTIONS)),
        "pipeline_version": F.lit(PIPELINE_VERSION),
        "data_source": F.lit(DATA_SOURCE),
    }
    return full.select(
        "event_id",
        F.concat_ws(
            "_", F.col("region_id").cast("string"), F.date_format("date", "yyyy-MM-dd"),
            number_text(F.col("lat")), number_text(F.col("lon")),
        ).alias("report_key"),
        "alert_level",
        "alert_summary",
        "probable_sources",
        impact.alias("drinking_water_impact"),
        wording.recommended_actions(
            F.col("severity"), F.col("location_name"), F.col("chl_a_value")
        ).alias("recommended_actions"),
        "historical_context",
        F.create_map(*[part for k, v in metadata.items() for part in (F.lit(k), v)]).alias("metadata"),
    )


def match_source_coordinates(sources: DataFrame, facilities: DataFrame) -> DataFrame:
    """Give sources without coordinates those of the facility they name.

    An exact name match wins; otherwise the first facility, in list order, where either name
    contains the other. Of facilities with equal names the last one's values count, at the place of
    the first. Empty names never match. A distance is filled in only where it is missing or zero.
    """
    # One row per event and lower-case name: at most 30 per event.
    by_name = Window.partitionBy("event_id", "_fname")
    lookup = (
        facilities.withColumn("_fname", F.lower("name"))
        .where(F.col("_fname") != "")
        .withColumn("_first", F.min("rank").over(by_name))
        .withColumn("_last", F.row_number().over(by_name.orderBy(F.desc("rank"))))
        .where(F.col("_last") == 1)
        .select(
            "event_id", "_fname", "_first", F.array("lat", "lon").alias("_at"),
            F.col("distance_km").alias("_km"),
        )
    )
    sname = F.lower(F.coalesce("source_name", F.lit("")))
    wanted = F.coalesce(F.size("coordinates"), F.lit(0)) < 1
    open_sources = sources.where(wanted & (sname != "")).withColumn("_sname", sname)
    exact = F.col("_fname") == F.col("_sname")
    either = exact | F.contains("_sname", F.col("_fname")) | F.contains("_fname", F.col("_sname"))
    matched = (
        open_sources.select("event_id", "source_rank", "_sname")
        .join(lookup, "event_id")
        .where(either)
        .groupBy("event_id", "source_rank")
        .agg(
            F.min_by(
                F.struct("_at", "_km"), F.struct(F.when(exact, 0).otherwise(1), F.col("_first"))
            ).alias("_hit")
        )
    )
    km = F.col("distance_km")
    return (
        sources.join(matched, ["event_id", "source_rank"], "left")
        .withColumn(
            "distance_km",
            F.when(F.col("_hit").isNotNull() & (km.isNull() | (km == 0)), F.col("_hit._km")).otherwise(km),
        )
        .withColumn("coordinates", F.when(wanted, F.col("_hit._at")).otherwise(F.col("coordinates")))
        .drop("_hit")
    )


def render_text(reports: DataFrame, events: DataFrame, title: str = "Community Water Quality Report") -> DataFrame:
    """Plain-text form of the reports."""
    event = events.select(
        "event_id", "lat", "lon", "date", "chl_a_value", "chl_a_baseline", "z_score", "confidence"
    )

    def heading(text):
        return F.lit(f"{text}\n{'-' * 30}\n")

    def side(value, positive, negative):
        return F.when(value >= 0, positive).otherwise(negative)

    impact = F.col("drinking_water_impact")
    lat, lon = F.col("lat"), F.col("lon")
    sources = F.transform(
        "probable_sources",
        lambda s, i: F.concat(
            (i + 1).cast("string"), F.lit(". "), s["source_name"], F.lit(" ("), s["source_type"],
            F.lit(", "), s["likelihood"], F.lit(")\n   Distance: "),
            F.when(s["distance_km"] > 0, F.concat(F.regexp_replace(number_text(s["distance_km"]), r"\.0$", ""), F.lit(" km"))).otherwise("unknown"),
            F.lit("\n   "), s["evidence"], F.lit("\n\n"),
        ),
    )
    actions = F.transform(
        "recommended_actions",
        lambda a: F.concat(
            F.lit("["), F.upper(F.replace(a["priority"], F.lit("_"), F.lit(" "))), F.lit("] "), a["action"],
            F.lit("\n  Responsible: "), a["responsible_party"], F.lit("\n\n"),
        ),
    )
    arrival = impact["estimated_arrival_hours"]
    body = F.concat(
        F.lit(f"{title}\n{'=' * 50}\n\nAlert Level: "), F.col("alert_level"),
        F.lit("\nLocation: "), F.coalesce(F.col("metadata")["location_name"], F.lit("Unknown location")),
        F.lit("\nCoordinates: "), fixed(F.abs(lat), 4), F.lit("°"), side(lat, "N", "S"), F.lit(", "),
        fixed(F.abs(lon), 4), F.lit("°"), side(lon, "E", "W"),
        F.lit("\nDate: "), F.date_format("date", "yyyy-MM-dd"),
        F.lit("\nChl-a: "), fixed(F.col("chl_a_value"), 1), F.lit(" mg/m³ (baseline "),
        fixed(F.col("chl_a_baseline"), 1), F.lit(")\nZ-score: "), fixed(F.col("z_score"), 2),
        F.lit(" · Confidence: "), fixed(F.col("confidence"), 2), F.lit("\n\n"),
        heading("SUMMARY"), F.col("alert_summary"), F.lit("\n\n"),
        heading("PROBABLE SOURCES"), F.array_join(sources, ""),
        heading("DRINKING WATER IMPACT"),
        F.lit("Communities at risk: "),
        F.coalesce(F.nullif(F.array_join(impact["at_risk_communities"], ", "), F.lit("")), F.lit("Unknown")),
        F.lit("\nEstimated arrival: "),
        F.coalesce(F.concat(F.lit("~"), fixed(arrival, 0), F.lit(" hours")), F.lit("unknown")),
        F.lit("\nContaminant: "), F.replace(impact["contaminant_type"], F.lit("_"), F.lit(" ")),
        F.lit("\nWHO threshold exceeded: "), F.when(impact["who_threshold_exceeded"], "YES").otherwise("No"),
        F.lit("\n\n"),
        heading("RECOMMENDED ACTIONS"), F.array_join(actions, ""),
        F.when(
            F.coalesce(F.col("historical_context"), F.lit("")) != "",
            F.concat(heading("HISTORICAL CONTEXT"), F.col("historical_context"), F.lit("\n")),
        ).otherwise(""),
    )
    return reports.join(event, "event_id").select("event_id", body.alias("report_text"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document per report, keyed by ``report_key``."""
    reports.write.mode("overwrite").json(path)
