"""Sentences and labels of the community report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwatch.functions.text import fixed

# Order of relevance of facility types; everything else comes after.
TYPE_PRIORITY = {
    "wastewater_plant": 0, "chemical_plant": 1, "waste_disposal": 2, "slaughterhouse": 3,
    "industrial_works": 4, "industrial_zone": 5,
}
OTHER_PRIORITY = 10

# Alert level by severity.
ALERT_LEVELS = {"critical": "CRITICAL", "severe": "SEVERE", "moderate": "MODERATE"}

# Weather wording in the summary.
WEATHER_PHRASES = {
    "post_rainfall_runoff": "following heavy rainfall (post-rainfall runoff conditions)",
    "wind_driven_resuspension": "during high wind conditions causing sediment resuspension",
    "calm_conditions": "under calm atmospheric conditions suggesting sustained nutrient input",
}
OTHER_WEATHER = "under monitored conditions"

# Last sentence of the summary by severity.
SUMMARY_TAILS = {
    "critical": "Immediate public health response recommended.",
    "severe": "Enhanced monitoring of downstream water intakes advised.",
}
OTHER_TAIL = "Continued satellite monitoring recommended."

UNAVAILABLE = "Detailed facility data temporarily unavailable."


def choose(label: Column, table: dict[str, str | int], default: str | int) -> Column:
    picked = F.lit(default)
    for key, value in table.items():
        picked = F.when(label == key, F.lit(value)).otherwise(picked)
    return picked


def type_priority(kind: Column) -> Column:
    return choose(kind, TYPE_PRIORITY, OTHER_PRIORITY)


def likelihood(kind: Column, distance_km: Column, category: Column) -> Column:
    point_source = kind.isin("wastewater_plant", "chemical_plant", "waste_disposal")
    return (
        F.when(point_source & (distance_km < 15), "high")
        .when((distance_km < 10) & (category != "agricultural"), "high")
        .when(distance_km < 20, "medium")
        .otherwise("low")
    )


# The sentences of the evidence.
def evidence(name: Column, kind: Column, distance_km: Column, direction: Column, tags: Column) -> Column:
    operator, product = F.nullif(tags["operator"], F.lit("")), F.nullif(tags["product"], F.lit(""))
    detail = F.coalesce(
        F.concat(F.lit(", operated by "), operator), F.concat(F.lit(", produces "), product), F.lit("")
    )
    return F.concat(
        name, F.lit(" is a "), F.replace(kind, F.lit("_"), F.lit(" ")),
        F.lit(" facility located "), distance_km.cast("string"), F.lit("km "), direction,
        F.lit(" of the anomaly"), detail, F.lit(". "),
        F.when(distance_km < 10, "Direct discharge pathway likely.").otherwise(
            "Potential contributor via watershed drainage."
        ),
    )


# The sources named where no facility is known.
def generic_sources(severity: Column, chl: Column) -> Column:
    """Array of sources for an event with no mapped facility nearby, most likely first."""
    amount = fixed(chl, 1)

    def source(name, kind, likely, text, km):
        return F.struct(
            F.lit(name).alias("source_name"), F.lit(kind).alias("source_type"),
            F.lit(likely).alias("likelihood"), F.concat(*text, F.lit(" " + UNAVAILABLE)).alias("evidence"),
            F.lit(km).alias("distance_km"), F.lit(None).cast("array<double>").alias("coordinates"),
        )

    return (
        F.when(severity == "critical", F.array(
            source("Upstream nutrient loading", "agricultural", "high",
                   [F.lit("Elevated chl-a ("), amount,
                    F.lit(" mg/m³) consistent with agricultural nutrient runoff.")], 15.0),
            source("Municipal wastewater discharge", "municipal", "medium",
                   [F.lit("Proximity to populated areas suggests potential wastewater contribution.")], 10.0),
        ))
        .when(severity == "severe", F.array(
            source("Agricultural nutrient runoff", "agricultural", "high",
                   [F.lit("Chl-a at "), amount, F.lit(" mg/m³ indicates nutrient enrichment.")], 15.0),
        ))
        .otherwise(F.array(
            source("Seasonal algal productivity", "natural", "high",
                   [F.lit("Natural variation in phytoplankton productivity.")], 0.0),
        ))
    )


def alert_level(severity: Column) -> Column:
    return choose(severity, ALERT_LEVELS, "MODERATE")


# The sentences of the summary.
def alert_summary(
    severity: Column, chl: Column, baseline: Column, z: Column, place: Column, date: Column, weather: Column
) -> Column:
    ratio = chl / F.greatest(baseline, F.lit(1.0))
    return F.concat(
        F.lit("Satellite sensors detected anomalous chlorophyll-a concentration of "), fixed(chl, 1),
        F.lit(" mg/m³ near "), place, F.lit(" on "), date, F.lit(", "),
        choose(weather, WEATHER_PHRASES, OTHER_WEATHER),
        F.lit(". This represents a "), fixed(ratio, 1), F.lit("x deviation from the rolling baseline of "),
        fixed(baseline, 1), F.lit(" mg/m³ (z-score: "), fixed(z, 1), F.lit("). "),
        choose(severity, SUMMARY_TAILS, OTHER_TAIL),
    )


def exceeds_guideline(chl: Column) -> Column:
    return chl > 10.0


def contaminant(chl: Column) -> Column:
    return F.when(chl > 20, "algal_toxins").otherwise("nutrient_loading")


# The sentence of the advice.
def monitoring_advice(chl: Column) -> Column:
    return F.concat(
        F.lit("Increase sampling frequency at downstream intakes. Current chl-a of "), fixed(chl, 1),
        F.lit(" mg/m³ "), F.when(exceeds_guideline(chl), "exceeds").otherwise("approaches"),
        F.lit(" WHO bloom indicator threshold of 10 µg/L."),
    )


# The sentences of the context.
def historical_context(place: Column) -> Column:
    return F.concat(
        F.lit("Anomaly detected near "), place,
        F.lit(" via Sentinel-3 OLCI. Real-time satellite monitoring enables early detection of "
              "harmful algal blooms before they impact drinking water supplies."),
    )


# Priorities, actions and parties by severity.
def recommended_actions(severity: Column, place: Column, chl: Column) -> Column:
    """Array of ``struct<priority, action, responsible_party>``, scaled by severity."""
    amount = fixed(chl, 0)

    def step(priority, party, *text):
        return F.struct(
            F.lit(priority).alias("priority"), F.concat(*text).alias("action"),
            F.lit(party).alias("responsible_party"),
        )

    return (
        F.when(severity == "critical", F.array(
            step("immediate", "Local health department",
                 F.lit("Issue public health advisory for communities near "), place),
            step("immediate", "Water utility operators",
                 F.lit("Deploy rapid toxin testing at chl-a "), amount, F.lit(" mg/m³")),
            step("within_24h", "Environmental protection agency",
                 F.lit("Coordinate with upstream agencies to identify point sources")),
            step("within_week", "Public communications office",
                 F.lit("Publish community water quality bulletin with satellite evidence")),
        ))
        .when(severity == "severe", F.array(
            step("immediate", "Water utility operators",
                 F.lit("Increase water intake sampling frequency near "), place,
                 F.lit(" (chl-a at "), amount, F.lit(" mg/m³)")),
            step("within_24h", "Environmental monitoring agency",
                 F.lit("Deploy additional monitoring at anomaly location")),
            step("within_week", "Environmental protection agency",
                 F.lit("Review upstream discharge permits for recent violations")),
        ))
        .otherwise(F.array(
            step("within_24h", "Remote sensing team",
                 F.lit("Flag "), place, F.lit(" for enhanced monitoring on next satellite pass")),
            step("within_week", "Environmental monitoring agency",
                 F.lit("Cross-reference with weather forecast to assess escalation risk")),
        ))
    )
