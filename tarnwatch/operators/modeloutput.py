"""Reading reports out of raw model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import schemas

# The report that stands in for unreadable output.
DEFAULT_REPORT = {
    "alert_level": "MODERATE",
    "alert_summary": "Report generation encountered an error. Manual review required.",
    "contaminant_type": "algal_toxins",
    "recommended_monitoring": "Contact local water authority.",
    "historical_context": "No historical context available.",
}


def _default() -> Column:
    report = DEFAULT_REPORT
    return F.struct(
        F.lit(report["alert_level"]).alias("alert_level"),
        F.lit(report["alert_summary"]).alias("alert_summary"),
        F.array().cast(schemas.COMMUNITY_REPORT["probable_sources"].dataType).alias("probable_sources"),
        F.struct(
            F.array().cast("array<string>").alias("at_risk_communities"),
            F.lit(0.0).alias("estimated_arrival_hours"),
            F.lit(report["contaminant_type"]).alias("contaminant_type"),
            F.lit(False).alias("who_threshold_exceeded"),
            F.lit(report["recommended_monitoring"]).alias("recommended_monitoring"),
        ).alias("drinking_water_impact"),
        F.array().cast(schemas.COMMUNITY_REPORT["recommended_actions"].dataType).alias("recommended_actions"),
        F.lit(report["historical_context"]).alias("historical_context"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def _is_json(text: Column) -> Column:
    """Whether the text is JSON, where keys may be repeated.

    The strict parser refuses repeated keys, the lenient one reads them but also stops at the end of
    the first value and takes single quotes. So what only the lenient one reads must come out with
    all its quotes and braces, and must still be refused: then repeated keys are what is wrong.
    """
    read = F.get_json_object(text, "$")
    whole = lambda mark: F.regexp_count(text, F.lit(mark)) == F.regexp_count(read, F.lit(mark))
    repeated = read.isNotNull() & F.try_parse_json(read).isNull() & whole(r"\}") & whole(r"\"")
    return F.coalesce(F.try_parse_json(text).isNotNull() | repeated, F.lit(False))


def report_json(raw: Column) -> Column:
    """The JSON text inside raw output, or NULL.

    Code fences are stripped; if the rest is not JSON, the span from the first opening to the last
    closing brace is tried. Text that is JSON but not an object is no report. Of repeated keys the
    last one counts.
    """
    unfenced = F.regexp_replace(raw, r"```(?:json)?\s*", "")
    cleaned = F.regexp_replace(unfenced, r"^\s+|[\s`]+$", "")
    braces = F.regexp_extract(cleaned, r"(?s)\{.*\}", 0)
    return F.when(_is_json(cleaned) & cleaned.startswith("{"), cleaned).when(_is_json(braces), braces)


def parse_reports(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``report`` (a community report) and ``parsed`` (whether it came from the output)."""
    found = outputs.withColumn("_json", report_json(F.col(raw)))
    return found.select(
        *outputs.columns,
        F.col("_json").isNotNull().alias("parsed"),
        F.when(
            F.col("_json").isNotNull(), F.from_json("_json", schemas.COMMUNITY_REPORT)
        ).otherwise(_default()).alias("report"),
    )
