"""Gridded files that keep arriving, stored as they come.

Only the clean-up runs on the stream. Features and detection need whole series and run as batch
jobs over the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnwatch.sources import gridded


def gridded_stream(spark: SparkSession, path: str, header: list[str], files_per_batch: int = 1000) -> DataFrame:
    """Clean rows of the CSV files in a folder, by file arrival. ``header`` names their columns."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(path)
    )
    return gridded.clean(gridded.normalize_headers(raw))


def store_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append clean rows to Parquet, exactly once per file; returns when the backlog is stored."""
    query = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query
