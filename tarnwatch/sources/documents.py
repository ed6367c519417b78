"""Document folders and the stored chunk collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.operators.chunks import (
    ROUTES, describe_chunks, recursive_chunks, route_documents, upsert_latest,
)
from tarnwatch.sources.buckets import BUCKETS, BucketStore, upsert


def read_documents(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """Whole text files with their name and stem."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return files.select(
        F.url_decode(name).alias("file_name"), F.col("value").alias("text")
    ).withColumn("source", F.regexp_replace("file_name", r"\.[^.]*$", ""))


def routes(spark: SparkSession, table: dict[str, tuple[str, str]] = ROUTES) -> DataFrame:
    rows = [(source, kind, collection) for source, (kind, collection) in table.items()]
    return spark.createDataFrame(rows, "source string, document_type string, collection string")


def build_chunks(documents: DataFrame, routing: DataFrame) -> DataFrame:
    """Documents to described chunks: routed, split, tagged and numbered."""
    routed = route_documents(documents, routing)
    chunks = recursive_chunks(routed, keep=("file_name", "document_type", "collection"))
    return describe_chunks(chunks.withColumnRenamed("file_name", "source"))


def write_collections(chunks: DataFrame, path: str) -> None:
    """Replace the collections present in ``chunks``."""
    (
        chunks.hint("rebalance", "collection")
        .write.partitionBy("collection")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def upsert_collections(stored: DataFrame, incoming: DataFrame, path: str) -> None:
    """Write the union of both tables to ``path``, the incoming row winning for equal chunk ids.

    ``path`` must not be the folder ``stored`` is read from: files are never replaced while they
    are still being read.
    """
    merged = upsert_latest(
        stored.withColumn("_version", F.lit(0)), incoming.withColumn("_version", F.lit(1)), "chunk_id", "_version"
    )
    write_collections(merged.drop("_version"), path)


CHUNK = "collection string, chunk_id string, source string, document_type string, chunk_index int, region string, chunk string, ordinal long"


def open_collections(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketStore:
    """The newest version of the chunk store at ``path``; an empty one if there is none yet."""
    return BucketStore(spark, path, T.StructType.fromDDL(CHUNK), buckets, cluster=("collection", "chunk_id"))


def upsert_chunks(store: BucketStore, chunks: DataFrame) -> None:
    """Upsert chunks by collection and id into ``store``; the last ``ordinal`` wins.

    Columns that ``chunks`` lacks are null. Other buckets than those of the incoming ids stay as they are.
    """
    fields = T.StructType.fromDDL(CHUNK).fields
    columns = [F.col(f.name).cast(f.dataType) if f.name in chunks.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    upsert(store, chunks.select(*columns), ("collection", "chunk_id"), "ordinal")
