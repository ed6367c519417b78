"""Session construction and the staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tarnwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE stays on so that joins are re-planned on measured sizes and skewed partitions are split;
    times are UTC because observation dates are.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is chosen only in local mode; on a cluster every executor must see the
    folder, so a missing setting is an error there rather than a silent fallback.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tarnwatch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Removes the shuffle files of every query that is made and runs inside as soon as it has ended.

    Otherwise they stay until the driver happens to collect its garbage, so the files of one step
    stand beside those of the next.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame, name: str, added_to: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, with the rows of the staged table ``added_to``.

    Used where a costly result feeds several consumers: the lineage is cut, lost executors re-read
    files instead of recomputing, and later reads keep column pruning and filter pushdown.
    """
    files = added_to.inputFiles() if added_to is not None else []
    path = files[0].rsplit("/", 1)[0] if files else f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.mode("append" if files else "error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 8 << 20


def without_blind_broadcast(exploded: DataFrame, source: DataFrame, copies: float) -> DataFrame:
    """``exploded``, kept from being broadcast unless it is surely small.

    The planner does not count the copies an explode makes, so it may take a large side for a small
    one. The estimate of ``source`` times ``copies`` bounds the real size; above the limit the join
    is a sort-merge join, which adaptive execution splits where it is skewed.
    """
    estimate = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return exploded if estimate * copies <= BROADCAST_BYTES else exploded.hint("merge")


#: Tables up to this size in memory are sent to every task where the other side must not move.
SMALL_BYTES = 64 << 20
#: Most bytes in memory of one byte in a columnar file of numbers.
IN_MEMORY = 8


def small_side(stored: DataFrame) -> DataFrame:
    """``stored``, a table just read from files, with a broadcast hint if it is surely small; else itself."""
    estimate = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return stored.hint("broadcast") if estimate * IN_MEMORY <= SMALL_BYTES else stored
