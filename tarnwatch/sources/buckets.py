"""A keyed Parquet store of hashed buckets with a manifest.

Rows lie in units: a bucket of a fixed number, or a bucket and further partition columns of few
values, such as the year. A million keys therefore need no more folders than ten. A change rewrites
only the units it touches, into a folder of its own, and then publishes a manifest that names the
folder of every unit:

    <path>/data/commit=<c>/bucket=<b>/[year=<y>/]part-*.parquet
    <path>/summary/commit=<c>/part-*.parquet              one row per unit and group, if asked for
    <path>/manifest/version=<n>/part-*.parquet            unit, commit, buckets

Readers take the newest manifest and see one version of the store, whole, whatever is being written.
A manifest version can be created once; of two writers that started from the same version the second
fails and may try again. Folders that no manifest names stay until :meth:`BucketStore.vacuum`.

What reaches the driver are names of units, at most as many as the store has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
#: Rows of one key above which a batch is reduced before it is dealt by ranges.
REPEATS = 1000
MANIFEST = "unit string, commit string, buckets int"


class StaleStore(RuntimeError):
    """Another writer published a version since the store was read."""


def bucket_of(*key: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a key, from 0."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class BucketStore:
    """The newest version of the store at ``path``.

    ``schema`` are the columns of a row but for ``bucket``; ``units`` are integer partition columns,
    ``bucket`` first. ``cluster`` orders the rows of a unit: each file covers a short range of it, and
    statistics let readers skip files and row groups. ``summary`` makes the summary rows of a commit
    (with the unit columns) from its data rows.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS, units: Sequence[str] = ("bucket",),
        cluster: Sequence[str] = (), summary: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.units, self.cluster, self.summary = list(units), list(cluster), summary
        own = [f for f in schema.fields if f.name not in self.units]
        self.columns = [f.name for f in own]
        self.schema = T.StructType([*own, T.StructField("commit", T.StringType()), *(T.StructField(u, T.IntegerType()) for u in self.units)])
        self.refresh()

    def refresh(self) -> None:
        """Look at the newest version."""
        self.version, self.live = 0, {}
        try:
            rows = self.spark.read.schema(MANIFEST + ", version int").parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        newest = rows.agg(F.max("version")).first()[0]
        for row in rows.where(F.col("version") == newest).collect() if newest is not None else []:
            if row["buckets"] != self.buckets:
                raise ValueError(f"{self.path} has {row['buckets']} buckets, not {self.buckets}")
            self.version = newest
            if row["unit"] is not None:
                self.live[row["unit"]] = row["commit"]

    def unit(self) -> Column:
        """Name of a row's unit, as in its path."""
        return F.concat_ws("/", *(F.concat(F.lit(f"{u}="), F.col(u).cast("string")) for u in self.units))

    def names(self, rows: DataFrame) -> set[str]:
        """The units of some rows (with the unit columns)."""
        return {r[0] for r in rows.select(*self.units).distinct().select(self.unit()).collect()}

    def folders(self, units: Iterable[str] | None = None) -> list[str]:
        """Folders of all units, or of those named."""
        wanted = self.live if units is None else [u for u in units if u in self.live]
        return sorted(f"{self.path}/data/commit={self.live[u]}/{u}" for u in wanted)

    def read(self, units: Iterable[str] | None = None) -> DataFrame:
        """Rows with their unit columns; conditions on these prune folders, named units aren't even listed."""
        folders = self.folders(units)
        if not folders:
            return self.spark.createDataFrame([], self.schema).drop("commit")
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*folders).drop("commit")

    def summaries(self) -> DataFrame | None:
        """Summary rows of the units of this version, or None if nothing was ever written."""
        if not self.live:
            return None
        commits = sorted(set(self.live.values()))
        rows = self.spark.read.option("basePath", f"{self.path}/summary").parquet(*(f"{self.path}/summary/commit={c}" for c in commits))
        live = self.spark.createDataFrame(sorted(self.live.items()), "_unit string, _commit string")
        named = (self.unit() == F.col("_unit")) & (F.col("commit") == F.col("_commit"))
        return rows.join(live, named, "left_semi").drop("commit")

    def replace(self, rows: DataFrame, touched: Iterable[str], ranged: bool = False) -> None:
        """Make ``rows`` (with the unit columns) the whole content of the ``touched`` units.

        Rows are written by ranges of unit and cluster columns: a unit with most of the rows is
        written by many tasks. ``ranged`` rows lie in such ranges already and are not shuffled again.
        """
        touched, commit = set(touched), uuid.uuid4().hex
        if not touched:
            return
        folder, order = f"{self.path}/data/commit={commit}", [*self.units, *self.cluster]
        rows = rows.select(*self.columns, *self.units)
        placed = rows if ranged else rows.repartitionByRange(*order)
        placed.sortWithinPartitions(*order).write.partitionBy(*self.units).parquet(folder)
        schema = T.StructType([f for f in self.schema.fields if f.name != "commit"])
        stored = self.spark.read.schema(schema).parquet(folder)
        written = self.names(stored)
        if stray := written - touched:
            raise ValueError(f"rows in units {sorted(stray)[:5]}, which are not to be replaced")
        if self.summary is not None:
            self.summary(stored).write.parquet(f"{self.path}/summary/commit={commit}")
        self._publish({u: c for u, c in self.live.items() if u not in touched} | {u: commit for u in written})

    def _publish(self, live: dict[str, str]) -> None:
        rows = [(u, commit, self.buckets) for u, commit in sorted(live.items())] or [(None, None, self.buckets)]
        target = f"{self.path}/manifest/version={self.version + 1}"
        try:
            self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(target)
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise StaleStore(f"version {self.version + 1} of {self.path} was published by another writer") from taken
        self.version, self.live = self.version + 1, live

    def vacuum(self) -> int:
        """Delete the commits that the newest version doesn't name; readers of older ones must have ended."""
        self.refresh()
        hadoop, kept, gone = self.spark._jvm.org.apache.hadoop.fs, {f"commit={c}" for c in self.live.values()}, 0
        for part in ("data", "summary"):
            top = hadoop.Path(f"{self.path}/{part}")
            system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in system.listStatus(top) if system.exists(top) else []:
                if status.getPath().getName() not in kept:
                    system.delete(status.getPath(), True)
                    gone += 1
        return gone


def upsert(store: BucketStore, incoming: DataFrame, key: Sequence[str], ordinal: str) -> None:
    """Insert or replace rows by ``key``; of equal keys the row with the largest ``ordinal`` wins.

    ``ordinal`` is the order of arrival. It is stored, so rows that arrive late don't replace newer
    ones. Rows equal in key and ordinal are decided by the order of their other values. Only the
    buckets of the incoming keys are read and written.

    Rows move once: they are dealt by ranges of bucket and key, reduced there and written from there.
    An ordering of the store by other columns than the key takes a second shuffle.
    """
    placed = incoming.select(*store.columns).withColumn("bucket", bucket_of(*map(F.col, key), buckets=store.buckets))
    by, others = ["bucket", *key], [c for c in store.columns if c not in (*key, ordinal)]

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(F.max(F.struct(ordinal, *others)).alias("row")).select(*by, "row.*")

    repeats = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).groupBy("bucket").agg(F.max("rows").alias("most"))
    most = {r[0]: r[1] for r in repeats.select(store.unit(), "most").collect()}
    # a key repeated very often is reduced on the map side first and sends one row per task
    batch = newest(placed) if max(most.values(), default=0) > REPEATS else placed
    ranged = store.read(most).unionByName(batch).repartitionByRange(*by)
    store.replace(newest(ranged), most, ranged=[*store.units, *store.cluster] == by)


def remove(store: BucketStore, keys: DataFrame, key: Sequence[str]) -> None:
    """Remove the rows of the keys in ``keys``."""
    gone = keys.select(*key).distinct()
    touched = store.names(gone.select(bucket_of(*map(F.col, key), buckets=store.buckets).alias("bucket")))
    store.replace(store.read(touched).join(gone, list(key), "left_anti"), touched)
