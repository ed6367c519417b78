"""Shards of near equal size by longest-processing-time scheduling of groups.

Rows of one group stay together. Groups are dealt from the largest weight to the smallest, each to
the least-loaded shard (ties: the lower shard number). Groups of one weight are interchangeable, so
the schedule needs only the number of groups of each weight:

1. Weights are summed per group with partial aggregates, and groups are counted per weight. Distinct
   weights w sum to at most the total T, so there are at most sqrt(2 T) of them: a few hundred
   thousand for 30 GB, a few million for 10 TB.
2. One task streams these counts in falling order of weight past a heap of shard loads. A run of
   equal groups is dealt in one step: the lowest load level up to which whole rounds fit is found by
   bisection, the rest of the run (at most one group per shard) goes through the heap. The result
   equals pushing and popping once per group.
3. Groups are ranked within their weight by a distributed sort; a group's shard follows from its
   rank and the counts each shard takes of that weight.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.ranks import ranked
from tarnwatch.session import stage

#: ``stops[k]``: how many of the weight's groups go to shards 0 to k together.
DEALT = "weight long, stops array<long>"


def deal(loads: list[int], weight: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``weight`` each shard takes; ``loads`` are brought up to date."""
    taken = [0] * len(loads)
    left = count
    if count > 2 * len(loads) and weight > 0:
        def up_to(level: int) -> int:
            return sum((level - load) // weight + 1 for load in loads if load <= level)

        # the highest level whose pops, all those at loads up to it, are no more than the run has
        low, high = min(loads) - 1, min(loads) + weight * count
        while low < high:
            level = (low + high + 1) // 2
            low, high = (level, high) if up_to(level) <= count else (low, level - 1)
        for shard, load in enumerate(loads):
            if load <= low:
                taken[shard] = (low - load) // weight + 1
                loads[shard] += taken[shard] * weight
        left -= sum(taken)
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(left):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + weight, shard))
        taken[shard] += 1
        loads[shard] += weight
    return taken


def _schedule(shards: int):
    def schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [0] * shards
        for batch in batches:
            stops = []
            for weight, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, line = 0, []
                for taken in deal(loads, weight, count):
                    total += taken
                    line.append(total)
                stops.append(line)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stops, pa.list_(pa.int64()))], ["weight", "stops"])

    return schedule


def schedule(counts: DataFrame, shards: int) -> DataFrame:
    """``weight, stops`` from ``weight, groups``; one task, at most sqrt(2 x total weight) rows."""
    ordered = counts.select("weight", "groups").repartition(1).sortWithinPartitions(F.desc("weight"))
    return ordered.mapInArrow(_schedule(shards), DEALT)


def group_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``group, shard`` for every group of ``rows`` (columns ``group``, ``size``; sizes above 0)."""
    groups = rows.groupBy("group").agg(F.sum("size").cast("long").alias("weight"))
    groups = stage(groups, "shard-groups")
    dealt = stage(schedule(groups.groupBy("weight").agg(F.count(F.lit(1)).alias("groups")), shards), "shard-schedule")
    places = ranked(groups, "weight", [F.col("group")], "shard-ranks")
    shard = F.size(F.expr("filter(stops, stop -> stop <= pos)"))
    return places.join(dealt, "weight").select("group", shard.alias("shard"))


def lpt_shards(docs: DataFrame, group: Column, size: Column, shards: int = 8, order: list[Column] | None = None) -> DataFrame:
    """``docs`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within the shard).

    ``group`` (compared as given; take a digest of long values) keeps rows together, ``size`` is the
    positive weight of a row, ``order`` ranks the rows of a shard (ties, and by default: by group).

    Defined cases: null is one group; an empty table gives an empty result; repeated rows are kept,
    each with its own slot; fewer groups than shards leave shards empty; columns named ``shard`` or ``slot`` are replaced,
    all others are passed on, whatever they are called.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    by = order if order is not None else []
    keys = [F.col(f"o{i}") for i in range(len(by))]
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        group.alias("group"), size.cast("long").alias("size"), *(o.alias(f"o{i}") for i, o in enumerate(by)),
    )
    packed = stage(packed, "shard-rows")
    where = group_shards(packed.select("group", "size"), shards)
    placed = packed.join(where.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).drop("of", "size")
    slots = ranked(stage(placed, "shard-placed"), "shard", [*keys, F.col("group")], "shard-slots")
    return slots.select("row.*", "shard", F.col("pos").alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1 << 20) -> DataFrame:
    """Write one folder per shard, rows in slot order, and return ``shard, files, rows`` as written.

    Files hold up to ``rows_per_file`` consecutive slots, so a large shard is written by many tasks.
    """
    file = F.floor(F.col("slot") / rows_per_file)
    cut = sharded.withColumn("file", file.cast("long"))
    n_files = max(1, cut.select("shard", "file").distinct().count())
    (
        cut.repartitionByRange(n_files, "shard", "file").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard", "file").parquet(path)
    )
    written = sharded.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("rows")).orderBy("shard")
