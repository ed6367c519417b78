"""Merkle manifest of a dataset: leaves, proofs and roots by lag and lead windows.

Leaves stand in order within their key (a source). While a key has several nodes, every ``arity``
consecutive ones become the digest of their digests; the last run may be shorter, down to one node.
What remains is the key's subroot; the subroots, in order of their keys, form one more tree.

All levels of an aligned block of ``arity ** levels`` leaves are computed with one partitioning and
one sort, so a key of any size is cut into blocks of bounded size. At level l the nodes stand at the
rows whose place is a multiple of ``arity ** l`` (their first leaf). Lag and lead columns at the
fixed offsets 1 .. arity - 1 times ``arity ** l`` reach the other nodes; the node's slot in its run
and the length of the run mask what belongs to another run. Rows at slot 0 hash the parent. A running
``last`` hands both down to the other leaves of the node. Block tops are the leaves of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.ranks import ranked
from tarnwatch.session import stage

#: Levels per round: 3 ** 7 = 2187 rows stay below the 4096 that a window holds in memory.
LEVELS = 7
ARITY = 3
STEPS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(*columns: Column) -> Column:
    """Digest of the values' text forms, each with its byte count; null is ``-``."""
    def field(column: Column) -> Column:
        text = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(field, columns)))


def fold(start: Column, steps: Column) -> Column:
    """The top reached from a node's digest with the siblings of every level on its way."""
    return F.aggregate(steps, start, lambda below, step: digest(F.concat(step["left"], below, step["right"])))


def siblings(steps: Column) -> Column:
    """All sibling digests of a proof, level by level, left to right."""
    return F.concat_ws("", F.transform(steps, lambda step: F.concat(step["left"], step["right"])))


def _round(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    """``nodes`` (key, pos, key_rows, node) with ``block``, the block's ``top`` and the ``steps`` to it."""
    pos, count = F.col("pos"), F.col("key_rows")
    out = nodes.withColumn("block", F.floor(pos / F.lit(arity**levels)).cast("long")).withColumn("top", F.col("node"))
    rows = Window.partitionBy("key", "block").orderBy("pos")
    handed = rows.rowsBetween(Window.unboundedPreceding, 0)
    for level in range(levels):
        width = arity**level
        slot = F.floor(pos / width) % arity
        several = count > width  # more than one node at this level
        run = F.least(F.lit(arity), F.ceil(count / width) - (F.floor(pos / width) - slot))
        # the only node at a first leaf's left or right by i, if it is of the same run
        left = [F.when(slot >= i, F.lag("top", i * width).over(rows)) for i in range(arity - 1, 0, -1)]
        right = [F.when(slot + i < run, F.lead("top", i * width).over(rows)) for i in range(1, arity)]
        first = several & (pos % width == 0)
        out = out.withColumn("step", F.when(first, F.struct(F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))))
        parent = F.when(first & (slot == 0), digest(F.concat(F.col("step.left"), F.col("top"), F.col("step.right"))))
        out = out.withColumn("parent", parent)
        out = out.withColumn(f"step{level}", F.last("step", ignorenulls=True).over(handed)).withColumn(
            "top", F.when(several, F.last("parent", ignorenulls=True).over(handed)).otherwise(F.col("top"))
        )
    steps = F.filter(F.array(*(F.col(f"step{level}") for level in range(levels))), lambda step: step.isNotNull())
    return out.select(*nodes.columns, "block", "top", steps.cast(STEPS).alias("steps"))


def climb(nodes: DataFrame, name: str, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """``nodes`` (key, pos, key_rows, node) with their ``steps`` to the top of their key, and ``top``.

    Every round reads nodes once and hands on one in ``arity ** levels``; the rounds end when every
    key has one node left, so their number is the logarithm of the largest key.
    """
    size, block = arity**levels, F.floor(F.col("pos") / F.lit(arity**levels))
    largest = nodes.agg(F.max("key_rows")).first()[0] or 0
    done = stage(_round(nodes, levels, arity), f"{name}-round")
    if largest <= size:
        return done.drop("block")
    tops = done.where(F.col("pos") % size == 0).select(
        "key", F.col("block").alias("pos"), F.ceil(F.col("key_rows") / size).alias("key_rows"), F.col("top").alias("node")
    )
    above = climb(tops, name, levels, arity).select(
        F.col("key").alias("_key"), F.col("pos").alias("_block"), F.col("steps").alias("_steps"), F.col("top").alias("_top")
    )
    joined = done.join(above, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    return joined.select(*nodes.columns, F.concat("steps", "_steps").alias("steps"), F.col("_top").alias("top"))


def manifest(leaves: DataFrame, order: list[Column], levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """``leaves`` (string ``key`` and ``node``, the leaf's digest, plus any columns) with their proofs.

    Adds ``pos`` (place in the key by ``order``, then by digest), ``subroot``, ``root`` and ``steps``:
    per level up to the root the digests left and right of the node in its run. ``fold(node, steps)``
    is the root, unless the leaf was changed.

    Defined cases: null is a key and comes first; keys are ordered by their UTF-8 bytes; rows equal
    in key, order and digest are leaves of their own; a single leaf is its subroot, a single subroot
    the root; an empty table gives an empty result. Other columns are passed on, but for those named
    ``pos``, ``subroot``, ``root`` or ``steps``, which are replaced.
    """
    kept = [c for c in leaves.columns if c not in ("pos", "subroot", "root", "steps")]
    packed = leaves.select("key", "node", F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), *(o.alias(f"o{i}") for i, o in enumerate(order)))
    packed = stage(packed, "merkle-leaves")
    keys = [F.col(f"o{i}") for i in range(len(order))]
    placed = stage(ranked(packed, "key", [*keys, F.col("node")], "merkle-order").select("row", "key", "pos", "key_rows", "node"), "merkle-placed")
    lower = climb(placed, "merkle", levels, arity)
    subroots = lower.where("pos = 0").select(F.lit("").alias("all"), "key", "top")
    ordered = ranked(stage(subroots, "merkle-subroots"), "all", [F.col("key")], "merkle-keys")
    ordered = stage(ordered.select(F.col("key").alias("of"), F.col("all").alias("key"), "pos", "key_rows", F.col("top").alias("node")), "merkle-sources")
    roots = climb(ordered, "merkle-root", levels, arity).select("of", F.col("top").alias("root"), F.col("steps").alias("last"))
    joined = lower.join(roots, F.col("key").eqNullSafe(F.col("of")))
    return joined.select("row.*", "pos", F.col("top").alias("subroot"), "root", F.concat("steps", "last").alias("steps"))
