"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are summed per source, target words are set by weight under a cap, and whole blocks of words
are dealt to the sources by highest quotients. A source's blocks are dealt to its shards by the same
rule, so each shard knows an integer quota and picks its blocks alone, by a seeded permutation of
its block numbers. Everything is a DataFrame expression; the only global orders run over one row per
source, or over the few boundary quotients of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.words import WORD, n_words
from tarnwatch.session import stage

#: Words in a block, the unit of apportionment.
BLOCK_WORDS = 64
#: Load (words plus 64 per document) a shard should hold.
SHARD_LOAD = 1 << 18
#: Multiplier of the block permutation: a prime above any number of blocks in a shard.
STRIDE = 2147483647


def hashed(*parts: Column) -> Column:
    """32 bits of the md5 of the parts joined by a slash (null: empty), as a long."""
    text = F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def capped_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Adds ``target`` to rows of ``source, source_size``.

    Sources in code-point order (null last) weigh ``weights``, repeating. ``share`` times all sizes
    is split by weight; a target stops at ``cap`` times its source's size and the excess is shared
    again by weight. That fixed point is ``min(cap, level * weight)``, whose level is the largest
    one reached when the sources are filled in order of cap by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight.cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * cap)
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    goal = F.sum("source_size").over(everything) * F.lit(share)
    left = goal - F.coalesce(F.sum("most").over(before), F.lit(0))
    still = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        ranked.withColumn("level", left / still)
        .withColumn("goal", goal)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
        .drop("level", "most", "weight")
    )


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group dealt by the highest quotients votes / (2k + 1).

    With n parties, total votes V and S seats, the common divisor lies between V / (S + n/2) and
    V / (S - n/2). So the quotients below each party's lower bound are surely granted and those past
    its upper bound surely not; only the ones between, about three per party, are ranked. Ties go by
    ``order``. Groups without votes get no seats.
    """
    whole = Window.partitionBy(*group)
    total, n = F.sum(votes).over(whole), F.count(F.lit(1)).over(whole)
    bound = lambda s: F.floor(F.col(votes) * s / F.col("_total") + 0.5)
    bounded = (
        parties.withColumn("_total", total.cast("double"))
        .withColumn("_n", n)
        .withColumn("_low", F.when(F.col(votes) > 0, F.greatest(F.lit(0), bound(F.col(seats) - F.col("_n") / 2) - 1)).otherwise(0).cast("long"))
        .withColumn("_high", F.when(F.col(votes) > 0, bound(F.col(seats) + F.col("_n") / 2) + 1).otherwise(0).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    )
    keys = list(dict.fromkeys(group + order))
    quotients = (
        bounded.where(F.col("_high") > F.col("_low"))
        .select(*keys, "_open", votes, F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(
            F.desc(F.col(votes) / (2 * F.col("_k") + 1)), *(F.col(c).asc_nulls_last() for c in order), "_k")))
        .where(F.col("_rank") <= F.col("_open"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    won = quotients.select(*(F.col(c).alias(f"_r_{c}") for c in keys), "_won")
    match = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    joined = bounded.join(won, match, "left")
    return joined.withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop(
        "_total", "_n", "_low", "_high", "_open", "_won", *(f"_r_{c}" for c in keys))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    block_words: int = BLOCK_WORDS,
    shard_load: int = SHARD_LOAD,
    seed: int = 0,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken, passes, parts``.

    ``taken`` counts the words the mix takes of the row, repeats included: ``passes`` whole rounds
    of its shard and the ``parts`` (word numbers) that lie in the shard's selected blocks. It never exceeds ``cap`` times
    ``size``. Block numbers are permuted by an affine map seeded per shard, so reruns agree.

    Defined cases: null text has size 0; a null source is a source of its own, last in order; rows
    repeating a ``doc_id`` are separate rows; sources without words get target 0; an empty table
    gives an empty result; other columns are not read.
    """
    sizes = stage(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            n_words(F.col("text").cast("string")).alias("size"),
        ),
        "mix-sizes",
    )
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    load = F.col("source_size") + 64 * F.col("n_docs")
    sources = (
        capped_targets(per_source, weights, share, cap)
        .withColumn("seats", F.floor(F.col("goal") / block_words + 0.5))
        .withColumn("n_shards", F.greatest(F.lit(1), F.ceil(load / shard_load)).cast("long"))
    )
    sources = stage(
        sainte_lague(sources, [], "target", "seats", ["rank"]).select("source", "source_size", "target", "n_shards", "quota"),
        "mix-sources",
    )
    named = sources.select(F.col("source").alias("_source"), "source_size", "target", "n_shards", F.col("quota").alias("source_quota"))
    sharded = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "shard", F.pmod(hashed(F.lit(seed), F.col("doc_id")), F.col("n_shards"))
    )
    shards = sharded.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("source_quota").alias("seats"))
    blocks = F.greatest(F.lit(1), F.floor(F.col("words") / block_words + 0.5)).cast("long")
    quotas = sainte_lague(shards, ["source"], "words", "seats", ["shard"]).select(
        F.col("source").alias("_s"), F.col("shard").alias("_h"), "words", blocks.alias("blocks"),
        F.least(F.col("quota"), cap * blocks).alias("quota"),
    )
    line = Window.partitionBy("source", "shard").orderBy(
        F.md5(F.concat_ws("/", F.lit(f"order/{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "doc_id", "size"
    ).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sharded.withColumn("end", F.sum("size").over(line))
        .join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
        .withColumn("begin", F.col("end") - F.col("size"))
        .withColumn("passes", F.expr("quota div blocks"))
        .withColumn("extra", F.expr("quota % blocks"))
        .withColumn("shift", hashed(F.lit(f"blocks/{seed}"), F.col("source"), F.col("shard")))
        # block j holds the words from floor(j * words / blocks) on
        .withColumn("first", F.expr("((begin + 1) * blocks - 1) div words"))
        .withColumn("last", F.expr("(end * blocks - 1) div words"))
    )
    chosen = F.expr(f"""CASE WHEN size > 0 AND extra > 0 THEN transform(
        filter(sequence(first, last), j -> (j * {STRIDE}L + shift) % blocks < extra),
        j -> struct(cast(greatest(begin, j * words div blocks) - begin as int) AS start,
                    cast(least(end, (j + 1) * words div blocks) - begin as int) AS stop)) END""")
    overlap = F.expr(
        f"""CASE WHEN size = 0 THEN 0L WHEN extra = 0 THEN 0L ELSE aggregate(sequence(first, last), 0L, (total, j) -> total +
        CASE WHEN (j * {STRIDE}L + shift) % blocks < extra
             THEN least(end, (j + 1) * words div blocks) - greatest(begin, j * words div blocks) ELSE 0L END) END"""
    )
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + overlap).alias("taken"),
        F.when(F.col("size") > 0, F.col("passes")).otherwise(0).cast("long").alias("passes"),
        F.coalesce(chosen, F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("parts"),
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``documents``: a row per whole pass, and one for the parts.

    A document taken twice is there twice; the words of its selected blocks, joined by spaces, are a
    further row. ``n_chars``, if there, is the length of the new text. Documents of which no word is
    taken are gone, so are those without words. Rows that repeat a ``doc_id`` are told apart by size.
    """
    taken = mix(documents, **options).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "passes", "parts")
    taken = taken.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_size").orderBy("passes", F.size("parts"))))
    # input rows travel as one struct, so their columns may have any names
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    words = F.regexp_extract_all(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    rows = rows.withColumn("_words", n_words(F.col("row.text").cast("string")))
    rows = rows.withColumn("_nth_row", F.row_number().over(Window.partitionBy("row.doc_id", "_words").orderBy("row.text")))
    joined = rows.join(taken, F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size")) & (F.col("_nth_row") == F.col("_nth")))
    copies = F.expr("concat(array_repeat(false, cast(passes as int)), if(size(parts) > 0, array(true), cast(array() as array<boolean>)))")
    cut = F.concat_ws(" ", F.flatten(F.transform("parts", lambda p: F.slice(words, p["start"] + 1, p["stop"] - p["start"]))))
    text = F.when(F.col("_partial"), cut).otherwise(F.col("row.text"))
    exploded = joined.withColumn("_partial", F.explode(copies)).withColumn("_text", text)
    columns = [
        F.col("_text").alias("text") if c == "text" else F.length("_text").cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c)
        for c in documents.columns
    ]
    return exploded.select(*columns)
