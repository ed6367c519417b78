"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every task hashes its texts and cuts its hashes by owner (a range of the hash space). Each piece
   is sorted and Golomb-Rice coded, about a byte or two per hash beyond the cost of distinguishing
   the owners' ranges, and staged as one row.
2. Owners decode the pieces of their range and answer each with a bitmap: bit i says that hash i of
   the piece occurs elsewhere too. A hash repeated inside a piece is sent once with a local mark, so
   a text that makes up a third of all rows costs one hash per piece.
3. The senders' duplicate hashes become a filter of fixed size. A second scan sends on only the
   texts that may be suspects; they are grouped by hash and by their bytes, which is the verification.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.bits import bit_filter, passes, rice_decode, rice_encode
from tarnwatch.session import stage

SPACES = b" \t\n\x0b\x0c\r"
#: Rows an owner should hold; sets the number of owners.
ROWS_PER_OWNER = 1 << 21
#: Hashes a sender gathers before it sends a piece to every owner.
ROWS_PER_PIECE = 1 << 17

PIECE = "piece string, owner int, blob binary, local binary"
ANSWER = "piece string, owner int, answer binary"
ROW = "doc_id long, fingerprint long, n_points long, text_sha256 string, bytes binary"


def normalised(texts: pa.Array) -> Iterator[bytes]:
    """Text bytes without white space (``[\\x20\\x09-\\x0D]``); null counts as empty."""
    for text in texts.cast(pa.binary()):
        yield (text.as_py() or b"").translate(None, SPACES)


def _pieces(owners: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

        def send() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            owner = ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
            cuts = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
            rows = [(f"{task}-{serial}", o, rice_encode(values[a:b]), np.packbits(counts[a:b] > 1).tobytes())
                    for o, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                ["piece", "owner", "blob", "local"])

        for batch in batches:
            held.append(np.fromiter((xxhash.xxh3_64_intdigest(t) for t in normalised(batch.column(0))), np.uint64, batch.num_rows))
            size += batch.num_rows
            if size >= ROWS_PER_PIECE:
                yield send()
                serial, held, size = serial + 1, [], 0
        if size:
            yield send()

    return pieces


def _answers(pieces: pa.Table) -> pa.Table:
    """An owner's bitmaps: for each piece, which of its hashes any other piece holds or repeats."""
    blobs = [rice_decode(b.as_py()) for b in pieces["blob"]]
    local = [np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(v)) for m, v in zip(pieces["local"], blobs)]
    order = np.argsort(values := np.concatenate(blobs), kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    marks = np.concatenate(local)
    marks[order[1:][same]] = 1
    marks[order[:-1][same]] = 1
    cuts = np.cumsum([len(v) for v in blobs])[:-1]
    answer = [np.packbits(m).tobytes() for m in np.split(marks, cuts)]
    return pa.table([pieces["piece"], pieces["owner"], pa.array(answer, pa.binary())], ["piece", "owner", "answer"])


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sender's duplicate hashes, read from its own piece and the owner's bitmap."""
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        for blob, answer in zip(batch.column("blob"), batch.column("answer")):
            values = rice_decode(blob.as_py())
            found.append(values[np.unpackbits(np.frombuffer(answer.as_py(), np.uint8), count=len(values)) == 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["fingerprint"])


def _rows(words):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(normalised(batch.column(1)))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
            keep = passes(words.value, hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(hashes.view(np.int64)),
                    pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([t if k else None for t, k in zip(texts, keep)], pa.binary()),
                ],
                ["doc_id", "fingerprint", "n_points", "text_sha256", "bytes"],
            )

    return rows


def owners_for(rows: int, rows_per_owner: int = ROWS_PER_OWNER) -> int:
    """Number of owners: in proportion to the rows, and enough to occupy small clusters."""
    return max(64, -(-rows // rows_per_owner))


def suspect_fingerprints(documents: DataFrame, rows_per_owner: int = ROWS_PER_OWNER) -> DataFrame:
    """Hashes (signed 64 bit) that more than one row of ``documents.text`` has, with repeats."""
    texts = documents.select("text")
    pieces = stage(texts.mapInArrow(_pieces(owners_for(texts.count(), rows_per_owner)), PIECE), "dedup-pieces")
    answers = pieces.groupBy("owner").applyInArrow(_answers, ANSWER)
    return pieces.select("piece", "owner", "blob").join(answers, ["piece", "owner"]).mapInArrow(_suspects, "fingerprint long")


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes without ``[\\x20\\x09-\\x0D]`` are. The row with the most
    code points in its original text stays, then the one with the smallest ``doc_id`` (null last).

    Defined cases: null text counts as empty, and all empty texts are one group; rows that repeat a
    ``doc_id`` count in ``group_size``, and all rows with the surviving id are marked kept; an empty
    table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = spark.sparkContext.broadcast(bit_filter(suspect_fingerprints(rows), "fingerprint"))
    read = stage(rows.mapInArrow(_rows(words), ROW), "dedup-rows")
    # One number orders a group: most code points first, then the smallest id, null after all ids.
    rank = F.expr(f"cast(n_points as decimal(20,0)) * {2**64}BD + {2**63}BD - coalesce(cast(doc_id as decimal(20,0)), {2**63}BD)")
    by_bytes = (
        read.where(F.col("bytes").isNotNull())
        .withColumn("rank", rank.cast("decimal(38,0)"))
        .groupBy("fingerprint", "bytes")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("rank"))
        .where("group_size > 1")
    )
    groups = by_bytes.select(
        "fingerprint",
        F.sha2("bytes", 256).alias("text_sha256"),
        "group_size",
        F.expr(f"if(rank % {2**64}BD > 0, cast({2**63}BD - rank % {2**64}BD as long), null)").alias("keep_id"),
    )
    out = read.drop("bytes", "n_points").join(groups, ["fingerprint", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
