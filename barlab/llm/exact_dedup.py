"""Exact deduplication by a Golomb-coded fingerprint exchange.

Each input partition sends, to the owner of each fingerprint range, its distinct fingerprints as one sorted
Golomb-coded block. Owners answer with one bit per fingerprint: seen elsewhere (or twice in the partition) or not.
Fingerprints with that bit are the suspects. A second scan tells suspect rows from the rest; only suspect texts are
shuffled, each distinct one once a partition, and compared byte by byte. Other texts never leave the scan, whatever
the number of suspects: blocks are kept by slices of the input's files, and where the suspects of all are too many to be
sent to every task, the second scan goes slice by slice, each with the answers to its own blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import ascii_lower, shuffle_partitions, staged, table

#: Fingerprints per owner that one task decodes at once.
PER_OWNER = 2_000_000
#: Bits beyond log2(rows): about one text in 2**SPARE_BITS is shuffled without having a copy.
SPARE_BITS = 12
#: Suspect fingerprints broadcast to a scan at once, about (8 bytes each); with more the files are scanned in several parts.
BROADCAST_PRINTS = 2_000_000
#: Slices of the files (by hash of their path): the parts of the second scan are made of them.
SLICES = 4096
#: A text that this part of all rows hold is hot: at most 1 / HOT_PART of them are broadcast, so that their rows stay
#: where they are.
HOT_PART = 1e-4

_SENT_TYPES = dict(sender=pa.int64(), slice=pa.int32(), owner=pa.int32(), block=pa.binary(), twice=pa.binary())


def _sender(bits: int, span: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if not held:
            return
        prints, slices = (np.concatenate(c) for c in zip(*held))
        for slice_ in np.unique(slices).tolist():
            distinct, counts = np.unique(prints[slices == slice_].view(np.uint64), return_counts=True)
            sender = TaskContext.get().partitionId() * SLICES + slice_
            for owner, a, b in exchange.by_owner(distinct, span):
                row = (sender, slice_, owner, exchange.coded(distinct[a:b], owner, span), exchange.bitmap(counts[a:b] > 1))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SENT_TYPES.values())], names=list(_SENT_TYPES))

    return send


def _answer(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each block of one owner, a bitmap of the fingerprints that another block, or this one twice, also holds."""
    weights = [1.0 + exchange.flags(twice, exchange.size_of(block)) for block, twice in zip(blocks["block"], blocks["twice"])]
    totals = exchange.sums_over_blocks(list(blocks["block"]), weights)
    return pd.DataFrame({"sender": blocks["sender"], "owner": blocks["owner"], "again": [exchange.bitmap(t > 1) for t in totals]})


def _suspects(span: int):
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slice_, owner, block, again in zip(batch["slice"], batch["owner"], batch["block"], batch["again"]):
                prints = exchange.decoded(block, owner, span)
                found = prints[exchange.flags(again, len(prints))].view(np.int64)
                yield pd.DataFrame({"slice": np.full(len(found), slice_, np.int32), "print": found})

    return expand


def _of_files(docs: DataFrame) -> bool:
    """Whether rows know the file they come from."""
    try:
        docs.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", broadcast_prints: int = BROADCAST_PRINTS, hot_part: float = HOT_PART) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id is kept; a null id is below every other and comes back as null. Rows repeated with the same id and
    text all count in group_size and share one verdict. Other columns are ignored. An empty table gives no rows."""
    spark = docs.sparkSession
    if not _of_files(docs):
        docs = staged(docs.select(key, text), "docs")
    total = docs.select(key).count()
    owners = max(shuffle_partitions(spark), -(-total // PER_OWNER))
    bits = min(60, max(16, total.bit_length() + SPARE_BITS, owners.bit_length() + 4))
    span = exchange.span_of(bits, owners)
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    slice_ = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(SLICES)).cast("int")
    rows = docs.select(F.col(key).cast("long").alias("id"), norm.alias("norm"), slice_.alias("slice"))
    rows = rows.withColumn("print", F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits))
    sent = staged(rows.select("print", "slice").mapInArrow(_sender(bits, span), "sender long, slice int, owner int, block binary, twice binary"), "sent")
    answers = sent.groupBy("owner").applyInPandas(_answer, "sender long, owner int, again binary")
    suspects = staged(
        sent.select("sender", "slice", "owner", "block").join(answers, ["sender", "owner"]).select("slice", "owner", "block", "again")
        .mapInPandas(_suspects(span), "slice int, print bigint").distinct(), "suspects"
    )
    parts = max(1, -(-suspects.count() // max(1, broadcast_prints)))
    told = None
    for part in range(min(parts, SLICES)):
        # What a file's rows are asked depends on its path alone, so other files aren't read.
        own = lambda df, c: df if parts == 1 else df.where(c % parts == part)  # noqa: E731,B023
        marked = own(suspects, F.col("slice")).select("print", F.lit(True).alias("suspect")).distinct()
        scanned = own(docs, slice_).select(F.col(key).cast("long").alias("id"), norm.alias("norm")).withColumn("print", F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits))
        scanned = scanned.join(F.broadcast(marked), "print", "left")
        digest = F.unhex(F.sha2("norm", 256)).alias("digest")
        found = scanned.select("id", digest, F.coalesce("suspect", F.lit(False)).alias("suspect"), F.when(F.col("suspect"), F.col("norm")).alias("norm"))
        found = staged(found, f"told{part}")
        told = found if told is None else told.unionByName(found)
    found = told.where("suspect").select("id", "digest", "norm")
    # Texts with their digest: one row a partition and distinct text is shuffled.
    texts = found.groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    one = F.when(F.count(F.lit(1)) == 1, F.max("keep_id")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")))
    groups = staged(texts.groupBy("digest").agg(one.alias("keep_id"), F.sum("n").alias("n")), "groups")
    # Rows of hot texts meet their group by broadcast; a join by digest would gather them in one task.
    hot = groups.where(F.col("n") >= max(2.0, hot_part * total))
    ids = told.where("suspect").select("id", "digest")
    judged = (
        ids.join(F.broadcast(hot), "digest")
        .unionByName(ids.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups, "digest"))
        .unionByName(told.where("not suspect").select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
    )
    return judged.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
