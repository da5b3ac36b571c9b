"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gneiss.llm.common import Scratch, per_batch

#: Fixed values of the jump hash: its linear congruential step.
JUMP_MULTIPLIER = 2862933555777941757
JUMP_SCALE = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, vectorised over the keys still jumping."""
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(keys), np.int64)
    at, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = at[live]
            state[live] = state[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            at[live] = ((at[live] + 1).astype(np.float64) * (JUMP_SCALE / draw)).astype(np.int64)
            live = live[at[live] < shards]
    return shard


def with_shards(rows: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """``rows`` with one int column per entry of ``counts``: the key's shard of so many."""
    names = list(counts)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.IntegerType()) for n in names)])
    at = rows.columns.index(key)

    def run(batch):
        keys = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        new = [pa.array(jump_hash(keys, counts[n]).astype(np.int32)) for n in names]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return rows.mapInArrow(per_batch(run), schema)


def shard(docs: DataFrame, shards: int = 24, buckets: int = 64) -> DataFrame:
    """Place of every row of ``docs(doc_id, text)``: shard, slot, and the shard among one more.

    The law is ``key``: the jump hash of ``doc_id`` and the shard count decide, no ring
    table is kept, and appending a shard moves rows only into it. ``slot`` numbers a
    shard's rows from 0 without gaps, in the order of a hash bucket, doc_id and
    checksum: rows are numbered within (shard, bucket), so no task sorts a whole
    shard, and offsets come from ``shards * buckets`` counts, which is the bound of
    what is broadcast. Texts do not move; a row is carried as about 40 bytes.

    Null text has size 8 and checksum 0; a null doc_id hashes as 0; repeated rows and
    equal keys share a shard and get different slots. Empty tables give no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = with_shards(rows, "doc_id", {"shard": shards, "grown_shard": shards + 1})
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    rows = Scratch(docs.sparkSession, "sharding").cut(rows)
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), "grown_shard")
