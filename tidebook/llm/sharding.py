"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards decide the shard; there is no ring table. With one more shard,
a row either stays or moves into the new shard, and about 1/(n+1) of all rows move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import materialize, replacing, sized


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard, 0 to n_shards - 1, of each unsigned 64-bit key."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    at = np.zeros(len(key), np.int64)
    while going.size:
        shard[going] = at[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        leap = float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        at[going] = ((shard[going] + 1) * leap).astype(np.int64)
        going = going[at[going] < n_shards]
    return shard.astype(np.int32)


def key_column(df: DataFrame, keys: list[str]) -> Column:
    """One integer column is its own key; other keys are hashed to 64 bits (null too: such rows share one key)."""
    kinds = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, kinds):
        return F.coalesce(F.col(keys[0]).cast("long"), F.lit(0).cast("long"))
    return F.xxhash64(*keys)


def assign_shards(df: DataFrame, keys: list[str], n_shards: int, column: str = "shard") -> DataFrame:
    """df with the shard of each row; no shuffle. A null integer key counts as 0. Repeated keys share a shard; an empty df stays empty."""

    @F.pandas_udf("int")
    def shard_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for key in batches:
            yield pd.Series(jump_hash(key.to_numpy(np.int64).view(np.uint64), n_shards))

    at = shard_of(key_column(df, keys))
    return replacing(df, column).select("*", at.alias(column)) if column not in keys else df.withColumn(column, at)


def number_slots(df: DataFrame, shard: str, order: list[str], column: str = "slot") -> DataFrame:
    """df with a gapless number from 0 in each shard, in the order of the named columns.

    A range sort by shard and order spreads any shard over many tasks; the sorted rows are written once, and
    each task's first number comes from the counts of the tasks before it: one row for each task and shard.
    Rows equal in all the order columns are numbered in no fixed order. df should be narrow: it is written.
    """
    sort = [shard, *order]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*sort, "_tie").drop("_tie")
    rows = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "slots").withColumn("_task", F.shiftright("_at", 33))
    parts = rows.groupBy(shard, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).select(F.col(shard).alias("_s"), F.col("_task").alias("_t"), "_first", "_before")
    joined = rows.join(sized(firsts), (F.col("_s") == F.col(shard)) & (F.col("_t") == F.col("_task")))
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(column))


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; the doc_id is the key.

    A null doc_id counts as key 0; a null text has size 1 and checksum 0, as an empty one. Repeated rows
    each get a slot. Other columns are ignored. An empty table gives no rows.
    """
    data = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign_shards(rows, ["doc_id"], n_shards, "shard")
    rows = assign_shards(rows, ["doc_id"], n_shards + 1, "grown_shard")
    rows = number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, shard: str = "shard", files: int = 16) -> None:
    """df as one folder of Parquet for each shard, each of several files, so that no task writes a whole shard."""
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != shard]), F.lit(files))
    df.repartition(F.col(shard), spread).write.partitionBy(shard).parquet(path)
