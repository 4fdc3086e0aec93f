"""Contiguous shards of nearly equal bytes from a global prefix sum.

Only (doc_id, size, crc32) leave the scan; the texts are never shuffled.  The narrow rows are
range-partitioned by document id, as many to a range as one task holds, and written once.  One
total for each range is summed into offsets and joined back, so the
running byte position of each document needs a window over its own range only, never one over
all rows.  A document goes to the shard in whose equal target interval its middle byte lies:
shards are contiguous in id order and differ from the target by less than one document.

Defined cases: a null text has size 1 (its end byte) and the crc32 of no bytes; rows with a
null id sort first; equal ids are ordered by crc32, size and then position in the input, so
repeated rows each get their own slot and one hot id is spread over ranges; a text larger than
a shard's target leaves a neighbouring shard empty; an empty table gives an empty result; further
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import numbered, written


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus one for the end of the document."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(rows: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Adds ``shard`` (0 .. n_shards-1) and ``slot`` (gapless from 0 in each shard).

    ``rows`` should be narrow: it is shuffled by range once and written.
    """
    names = [f"`{c}`" for c in rows.columns if c not in ("shard", "slot")]
    placed = numbered(rows, order, {"__start": size}, row="__row")
    whole = rows.agg(F.coalesce(F.sum(size), F.lit(1)).alias("__all"))
    shard = F.least(F.lit(n_shards - 1), F.expr(f"((2 * __start + `{size}`) * {n_shards}) div (2 * __all)")).cast("int")
    sharded = placed.crossJoin(F.broadcast(whole)).select(*names, "__row", shard.alias("shard"))  # one row
    sharded = written(sharded, "shard-rows")
    firsts = sharded.groupBy("shard").agg(F.min("__row").alias("__least"))  # n_shards rows
    return sharded.join(F.broadcast(firsts), "shard").select(*names, "shard", (F.col("__row") - F.col("__least")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    narrow = docs.select("doc_id", byte_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    return shard_by_bytes(narrow, n_shards, ["doc_id", "text_crc32", "size"])


def op2(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The contract's columns."""
    return shard_documents(docs, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
