"""Sharding by jump consistent hashing, in DataFrame functions only.

A stable key is hashed to 64 bits; the jump recurrence then walks at most as many
steps as there are shards and needs no ring table. When shards are appended, a key
either stays or moves into one of the new shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import col, text_of

# Fixed values of the published recurrence: the multiplier of its 64-bit generator.
MULTIPLIER = 2862933555777941757

#: Slots that one record of a repeated row is spread into at a time.
RANGE = 100_000

_LOW16, _LOW32 = 0xFFFF, 0xFFFFFFFF
_A_LOW, _A_HIGH = MULTIPLIER & _LOW32, MULTIPLIER >> 32


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64 on 32-bit halves; no product leaves 63 bits, so ANSI mode is safe."""
    first = low.bitwiseAND(F.lit(_LOW16)) * F.lit(_A_LOW) + 1
    second = F.shiftrightunsigned(low, 16) * F.lit(_A_LOW) + F.shiftrightunsigned(first, 16)
    new_low = F.shiftleft(second.bitwiseAND(F.lit(_LOW16)), 16) + first.bitwiseAND(F.lit(_LOW16))
    cross = _times32(low, _A_HIGH) + _times32(high, _A_LOW) + F.shiftrightunsigned(second, 16)
    return cross.bitwiseAND(F.lit(_LOW32)), new_low


def _times32(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 for 32-bit x."""
    low = x.bitwiseAND(F.lit(_LOW16)) * F.lit(factor)
    high = (F.shiftrightunsigned(x, 16) * F.lit(factor)).bitwiseAND(F.lit(_LOW16))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_LOW32))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a 64-bit integer key.

    Every step raises the candidate by at least one, so ``shards`` steps always suffice.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_LOW32)).alias("low"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("jump"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        jump = ((state["jump"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + 1).cast("double"))).cast("long")
        going = state["jump"] < shards
        return F.struct(
            F.when(going, high).otherwise(state["high"]).alias("high"),
            F.when(going, low).otherwise(state["low"]).alias("low"),
            F.when(going, state["jump"]).otherwise(state["shard"]).alias("shard"),
            F.when(going, jump).otherwise(state["jump"]).alias("jump"),
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    # The loop keeps the last candidate below the number of shards.
    return walked["shard"].cast("int")


def md5_key(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a key: well mixed, and any SQL engine can compute it."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's key; equal keys share a shard, null keys hash as a key of their own.

    A column named ``out`` is replaced. No shuffle.
    """
    return df.withColumn(out, jump_hash(md5_key(F.coalesce(col(key).cast("string"), F.lit("null key"))), shards))


def number_slots(df: DataFrame, order: list[str], chunks: int = 4096) -> DataFrame:
    """Gapless slots from 0 in each ``shard``, without gathering a shard in one task.

    Equal rows are first counted together, so a row repeated without bound costs one
    record; the rows of a shard are then numbered in ``chunks`` hashed chunks, and each chunk
    starts where those before it end (``chunks`` x shards offsets in all). Repeated rows get a
    slot each.
    """
    parts = [col(c) for c in order]
    counted = (
        df.groupBy(*[col(c) for c in df.columns])
        .agg(F.count("*").alias("_n"))
        .withColumn("_chunk", F.pmod(md5_key(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), F.lit(chunks)).cast("int"))
    )
    rows = Window.partitionBy("shard", "_chunk").orderBy(*[c.asc_nulls_first() for c in parts]).rowsBetween(Window.unboundedPreceding, 0)
    sizes = counted.groupBy("shard", "_chunk").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = counted.withColumn("_last", F.sum("_n").over(rows)).join(offsets, ["shard", "_chunk"])
    first = F.col("_offset") + F.col("_last") - F.col("_n")
    # A row repeated without bound is spread in two steps, ranges and then slots, so that no record holds more than RANGE of them.
    ranges = placed.select(*[col(c) for c in df.columns], (first + F.col("_n")).alias("_end"), F.explode(F.sequence(first, first + F.col("_n") - 1, F.lit(RANGE))).alias("_start"))
    slots = F.explode(F.sequence("_start", F.least(F.col("_start") + RANGE, F.col("_end")) - 1)).alias("slot")
    return ranges.select(*[col(c) for c in df.columns], slots)


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Digest of sharding documents by doc_id: size, text_crc32, law, shard, slot and grown_shard.

    The law is ``key``: doc_id and the shard count alone decide. Null texts count as empty
    (size 1), null ids form one key, repeated rows get slots of their own, an empty table gives no rows
    and other columns are ignored.
    """
    text = text_of()
    slim = documents.select(
        col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(slim, "doc_id", shards)
    slotted = number_slots(placed, ["doc_id", "size", "text_crc32"])
    grown = assign_shards(slotted, "doc_id", shards + 1, "grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
