"""Sharding by a permutation-filled lookup table.

Every shard ranks all slots of a prime-sized table by its own permutation; shards take turns, each claiming the first
slot of its ranking that is still free, until the table is full. A key's slot is a hash modulo the prime, so a placement
is one lookup in a broadcast table, shards get equal numbers of slots (to one), and few keys move when a shard comes or
goes.

Defined results: a null key is placed like the empty string; equal keys share a shard; repeated rows stay repeated; an
empty input gives an empty output; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime; the table has as many rows, whatever the size of the data, so that broadcasting it is bounded (about 1 MB).
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


@lru_cache(maxsize=8)
def fill_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> tuple[int, ...]:
    """Slot -> index of its shard. Bounded work on the driver: size steps of a few probes each."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime not below the number of shards")
    starts = [_number(f"start:{s}") % size for s in shards]
    steps = [_number(f"step:{s}") % (size - 1) + 1 for s in shards]
    table, at, left = [-1] * size, list(starts), size
    while left:
        for i in range(min(len(shards), left)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + steps[i]) % size
            table[at[i]] = i
            left -= 1
    return tuple(table)


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """slot int, shard string; made by SQL from one literal, no RDD."""
    names = F.array(*map(F.lit, shards))
    flat = F.split(F.lit(",".join(map(str, fill_table(tuple(shards), size)))), ",")
    return spark.range(1, numPartitions=1).select(F.posexplode(flat).alias("slot", "i")).select("slot", F.element_at(names, F.col("i").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """60 bits of the key's MD5, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: Column | str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with slot int and shard string. A map-side join with the broadcast table: no shuffle, so no key is hot."""
    key = F.col(key) if isinstance(key, str) else key
    placed = df.withColumn("slot", slot_of(key, size))
    return placed.drop("shard").join(F.broadcast(lookup_table(df.sparkSession, shards, size)), "slot")


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id").select("doc_id", "slot", "shard")


def oracle() -> str:
    """The filled table stands in the SQL as a literal; tests/llm check the filling itself against a plain version."""
    flat = ",".join(map(str, fill_table(SHARDS, TABLE_SIZE)))
    return f"""
    WITH t AS (SELECT string_split('{flat}', ',') AS flat),
    d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {TABLE_SIZE})::INT AS slot
          FROM documents)
    SELECT doc_id, slot, 'shard-' || lpad(flat[slot + 1], 3, '0') AS shard FROM d, t"""
