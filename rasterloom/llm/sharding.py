"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, from two hashes of its
name.  The shards take turns; at its turn a shard claims the first slot of its preference
that is still free, until the table is full.  All shards then hold the same number of slots,
give or take one, and a shard more or less moves few slots of the others.

The table is filled once on the driver (its size is a setting, whatever the data), becomes
a table of (slot, shard) and is broadcast: placing a row is one hash and one lookup, without
a shuffle, so a hot source or key makes no difference.

Defined cases: a null key is placed like the empty text, so all null keys share a shard;
equal keys share a shard; an empty table stays empty; other columns pass through, but
columns named like the output are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def number(text: str) -> int:
    """52 bits of a digest, as SQL engines can take them too."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """Index of the shard that holds each slot."""
    if not is_prime(slots) or not shards or slots < len(shards) or len(set(shards)) < len(shards):
        raise ValueError("slots must be a prime, at least as many as there are different shards")
    at = [number(f"start:{s}") % slots for s in shards]
    step = [1 + number(f"step:{s}") % (slots - 1) for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            if not left:
                break
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
    return table


def lookup(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """(slot, shard_no, shard) of every slot, made by JVM expressions from one literal."""
    numbers = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return (spark.range(1).select(F.posexplode(numbers).alias("slot", "no"))
            .select("slot", F.col("no").cast("int").alias("shard_no"), F.element_at(names, F.col("no").cast("int") + 1).alias("shard")))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Add slot, shard_no and shard."""
    held = lookup(df.sparkSession, shards, slots)
    return df.drop("shard_no", "shard").withColumn("slot", slot_of(key, slots)).join(F.broadcast(held), "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, each written by as many tasks as hold its rows."""
    placed.write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, F.col("doc_id")).select("doc_id", "slot", "shard_no", "shard")


def op9_sql() -> str:
    """The lookup in SQL; the filled table is stated as a list."""
    return f"""
with t as (select unnest(range({SLOTS}))::int as slot, unnest({fill(SHARDS)}) as shard_no),
d as (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint % {SLOTS})::int as slot from documents)
select doc_id, d.slot, shard_no::int as shard_no, 'shard-' || lpad(shard_no::varchar, 3, '0') as shard from d join t using (slot)
"""
