"""Sharding by a permutation-filled lookup table: constant-time placement that moves few keys when shards change.

Each shard has a preference order over the slots of a prime-sized table (an offset and a stride from its name's hash) and
the shards take turns to claim their next free slot, a shard of weight w claiming w slots a turn. The table is broadcast
(``table_size`` rows, a parameter of at most ``MAX_TABLE``) and a row goes to slot ``hash(key) mod table_size``: no shuffle,
and no shard gets more than its part of the keys, however they are distributed.

Defined results: keys are placed by their string form, so repeated rows and ties share a shard; a null key is placed like the
empty string; very long keys and texts are of no account; an empty table gives no rows; input columns named ``slot`` or ``shard``
are replaced, others are kept whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Slots of the production table and its shards: about 1000 slots a shard keep shards within 0.1 % of each other.
TABLE_SIZE = 65_537
SHARDS = 64
#: The largest table that is broadcast, 16 bytes a slot.
MAX_TABLE = 4_000_000


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _hash(name: str, seed: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str] | dict[str, int], table_size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard in the order of names; shards may carry integer weights from 1 on."""
    weights = dict.fromkeys(shards, 1) if not isinstance(shards, dict) else shards
    names = sorted(weights)
    if not names or min(weights.values()) < 1:
        raise ValueError("there must be a shard, and weights from 1 on")
    if not _is_prime(table_size) or table_size > MAX_TABLE or table_size < sum(weights.values()):
        raise ValueError(f"table_size must be a prime up to {MAX_TABLE} with a slot for each unit of weight")
    at = [_hash(n, "offset") % table_size for n in names]
    stride = [_hash(n, "stride") % (table_size - 1) + 1 for n in names]
    table, free = [-1] * table_size, table_size
    while True:
        for i, name in enumerate(names):
            for _ in range(weights[name]):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + stride[i]) % table_size
                table[at[i]] = i
                free -= 1
                if not free:
                    return table


def slot(key: str | Column, table_size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its string form, modulo the table's size."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(table_size)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | dict[str, int] | None = None, table_size: int = TABLE_SIZE) -> DataFrame:
    """df with slot and shard; the columns of df keep their names."""
    names = sorted(shards if shards is not None else shard_names(SHARDS))
    filled = lookup_table(shards if shards is not None else names, table_size)
    spark = df.sparkSession
    # The table travels as one array of a few hundred kilobytes and is unfolded by Spark.
    slots = spark.createDataFrame([(filled, names)], "filled array<int>, names array<string>").select(F.posexplode("filled").alias("slot", "_i"), "names")
    lookup = slots.select("slot", F.get("names", F.col("_i")).alias("shard"))
    base, back = common.inner_names(df.drop("slot", "shard"), key)
    return base.withColumn("slot", slot(F.col(f"`{key}`"), table_size)).join(F.broadcast(lookup), "slot", "left").select(*back, "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: list[str] | dict[str, int] | None = None, table_size: int = TABLE_SIZE) -> None:
    """Writes df as Parquet with one folder for each shard."""
    place(df, key, shards, table_size).write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return place(common.table(spark, sf_dir, "documents").select("doc_id"))
