"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4099  # a prime, over a hundred slots for each of up to 40 shards


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> list[int]:
    """Which shard (by its place in ``shards``) owns each of ``slots`` slots.

    Every shard prefers the slots ``(offset + k * skip) mod slots``, its own permutation as ``slots`` is prime. The
    shards take turns, each claiming the first slot of its preference that is free (a shard of weight w claims w a
    turn), so that shares differ by one turn at most, and few slots change hands when a shard comes or goes.
    """
    names = list(shards)
    weight = [int(shards[s]) if isinstance(shards, Mapping) else 1 for s in names]
    if not names or len(set(names)) < len(names) or min(weight) < 1:
        raise ValueError("shards must be distinct names with weights of at least 1")
    if not _prime(slots) or slots < sum(weight):
        raise ValueError("slots must be a prime, and at least the sum of the weights")
    walk = []
    for s in names:
        h = hashlib.md5(s.encode()).digest()
        walk.append([int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1])
    table, left = [-1] * slots, slots
    while left:
        for i, w in enumerate(weight):
            for _ in range(w):
                if not left:
                    break
                at, skip = walk[i]
                while table[at] >= 0:
                    at = (at + skip) % slots
                table[at] = i
                walk[i][0] = (at + skip) % slots
                left -= 1
    return table


def table_frame(spark: SparkSession, shards: Sequence[str] | Mapping[str, int], slots: int = SLOTS) -> DataFrame:
    """The table as a frame of ``slot`` and ``shard``; ``slots`` rows, whatever is placed."""
    names = F.array(*[F.lit(s) for s in shards])
    owners = F.lit(",".join(map(str, lookup_table(shards, slots))))
    rows = spark.range(1).select(F.posexplode(F.split(owners, ",")).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("long"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def key_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of its text's MD5, modulo ``slots`` (a null key counts as the empty text)."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, shards: Sequence[str] | Mapping[str, int], key: str = "doc_id", slots: int = SLOTS, salt: str | None = None, salts: int = 1) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; every row is placed by its key alone, without a shuffle.

    The table of ``slots`` rows is broadcast, so that the placement costs the same at any number of rows. A key that
    holds a large share of the rows may be spread over ``salts`` shards by a second column ``salt``: its hash modulo
    ``salts`` then goes into the hash. Null keys are placed like the empty text; equal keys (and salts) go to one
    shard; an empty table gives no rows. Existing columns named ``slot`` or ``shard`` are replaced.
    """
    own = F.col(key).cast("string")
    if salt is not None:
        own = F.concat(F.coalesce(own, F.lit("")), F.lit("/"), key_slot(F.col(salt), salts).cast("string"))
    rows = df.drop(*[c for c in ("slot", "shard") if c != key and c in df.columns]).withColumn("__slot", key_slot(own, slots))
    table = table_frame(df.sparkSession, shards, slots).select(F.col("slot").alias("__s"), F.col("shard").alias("__owner"))
    joined = rows.join(F.broadcast(table), F.col("__slot") == F.col("__s"), "left").drop("__s")
    return joined.withColumnRenamed("__slot", "slot").withColumnRenamed("__owner", "shard")


def write_shards(placed: DataFrame, path: str, files: int = 4) -> None:
    """Write a placed frame as Parquet folders ``shard=...``, each of ``files`` files: a large shard is written by several tasks."""
    spread = F.pmod(F.xxhash64(*[c for c in placed.columns if c not in ("slot", "shard")]), F.lit(files))
    n = max(1, placed.select("shard").distinct().count()) * files
    placed.repartition(n, "shard", spread).write.mode("overwrite").partitionBy("shard").parquet(path)
