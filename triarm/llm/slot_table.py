"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, a permutation made from two
hashes of its name. The shards take turns, each claiming the next free slot it prefers, until the table is
full: the shards get equally many slots (within one), and when a shard goes, few slots of others move. A
row goes to slot ``hash(key) mod size``; one lookup in the broadcast table says whose it is.
"""

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Slots times 16 bytes is what a placement broadcasts, at most.
MAX_SLOTS = 1_000_003


@dataclass(frozen=True)
class SlotTable:
    """``owners[slot]`` is the number of the shard in ``shards``."""

    shards: tuple[str, ...]
    owners: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(slot, shard)``, one row per slot."""
        owners = F.split(F.lit(",".join(map(str, self.owners))), ",")
        names = F.array(*map(F.lit, self.shards))
        rows = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
        return rows.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n ** 0.5) + 1))


def build_table(shards: list[str], size: int = 65_537) -> SlotTable:
    """Fill the table. ``size`` is a prime of at most ``MAX_SLOTS``, no less than the number of shards.

    Repeated shard names, no shards, and other sizes are refused.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need different names, one at least")
    if not _is_prime(size) or not len(shards) <= size <= MAX_SLOTS:
        raise ValueError(f"size must be a prime from {len(shards)} to {MAX_SLOTS}")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    place = [int(d[:15], 16) % size for d in digests]
    step = [int(d[15:30], 16) % (size - 1) + 1 for d in digests]
    owners, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            while owners[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % size
            owners[place[shard]] = shard
            free -= 1
            if not free:
                break
    return SlotTable(tuple(shards), tuple(owners))


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the table size. NULL counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, table: SlotTable, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``.

    Rows with equal keys, NULL keys among them, get one shard; no rows give no rows. Columns of ``df`` with
    the two new names are replaced. Nothing is shuffled: the table, whose size is bounded, is broadcast.
    """
    kept = df.drop(*(name for name in (slot, shard) if name != key))
    found = kept.withColumn("_slot_", slot_of(F.col(f"`{key}`"), len(table.owners)))
    slots = table.frame(df.sparkSession).toDF("_at_", "_shard_")
    joined = found.join(F.broadcast(slots), F.col("_slot_") == F.col("_at_"), "left")
    columns = [F.col(f"`{name}`") for name in kept.columns if name not in (slot, shard)]
    return joined.select(*columns, F.col("_slot_").alias(slot), F.col("_shard_").alias(shard))


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 1) -> None:
    """One folder per shard. A shard's rows are dealt to ``files_per_shard`` tasks, whatever their keys are."""
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns]), F.lit(files_per_shard))
    placed.withColumn("_part_", spread).repartition(shard, "_part_").drop("_part_").write.partitionBy(shard).parquet(path)
