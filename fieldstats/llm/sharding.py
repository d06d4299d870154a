"""Weighted rendezvous sharding of records by a stable key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.common import as_key, hash_number, hex_hash, running_start

#: Hexadecimal digits of the buckets in which a shard is numbered: 16^3 buckets a shard.
BUCKET_DIGITS = 3


def _score(key: Column, shard: int, weight: float) -> Column:
    """Rendezvous score -w / ln(u), u in (0, 1) from 52 bits of the hash of key and shard."""
    u = (hash_number(hex_hash(key, f"shard{shard}")) + F.lit(0.5)) / F.lit(float(2**52))
    return F.lit(float(weight)) / -F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard with the highest score for ``key``.

    A score depends on the key, on the shard's number and on its weight alone. A shard
    that is added at the end takes rows only into itself; a shard that goes gives up
    only its own rows; shard j gets the share weights[j] / sum(weights).
    """
    scores = [F.struct(_score(key, j, w).alias("s"), F.lit(-j).alias("j")) for j, w in enumerate(weights)]
    return -F.array_max(F.array(*scores))["j"]


def shard_rows(df: DataFrame, keys: Sequence[str], weights: Sequence[float], grown: Sequence[float] = ()) -> DataFrame:
    """Adds ``shard``, ``slot`` (gapless from 0 in its shard) and ``grown_shard``.

    ``grown`` lists the weights of shards added behind the present ones; without it
    ``grown_shard`` equals ``shard``. Rows with the same key, null keys too, share a
    shard and still get slots of their own. An empty table gives an empty table. Columns
    of ``df`` with the names of the results are replaced; ``_key``, ``_bucket``, ``_start`` and
    ``_n`` are left out.
    """
    key = as_key(*keys)
    placed = (
        df.drop("shard", "slot", "grown_shard", "_key", "_bucket", "_start", "_n")
        .withColumn("_key", key)
        .withColumns(
            {
                "shard": shard_of(F.col("_key"), weights),
                "_bucket": F.substring(hex_hash(F.col("_key"), "slot"), 1, BUCKET_DIGITS),
            }
        )
        .withColumn("grown_shard", shard_of(F.col("_key"), [*weights, *grown]) if grown else F.col("shard"))
    )
    return running_start(placed, ["shard"], "_bucket", ["_key"], F.lit(1), "slot").drop("_key", "_bucket")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder a shard; a shard is written by many tasks, its rows keep their slots."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)
