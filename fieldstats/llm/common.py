"""Loading, hashing, shared-folder checkpoints and distributed running sums."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by the query contracts: a word, and what separates words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a few numbers in a partition of ``gathered``.
_ROWS_TOGETHER = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``.

    Every executor can read that folder, so a lost executor costs nothing. Where the
    session names no folder (tests on one machine) a temporary one is set.
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir") is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def gathered(df: DataFrame, together: int = _ROWS_TOGETHER, parallel: bool = False) -> DataFrame:
    """``settled(df)`` in partitions of ``together`` rows: one, or the session's cores at least.

    For tables that may be small however large their source is: later steps start no task,
    and write no shuffle files, for each next to empty partition. What stands in one partition
    is grouped and joined with its like without any shuffle, so the driver has no map outputs
    and task events of such steps to hold. With ``parallel`` there are never fewer partitions
    than cores, for rows that later steps work hard on.
    """
    kept = settled(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = -(-kept.coalesce(cores).count() // together)
    return kept.coalesce(max(cores, parts) if parallel or parts > 1 else 1)


def as_key(*columns: str) -> Column:
    """The columns as one string; null is told apart from every text."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns])


def hex_hash(key: Column, seed: str) -> Column:
    """32 hexadecimal digits that any SQL engine gives too."""
    return F.md5(F.concat(key, F.lit(f":{seed}")))


def hash_number(hexadecimal: Column, digits: int = 13) -> Column:
    """The first digits of a hexadecimal text as a long."""
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("long")


def running_start(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that come before.

    Rows are ordered by ``bucket``, then by ``order``. Sums of whole buckets are
    added up first (one row a bucket), so a group is never sorted in one task, however
    large: a task sorts (group, bucket) only. ``group`` and ``bucket`` hold no nulls.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, keys)
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .select(*df.columns, name)
    )


class IdFilter:
    """A Bloom filter of ids, with 16 bits for each of them.

    It lets every id of the table pass, and about one of 400 others; whoever uses it still
    compares ids exactly. The driver and the tasks hold its bits, never the ids: at most
    2^28, which beyond 16 million ids lets more others pass (one of 7 with 64 million).
    """

    MOST_BITS, HASHES = 1 << 28, 4

    def __init__(self, ids: DataFrame, column: str) -> None:
        self.bits = min(self.MOST_BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
        words = (
            ids.select(F.explode(self.places(F.col(column))).alias("bit"))
            .groupBy(F.shiftright("bit", 5).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
            .toArrow()
        )
        held = np.zeros(self.bits // 32, np.uint32)
        held[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
        self.words = ids.sparkSession.sparkContext.broadcast(held)

    def places(self, value: Column) -> Column:
        """Where the bits of a value are, for ``passing``."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), value), F.lit(self.bits)) for i in range(self.HASHES)])

    def _test(self) -> Callable[[np.ndarray], np.ndarray]:
        words, hashes = self.words, self.HASHES

        def test(places: np.ndarray) -> np.ndarray:
            bits = places.reshape(-1, hashes)
            return (words.value[bits >> 5] >> (bits & 31).astype(np.uint32) & np.uint32(1)).astype(bool).all(1)

        return test

    def may_hold(self, value: Column) -> Column:
        """False for values that are certainly none of the ids.

        Declared nondeterministic: else a join on the value has Spark test the other side too,
        in Python workers of its own, though that side holds the ids themselves.
        """
        test = self._test()

        @F.pandas_udf("boolean")
        def tested(places: pd.Series) -> pd.Series:
            return pd.Series(test(np.concatenate([np.zeros(0, np.int64), *places.to_numpy()])))

        return tested.asNondeterministic()(self.places(value))

    def passing(self) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """For use in a task's own function, so that it needs no second Python worker: the rows of
        a batch whose last column, ``places`` of a value, says that it may be an id; without it."""
        test = self._test()

        def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
            fit = test(batch.column(batch.num_columns - 1).flatten().to_numpy())
            batch = batch.select(range(batch.num_columns - 1))
            return batch if fit.all() else batch.filter(pa.array(fit))

        return passed


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions use as values.

    Catalyst may write a column's expression into the expressions that use it, even
    inside a function over array elements, where it would run once per element. What a
    generator gives out is never written back.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
