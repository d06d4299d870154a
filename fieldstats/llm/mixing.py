"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.llm.common import WORD, computed, hash_number, hex_hash, as_key, running_start, settled

#: Hexadecimal digits of the buckets a source is laid out in.
BUCKET_DIGITS = 3
#: Blocks that the smallest target above zero has at least, where it has as many words.
LEAST_BLOCKS = 100


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """Per source: ``source_size``, ``place`` in code-point order (null last), ``target``.

    The weights repeat along that order and divide ``share`` of all sizes; no target
    exceeds ``repeats`` times its source. What is above goes to the others by weight:
    with c_i the cap and w_i the weight, sorted by c_i / w_i, the common level is the
    largest (goal - caps before i) / (weights from i on), and target_i = min(c_i, w_i *
    level). Works on one row per source.
    """
    alone = Window.partitionBy(F.lit(0))
    named = (
        sized.groupBy("_source")
        .agg(F.sum("_size").alias("source_size"))
        .withColumn("place", F.row_number().over(alone.orderBy(F.col("_source").asc_nulls_last())) - 1)
        .withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1))
        .withColumn("_cap", (F.col("source_size") * repeats).cast("double"))
    )
    by_ratio = alone.orderBy(F.col("_cap") / F.col("_weight"), "place")
    goal = F.sum("source_size").over(alone) * F.lit(share)
    level = (goal - F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "_weight"
    ).over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        named.withColumns({"_level": level, "_goal": goal})
        .withColumn("_level", F.max("_level").over(alone))
        .withColumn("target", F.least("_cap", F.col("_weight") * F.col("_level")))
        .select("_source", "place", "source_size", "target", "_goal")
    )


def apportion(targets: DataFrame, house: str, seats: str, target: str = "target") -> DataFrame:
    """Adds ``quota``: seats by the highest quotients target / (2k - 1), per house.

    A source's seats lie within n / 2 + 1 of its exact share, n being the number of
    sources, so only those quotients are ranked; the seats below them are certain. Ties
    go to the earlier ``place``. The seats of a house are all given out.
    """
    of_house = Window.partitionBy(house)
    n = F.count("*").over(of_house)
    share = F.try_divide(F.col(target), F.sum(target).over(of_house))
    spread = share * n / 2 + 1
    near = targets.withColumns({"_exact": F.coalesce(share * F.col(seats), F.lit(0.0)), "_spread": F.coalesce(spread, F.lit(0.0))}).withColumn(
        "_sure", F.greatest(F.lit(0).cast("long"), F.floor(F.col("_exact") - F.col("_spread")))
    )
    ranked = (
        near.withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.ceil(F.col("_exact") + F.col("_spread")) + 1)))
        .withColumn("_quotient", F.col(target) / (2 * F.col("_k") - 1))
        .withColumn("_rank", F.row_number().over(of_house.orderBy(F.col("_quotient").desc(), "place", "_k")))
    )
    left = near.groupBy(house).agg((F.first(seats) - F.sum("_sure")).alias("_left"))
    won = (
        ranked.join(left, house)
        .filter((F.col("_rank") <= F.col("_left")) & (F.col(target) > 0))
        .groupBy(house, "place")
        .agg(F.count("*").alias("_won"))
    )
    return near.join(won, [house, "place"], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop(
        "_exact", "_spread", "_sure", "_won"
    )


def block_quotas(targets: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Integer quotas per source and output shard: ``block``, ``shard``, ``quota``.

    A block holds goal / blocks words, but no more than a hundredth (``LEAST_BLOCKS``) of
    the smallest target above zero, and at least one. A quota is within 1 + share * n / 2
    blocks of its exact share, n being the number of sources, so a source is taken within
    about 1.5 % of its target, or within a few words, however large the others are. The
    number of blocks costs nothing: only quotients near the exact shares are ranked. Houses grow shard by shard, and as
    Sainte-Lague never takes a seat back when a house grows, a shard's quota is the
    difference to the house before.
    """
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy(F.lit(0)))
    most = F.least(F.floor(F.col("_goal") / blocks), F.floor(smallest / LEAST_BLOCKS))
    sized = targets.withColumn("block", F.greatest(F.lit(1).cast("long"), most))
    houses = sized.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn(
        "_seats", F.floor(F.floor(F.col("_goal") / F.col("block")) * (F.col("shard") + 1) / shards)
    )
    through = Window.partitionBy("place").orderBy("shard")
    return (
        apportion(houses, "shard", "_seats")
        .withColumn("quota", F.col("quota") - F.coalesce(F.lag("quota").over(through), F.lit(0)))
        .drop("_seats")
    )


def mix_sources(
    df: DataFrame,
    id_col: str,
    source_col: str,
    size: Column,
    weights: Sequence[float],
    share: float,
    repeats: int = 2,
    shards: int = 8,
    blocks: int = 100_000,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: id, size, ``source_size``, ``target``, ``taken``, ``shards``, ``place``.

    A source's documents lie end to end in an order hashed from seed and id. That line is
    cut in equal blocks; from a seeded block on, round and round, each shard in turn takes
    the blocks of its quota, so none is taken more than ``repeats`` times, and a document at
    a cut is taken in part. ``shards`` holds (shard, taken) of the shards that take words of
    the document; ``taken`` is their sum. Everything depends on ids, sizes and the seed only: reruns agree.

    Null sources are a source of their own, last in order; null sizes count as 0; rows
    that repeat an id are documents of their own. An empty table, or one without words,
    takes nothing. Sizes are computed once and kept in the shared folder.
    """
    sized = settled(
        df.select(
            F.col(f"`{id_col}`").alias("_id"),
            F.col(f"`{source_col}`").alias("_source"),
            F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        ).withColumn("_hash", hex_hash(as_key("_id"), seed))
    )
    targets = settled(source_targets(sized, weights, share, repeats))
    cap = F.col("source_size") * repeats
    upto = F.sum("quota").over(Window.partitionBy("place").orderBy("shard"))
    arcs = (
        block_quotas(targets, shards, blocks)
        .withColumn("_to", F.least(upto * F.col("block"), cap))
        .groupBy("_source", "place", "source_size", "target", "block")
        .agg(F.array_sort(F.collect_list(F.struct("shard", "_to"))).alias("_arcs"))
        .withColumn("_length", F.greatest(F.col("source_size"), F.lit(1)))
        .withColumn(
            "_from",
            hash_number(hex_hash(F.col("place").cast("string"), seed)) % F.ceil(F.col("_length") / F.col("block")) * F.col("block"),
        )
        .drop("block")
    )
    known = sized.join(arcs, sized["_source"].eqNullSafe(arcs["_source"])).drop(arcs["_source"])
    laid = running_start(
        known.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS)),
        ["place"],
        "_bucket",
        ["_hash", "_id", "_size"],
        F.col("_size"),
        "_at",
    )

    def before(stop: Column) -> Column:
        """Words of the document among the first ``stop`` of its source's line, round and round."""
        rounds = F.floor(stop / F.col("_length"))
        return rounds * F.col("_size") + F.greatest(F.lit(0), F.least(stop - rounds * F.col("_length") - F.col("_at"), F.col("_size")))

    def of_shard(arc: Column, i: Column) -> Column:
        start = F.coalesce(F.get("_arcs", i - 1)["_to"], F.lit(0))
        return F.struct(arc["shard"].alias("shard"), (before(F.col("_from") + arc["_to"]) - before(F.col("_from") + start)).alias("taken"))

    laid = computed(laid, _shards=F.filter(F.transform("_arcs", of_shard), lambda x: x["taken"] > 0))
    return laid.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.aggregate("_shards", F.lit(0).cast("long"), lambda a, x: a + x["taken"]).alias("taken"),
        F.col("_shards").alias("shards"),
        F.col("_source").alias(source_col),
        "place",
    )


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
