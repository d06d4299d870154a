"""Exact duplicates by whole content, safe for copies of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.common import SPACE


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(df: DataFrame, id_col: str, content: Column, salts: int = 16, digest: Column | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    Equal contents form a group; the smallest id stays. Three combining steps compare
    whole contents beside the digest: the map side of the first grouping (local copies
    fold before the shuffle), digest and salt, then the salts' winners of a digest. So
    what a task sees of one content is a row per salt and map task, not the copies. Rows
    get their group through a join on the digests, which Spark may split by row where a
    digest is hot; the group side holds one row per digest pair. That pair is proven to
    stand for one content only, and the query fails rather than mixing two.

    Null content joins the empty ones. Null ids never win over others; a group of null
    ids alone keeps null. Rows that repeat an id and content are all counted, and are
    all marked kept if the id stays. Empty tables give empty results; other columns of
    ``df`` are not read.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), content.alias("_content")).select(
        "_id",
        "_content",
        (F.sha2(F.col("_content"), 256) if digest is None else digest).alias("_digest"),
        F.xxhash64("_content").alias("_second"),
    )
    salted = rows.groupBy("_digest", "_second", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_content").agg(
        F.min("_id").alias("_keep"), F.count("*").alias("_n")
    )
    winners = salted.groupBy("_digest", "_second", "_content").agg(
        F.min("_keep").alias("_keep"), F.sum("_n").alias("_n")
    )
    pair = F.concat_ws(":", F.col("_digest"), F.hex("_second"))
    groups = (
        winners.groupBy("_digest", "_second")
        .agg(F.min("_keep").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_contents"))
        .select(
            pair.alias("_pair"),
            "keep_id",
            F.when(F.col("_contents") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two contents share both digests")))
            .alias("group_size"),
        )
    )
    return (
        rows.select("_id", "_digest", pair.alias("_pair"))
        .join(groups, "_pair")
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("_digest").alias("digest"),
        )
    )
