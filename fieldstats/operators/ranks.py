"""Average ranks and the rank tests built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.functions.tails import chi_square_upper, normal_upper
from fieldstats.kept import kept
from fieldstats.names import any_names
from fieldstats.operators.joins import join_stats
from fieldstats.operators.positions import (
    LEAST,
    ROWS_PER_SEGMENT,
    SEGMENT,
    Positions,
    counted,
    locate,
    present,
    ranked_cells,
    segmented,
    sortable,
)


# Groups of a stratum that one task pairs with all others.
GROUPS_PER_PART = 256
# Bits of twice a rank that are added apart.
_LOW_BITS = 20


def _mid_rank() -> Column:
    return F.col("before") + (F.col("ties") + F.lit(1)) / F.lit(2.0)


def rank_table(pos: Positions) -> DataFrame:
    """One row per stratum and distinct value: ``mid_rank``, ``n`` and ``total``."""
    return ranked_cells(pos).select(
        *pos.groups, pos.value, "n", "total", _mid_rank().alias("mid_rank")
    )


@any_names
def mid_rank(
    df: DataFrame,
    strata: Sequence[str],
    value: str,
    rank_col: str = "mid_rank",
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Rank of every row inside its stratum; ties share their average rank.

    Rows with a missing value or stratum are dropped.
    """
    strata = list(strata)
    rows = present(df.withColumn("_v", sortable(df, value)), [*strata, "_v"])
    pos = locate(rows, strata, "_v", rows_per_segment=rows_per_segment)
    ranks = rank_table(pos).select(
        *strata, "_v", F.col("mid_rank").alias("_rank")
    )
    joined = join_stats(rows, ranks, [*strata, "_v"])
    return joined.select(*df.columns, F.col("_rank").alias(rank_col))


def _label_ranks(
    cells: DataFrame, strata: list[str], sides: Mapping[str, Sequence[str]], group: str, value: str, rows_per_segment: int
) -> DataFrame:
    """Per side, stratum and group: size, mean rank, and the group's part of the tie term.

    ``cells`` (kept) hold strata, label columns, value and a count ``n``. The label columns of a
    side are ranked together, a row once for each of its labels that is present. The cells
    are sorted once for all sides.

    Twice the rank is a whole number, so the rank sums are exact: its upper bits and its
    lower 20 bits are added apart, as longs (up to 2^40 rows; more end the query). A tie of t
    values adds t^3 - t, that is t^2 - 1 for each of its rows.
    """
    weights = {
        f"_w{i}": F.col("n") * sum((F.col(f"`{c}`").isNotNull().cast("long") for c in columns), F.lit(0))
        for i, columns in enumerate(sides.values())
    }
    cells = segmented(cells, value, rows_per_segment, LEAST).withColumns(weights)
    keys = [*strata, SEGMENT]
    by_stratum = Window.partitionBy(*(strata or [F.lit(0)]))
    earlier = by_stratum.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy(*keys).agg(*[F.sum(w).alias(w) for w in weights]).select(
        *keys,
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"_offset{w}") for w in weights],
        *[F.sum(w).over(by_stratum).alias(f"_total{w}") for w in weights],
    )
    inside = Window.partitionBy(*keys).orderBy(value)
    same = inside.rangeBetween(Window.currentRow, Window.currentRow)
    sums = {f"_upto{w}": F.sum(w).over(inside) for w in weights} | {f"_ties{w}": F.sum(w).over(same) for w in weights}
    ranked = cells.withColumns(sums).join(offsets, keys, "inner")

    def line(side: str, label: str, w: str) -> Column:
        twice = F.lit(2) * (F.col(f"_offset{w}") + F.col(f"_upto{w}")) - F.col(f"_ties{w}") + F.lit(1)
        parts = {"_side": F.lit(side), group: F.col(f"`{label}`"), "n": F.col("n"), "total": F.col(f"_total{w}"), "_twice": twice}
        return F.struct(*[v.alias(k) for k, v in parts.items()], F.col(f"_ties{w}").cast("double").alias("_ties"))

    lines = [line(side, c, w) for (side, columns), w in zip(sides.items(), weights) for c in columns]
    n, low = F.col("n"), (1 << _LOW_BITS) - 1
    upper, lower = F.col("_upper").cast("decimal(20,0)"), F.col("_lower").cast("decimal(20,0)")
    twice = upper * F.lit(1 << _LOW_BITS).cast("decimal(7,0)") + lower
    return (
        ranked.select(*strata, F.inline(F.array(*lines)))
        .filter(F.col(group).isNotNull())
        .groupBy("_side", *strata, group)
        .agg(
            F.sum("n").alias("n"),
            F.max("total").alias("total"),
            F.sum(n * F.shiftright("_twice", _LOW_BITS)).alias("_upper"),
            F.sum(n * F.col("_twice").bitwiseAND(F.lit(low))).alias("_lower"),
            F.sum(n * (F.col("_ties") * F.col("_ties") - F.lit(1.0))).alias("_tie"),
        )
        .select("_side", *strata, group, "n", "total", (twice.cast("double") / F.lit(2.0) / n).alias("mean_rank"), "_tie")
    )


def _group_ranks(
    df: DataFrame, strata: list[str], group: str, value: str, rows_per_segment: int, weight: str | None
) -> DataFrame:
    """:func:`_label_ranks` of one column of groups."""
    cells = kept(counted(df, strata, value, [group], weight))
    return _label_ranks(cells, strata, {"": [group]}, group, value, rows_per_segment).drop("_side")


@any_names
def kruskal_wallis(
    df: DataFrame,
    strata: Sequence[str],
    group: str,
    value: str,
    rows_per_segment: int = ROWS_PER_SEGMENT,
    weight: str | None = None,
) -> DataFrame:
    """Kruskal-Wallis H with tie correction per stratum.

    ``weight`` names a column of whole numbers: how many equal rows a row stands for. A stratum with a single group, or whose values are all tied, has a null H.
    """
    strata = list(strata)
    return _kruskal(_group_ranks(df, strata, group, value, rows_per_segment, weight), strata)


@any_names
def kruskal_wallis_by_label(
    cells: DataFrame,
    strata: Sequence[str],
    sides: Mapping[str, Sequence[str]],
    name: str,
    group: str,
    value: str,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """:func:`kruskal_wallis` of label columns that stand side by side, with one sort for all.

    ``cells`` are kept rows with a count ``n`` (see ``kept``). ``sides`` maps what ``name`` shall
    hold to label columns that count as one; ``group`` names the label in the result.
    """
    ranks = _label_ranks(cells, list(strata), sides, group, value, rows_per_segment).withColumnRenamed("_side", name)
    return _kruskal(ranks, [name, *strata])


def _kruskal(ranks: DataFrame, strata: list[str]) -> DataFrame:
    off_centre = F.col("mean_rank") - (F.col("total") + F.lit(1)) / F.lit(2.0)
    terms = (
        ranks.groupBy(*strata)
        .agg(
            F.max("total").cast("double").alias("_N"),
            F.count(F.lit(1)).alias("k"),
            F.sum("_tie").alias("_ties"),
            F.sum(F.col("n") * off_centre * off_centre).alias("_between"),
        )
    )
    n = F.col("_N")
    spread = F.lit(1.0) - F.col("_ties") / (n * n * n - n)
    h = F.lit(12.0) / (n * (n + 1)) * F.col("_between") / spread
    valid = (F.col("k") > 1) & (F.col("_ties") < n * n * n - n)
    dof = F.col("k") - 1
    return (
        terms.withColumn("h", F.when(valid, h))
        .withColumn("df", dof)
        .withColumn(
            "p", F.when(F.col("h").isNotNull(), chi_square_upper(F.col("h"), dof.cast("double")))
        )
        .select(*strata, n.cast("long").alias("n"), "k", "h", "df", "p")
    )


@any_names
def dunn_test(
    df: DataFrame,
    strata: Sequence[str],
    group: str,
    value: str,
    adjust: str = "bonferroni",
    rows_per_segment: int = ROWS_PER_SEGMENT,
    weight: str | None = None,
) -> DataFrame:
    """Dunn's comparison of every two groups of a stratum.

    One row per pair in alphabetical order: ``z`` (first minus second), the
    one-sided ``p`` and ``p_adjusted`` (``bonferroni``, or ``none``). The result has
    k(k-1)/2 rows per stratum by definition. Only the table of groups is paired, by a
    join on the stratum in which one side is dealt out to parts of about
    ``GROUPS_PER_PART`` groups and the other side repeated for each part. ``weight`` is
    that of :func:`kruskal_wallis`.
    """
    strata = list(strata)
    return _dunn(_group_ranks(df, strata, group, value, rows_per_segment, weight), strata, group, adjust)


@any_names
def dunn_test_by_label(
    cells: DataFrame,
    strata: Sequence[str],
    sides: Mapping[str, Sequence[str]],
    name: str,
    group: str,
    value: str,
    adjust: str = "bonferroni",
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """:func:`dunn_test` of label columns side by side; as :func:`kruskal_wallis_by_label`."""
    ranks = _label_ranks(cells, list(strata), sides, group, value, rows_per_segment).withColumnRenamed("_side", name)
    return _dunn(ranks, [name, *strata], group, adjust)


def _dunn(ranks: DataFrame, strata: list[str], group: str, adjust: str) -> DataFrame:
    if adjust not in ("bonferroni", "none"):
        raise ValueError(f"unknown adjustment {adjust!r}")
    every = Window.partitionBy(*(strata or [F.lit(0)]))
    # Both sides of the pairs read the kept table; the ranks behind it are computed once.
    groups = kept(ranks).select(
        *strata,
        F.col(group).alias("group_a"),
        F.col("n").alias("_na"),
        F.col("mean_rank").alias("_ra"),
        F.max("total").over(every).cast("double").alias("_N"),
        F.count(F.lit(1)).over(every).alias("_k"),
        F.sum("_tie").over(every).alias("_ties"),
    )
    parts = F.ceil(F.col("_k") / GROUPS_PER_PART)
    first = groups.withColumn("_part", F.pmod(F.xxhash64("group_a"), parts))
    second = groups.select(
        *strata,
        F.col("group_a").alias("group_b"),
        F.col("_na").alias("_nb"),
        F.col("_ra").alias("_rb"),
        F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"),
    )
    pairs = first.join(second, [*strata, "_part"]).filter(F.col("group_a") < F.col("group_b"))
    n = F.col("_N")
    spread = n * (n + 1) / 12 - F.col("_ties") / (F.lit(12.0) * (n - 1))
    per_pair = F.lit(1.0) / F.col("_na") + F.lit(1.0) / F.col("_nb")
    pairs = pairs.filter(F.col("_ties") < n * n * n - n).withColumn(
        "z", (F.col("_ra") - F.col("_rb")) / F.sqrt(spread * per_pair)
    )
    tests = F.col("_k") * (F.col("_k") - 1) / F.lit(2.0)
    p = normal_upper(F.abs("z"))
    adjusted = F.least(F.lit(1.0), F.col("p") * tests) if adjust == "bonferroni" else F.col("p")
    return (
        pairs.withColumn("p", p)
        .withColumn("p_adjusted", adjusted)
        .select(*strata, "group_a", "group_b", "z", "p", "p_adjusted")
    )
