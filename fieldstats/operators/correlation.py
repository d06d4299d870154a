"""Correlation, its significance, and straight-line fits for column pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.functions.domain import by_key
from fieldstats.functions.tails import student_two_sided
from fieldstats.kept import kept
from fieldstats.names import any_names
from fieldstats.operators.joins import join_stats
from fieldstats.operators.positions import ROWS_PER_SEGMENT, locate, number
from fieldstats.operators.ranks import rank_table

# Steps of a column's ranks that are sent to every task, at most (24 bytes each).
CODED = 100_000
# Columns of more steps that meet their ranks one join after the other, with whole rows.
JOINED_ONE_BY_ONE = 3


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    """Column pairs, each in alphabetical order."""
    return list(combinations(sorted(cols), 2))


def _numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[number(c).alias(c) for c in cols])


def _times(weight: str | None) -> Column:
    """How many rows a row stands for."""
    return F.col(weight) if weight else F.lit(1)


def _weigh(v: Column, weight: str | None) -> Column:
    """The number of rows in which ``v`` is present."""
    return F.sum(F.when(v.isNotNull(), F.col(weight))) if weight else F.count(v)


def _profile(data: DataFrame, cols: Sequence[str], weight: str | None = None) -> tuple[set[str], dict[str, float]]:
    """The columns with gaps, and the column means: one small aggregate."""
    w = _times(weight)
    present = [_weigh(F.col(f"`{c}`"), weight) for c in cols]
    totals = [F.sum(w * F.col(f"`{c}`") if weight else F.col(f"`{c}`")) for c in cols]
    row = data.agg(F.sum(w), *present, *totals).first()
    counts, sums = row[1 : 1 + len(cols)], row[1 + len(cols) :]
    gappy = {c for c, n in zip(cols, counts) if (n or 0) < (row[0] or 0)}
    return gappy, {c: total / n if n else 0.0 for c, n, total in zip(cols, counts, sums)}


def _pair_sums(data: DataFrame, cols: Sequence[str], gappy: set[str], weight: str | None = None) -> DataFrame:
    """Sums behind correlation and regression for all pairs of columns.

    Each row becomes one row per column, next to all columns, and is summed in place:
    the partial aggregate keeps one line per column, so nothing but those lines is
    shuffled, and the number of sums grows with the columns, not with their pairs.
    Columns should be centred; ``weight`` names the column of how many rows a row stands for.
    """
    cols = sorted(cols)
    x = F.col("_x")
    wx = F.col("_w") * x if weight else x
    keep = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)]
    lines = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"`{c}`").alias("_x")) for i, c in enumerate(cols)])
    if weight:
        keep.append(F.col(weight).cast("double").alias("_w"))
    long = data.select(*keep, F.inline(lines)).filter(x.isNotNull())
    names = ("n", "sx", "sxx", "lo", "hi")

    def own(v: Column, wv: Column) -> list[Column]:
        n = F.coalesce(_weigh(v, "_w" if weight else None).cast("double"), F.lit(0.0))
        return [n, F.sum(wv), F.sum(wv * v), F.min(v), F.max(v)]

    aggs = [c.alias(f"{k}_all") for k, c in zip(names, own(x, wx))]
    for j, c in enumerate(cols):
        aggs.append(F.sum(wx * F.col(f"_c{j}")).alias(f"sxy_{j}"))
        if c in gappy:
            aggs += [v.alias(f"{k}_{j}") for k, v in zip(names, own(*[F.when(F.col(f"_c{j}").isNotNull(), z) for z in (x, wx)]))]
    partners = [
        F.struct(
            F.lit(j).alias("_j"),
            *[F.col(f"{k}_{j if c in gappy else 'all'}").alias(k) for k in names],
            F.col(f"sxy_{j}").alias("sxy"),
        )
        for j, c in enumerate(cols)
    ]
    sums = long.groupBy("_i").agg(*aggs).select("_i", F.inline(F.array(*partners)))
    # Bring (x, y) and (y, x) together; pairs without a common row stay, with n = 0.
    first, second = F.col("_i") < F.col("_j"), F.col("_i") > F.col("_j")
    low, high = F.least("_i", "_j").alias("_a"), F.greatest("_i", "_j").alias("_b")
    picked = (
        sums.filter(F.col("_i") != F.col("_j"))
        .groupBy(low, high)
        .agg(
            F.max(F.when(first, F.col("n"))).alias("n"),
            F.max(F.when(first, F.col("sxy"))).alias("sxy"),
            *[F.max(F.when(first, F.col(k))).alias(f"{k}1") for k in names[1:]],
            *[F.max(F.when(second, F.col(k))).alias(f"{k}2") for k in names[1:]],
        )
    )
    return _spreads(_all_pairs(data, len(cols)).join(picked, ["_a", "_b"], "left"), cols)


def _all_pairs(data: DataFrame, k: int) -> DataFrame:
    """The numbers (_a, _b), _a < _b, of all pairs of ``k`` columns."""
    number = data.sparkSession.range(k * k)
    a, b = F.floor(F.col("id") / k).cast("int"), (F.col("id") % k).cast("int")
    return number.select(a.alias("_a"), b.alias("_b")).filter(F.col("_a") < F.col("_b"))


def _spreads(sums: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Means, sums of squares and of products around the means, by column names."""
    n = F.nullif(F.col("n"), F.lit(0.0))

    def spread(side: int) -> Column:
        """Sum of squares around the mean; exactly 0 for a constant column."""
        flat = F.col(f"lo{side}") == F.col(f"hi{side}")
        around = F.col(f"sxx{side}") - F.col(f"sx{side}") * F.col(f"sx{side}") / n
        return F.when(flat, F.lit(0.0)).otherwise(around)

    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(
        F.get(names, F.col("_a")).alias("var_x"),
        F.get(names, F.col("_b")).alias("var_y"),
        F.coalesce("n", F.lit(0.0)).cast("long").alias("n"),
        (F.col("sx1") / n).alias("mean_x"),
        (F.col("sx2") / n).alias("mean_y"),
        spread(1).alias("ss_x"),
        spread(2).alias("ss_y"),
        (F.col("sxy") - F.col("sx1") * F.col("sx2") / n).alias("s_xy"),
    )


def _bounded_r(cov: Column, vx: Column, vy: Column) -> Column:
    """Correlation; null for a constant column, never beyond 1 by rounding."""
    r = cov / F.sqrt(vx) / F.sqrt(vy)
    return F.when((vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _column_sums(data: DataFrame, cols: Sequence[str], weight: str | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Pair sums of columns (numbers) centred on their means, and those means."""
    gappy, means = _profile(data, cols, weight)
    kept_weight = [F.col(weight).alias("_weight")] if weight else []
    centred = data.select(*kept_weight, *[(F.col(f"`{c}`") - F.lit(means[c])).alias(c) for c in cols])
    return _pair_sums(centred, cols, gappy, "_weight" if weight else None), means


def _pearson(data: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    sums, _ = _column_sums(data, cols, weight)
    r = _bounded_r(F.col("s_xy"), F.col("ss_x"), F.col("ss_y"))
    return sums.select("var_x", "var_y", "n", r.alias("r"))


def _folded(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Equal rows of numbers as one with their count ``_w``, kept: all that follows reads this."""
    return kept(_numbers(df, cols).groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_w")))


def _with_ranks(rows: DataFrame, column: str, ranks: DataFrame, own: Mapping[str | None, int], small: bool) -> DataFrame:
    """Adds ``_r<i>``, the ranks of one column: its value is looked up for all its rankings at once.

    ``own`` maps the partner that must be present (or None) to the number of the ranking. A
    ``small`` table has been counted and is sent to every task; another meets the rows by value.
    """
    table = ranks.filter(F.col("_ranking").isin(list(own.values()))).groupBy(F.col("_v").alias("_value")).agg(
        *[F.max(F.when(F.col("_ranking") == i, F.col("_rank"))).alias(f"_found{i}") for i in own.values()]
    )
    table = F.broadcast(table) if small else table
    found = rows.join(table, F.col(f"`{column}`") == F.col("_value"), "left").drop("_value")
    for partner, i in own.items():
        rank = F.col(f"_found{i}")
        found = found.withColumn(f"_r{i}", rank if partner is None else F.when(F.col(f"`{partner}`").isNotNull(), rank))
    return found.drop(*[f"_found{i}" for i in own.values()])


def _with_many_ranks(rows: DataFrame, ranks: DataFrame, rankings: Mapping[int, tuple[str, str | None]]) -> DataFrame:
    """Adds ``_r<i>`` for many columns of many values: values meet ranks apart, then rows again.

    Rows (told apart by two digests of their values and of which are missing) are repeated
    once for each of these rankings and once to carry the rest.
    """
    carried = rows.columns
    values = [F.col(f"`{c}`") for c in carried]
    mask = F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values])
    rows = rows.withColumns({"_id1": F.xxhash64(mask, *values), "_id2": F.xxhash64(F.lit("second"), *values, mask)})
    entries = []
    for i, (c, partner) in rankings.items():
        v = F.col(f"`{c}`") if partner is None else F.when(F.col(f"`{partner}`").isNotNull(), F.col(f"`{c}`"))
        entries.append(F.struct(F.lit(i).alias("_ranking"), v.alias("_v")))
    long = rows.select("_id1", "_id2", F.inline(F.array(*entries))).filter(F.col("_v").isNotNull())
    scored = join_stats(long, ranks, ["_ranking", "_v"]).select("_id1", "_id2", "_ranking", "_rank", F.lit(None).alias("_row"))
    base = rows.select("_id1", "_id2", F.lit(None).cast("int").alias("_ranking"), F.lit(None).cast("double").alias("_rank"), F.struct(*values).alias("_row"))
    together = base.unionByName(scored.withColumn("_row", F.lit(None).cast(base.schema["_row"].dataType)))
    found = together.groupBy("_id1", "_id2").agg(
        F.any_value("_row", True).alias("_row"),
        *[F.max(F.when(F.col("_ranking") == i, F.col("_rank"))).alias(f"_r{i}") for i in rankings],
    )
    return found.select(*[F.col("_row")[c].alias(c) for c in carried], *[f"_r{i}" for i in rankings])


def _spearman(rows: DataFrame, cols: Sequence[str], rows_per_segment: int) -> DataFrame:
    """Pearson correlation of average ranks, ranked within each pair's complete rows.

    ``rows`` are folded (see :func:`_folded`). A column is ranked once for all partners that
    have no missing values, and once more for each partner that has. A rank is a step
    function of the value: one small table for a column of few distinct values, which every
    task looks up as it reads the rows. Columns of many values meet their ranks by a join on
    the value, or, if there are more than ``JOINED_ONE_BY_ONE``, apart from the rows. The
    sums of the pairs are taken in the map task.
    """
    cols = sorted(cols)
    pairs = _pairs(cols)
    gappy, _ = _profile(rows, cols, "_w")
    # Rankings: (column, partner that must be present or None).
    rankings = sorted(
        {(c, d if d in gappy else None) for x, y in pairs for c, d in ((x, y), (y, x))},
        key=lambda r: (cols.index(r[0]), -1 if r[1] is None else cols.index(r[1])),
    )
    at = {r: i for i, r in enumerate(rankings)}
    entries = []
    for i, (c, partner) in enumerate(rankings):
        v = F.col(f"`{c}`")
        if partner is not None:
            v = F.when(F.col(f"`{partner}`").isNotNull(), v)
        entries.append(F.struct(F.lit(i).alias("_ranking"), v.alias("_v")))
    long = rows.select("_w", F.inline(F.array(*entries))).filter(F.col("_v").isNotNull())
    pos = locate(long, ["_ranking"], "_v", weight="_w", rows_per_segment=rows_per_segment)
    centred = F.col("mid_rank") - (F.col("total") + F.lit(1)) / F.lit(2.0)
    ranks = rank_table(pos).select("_ranking", "_v", centred.alias("_rank"))
    # One number a ranking: how many steps it has.
    steps = {r["_ranking"]: r["count"] for r in pos.cells.groupBy("_ranking").count().collect()}
    own = {c: {partner: i for (d, partner), i in at.items() if d == c} for c in cols}
    small = {c: sum(steps.get(i, 0) for i in own[c].values()) <= CODED for c in cols}
    large = [c for c in cols if not small[c]]
    scored = rows
    if len(large) > JOINED_ONE_BY_ONE:
        scored = _with_many_ranks(scored, ranks, {i: rankings[i] for c in large for i in own[c].values()})
        large = []
    for c in [*large, *[c for c in cols if small[c]]]:
        scored = _with_ranks(scored, c, ranks, own[c], small[c])
    number = {c: i for i, c in enumerate(cols)}
    rank_of = lambda c, d: F.col(f"_r{at[c, d if d in gappy else None]}")
    lines = [
        F.struct(F.lit(number[x]).alias("_a"), F.lit(number[y]).alias("_b"), rank_of(x, y).alias("_x"), rank_of(y, x).alias("_y"))
        for x, y in pairs
    ]
    w, x, y = F.col("_w").cast("double"), F.col("_x"), F.col("_y")
    # Both rankings of a pair cover the same rows.
    sums = (
        scored.select("_w", F.inline(F.array(*lines)))
        .filter(x.isNotNull() & y.isNotNull())
        .groupBy("_a", "_b")
        .agg(
            F.sum(w).alias("n"),
            F.sum(w * x * y).alias("sxy"),
            *[
                f.alias(f"{k}{side}")
                for side, v in ((1, x), (2, y))
                for k, f in (("sx", F.sum(w * v)), ("sxx", F.sum(w * v * v)), ("lo", F.min(v)), ("hi", F.max(v)))
            ],
        )
    )
    sums = _spreads(_all_pairs(rows, len(cols)).join(sums, ["_a", "_b"], "left"), cols)
    r = _bounded_r(F.col("s_xy"), F.col("ss_x"), F.col("ss_y"))
    return sums.select("var_x", "var_y", "n", r.alias("r"))


@any_names
def corr_pairs(
    df: DataFrame,
    cols: Sequence[str],
    method: str = "pearson",
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """``r`` and ``n`` of every column pair over the rows where both are present.

    One row per pair, ``var_x`` before ``var_y`` in the alphabet. A constant column
    or fewer than two rows give a null r.
    """
    if method == "pearson":
        return _pearson(_numbers(df, cols), cols)
    if method == "spearman":
        return _spearman(_folded(df, cols), cols, rows_per_segment)
    raise ValueError(f"unknown method {method!r}")


@any_names
def corr_test(pairs: DataFrame) -> DataFrame:
    """Two-sided test of each correlation: ``t`` with ``n - 2`` degrees of freedom."""
    r, n = F.col("r"), F.col("n").cast("double")
    left = F.lit(1.0) - r * r
    usable = (n > 2) & r.isNotNull()
    t = F.when(usable & (left > 0), r * F.sqrt((n - 2) / left))
    p = F.when(usable & (left <= 0), F.lit(0.0)).otherwise(
        F.when(F.col("t").isNotNull(), student_two_sided(F.col("t"), n - 2))
    )
    return pairs.withColumn("t", t).withColumn("p", p)


@any_names
def corr_significant(
    df: DataFrame,
    cols: Sequence[str],
    method: str = "pearson",
    p_method: str | None = None,
    alpha: float = 0.05,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Pairs whose correlation is significant at ``alpha``.

    ``p_method`` tests another coefficient than the one shown (Spearman r masked by
    Pearson p, for instance).
    """
    if p_method in (None, method):
        tested = corr_test(corr_pairs(df, cols, method, rows_per_segment))
    elif {method, p_method} == {"pearson", "spearman"}:
        # The source is read once; both coefficients are taken from its folded rows.
        rows = _folded(df, cols)
        both = {"pearson": _pearson(rows, cols, "_w"), "spearman": _spearman(rows, cols, rows_per_segment)}
        r, p = both[method], corr_test(both[p_method])
        tested = r.join(p.select("var_x", "var_y", "p"), ["var_x", "var_y"], "inner")
    else:
        raise ValueError(f"unknown methods {method!r}, {p_method!r}")
    return tested.filter(F.col("p") <= F.lit(alpha)).select("var_x", "var_y", "n", "r", "p")


@any_names
def pair_regression(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Straight line of ``var_y`` on ``var_x`` for every pair; none for a constant ``var_x``.

    ``residual_sd`` and ``slope_se`` are what a confidence band is drawn from: at x its
    half width is t * residual_sd * sqrt(1 / n + (x - mean)^2 / ss_x). They need three rows.
    """
    sums, means = _column_sums(_numbers(df, cols), cols)
    slope = F.when(F.col("ss_x") > 0, F.col("s_xy") / F.col("ss_x"))
    left = F.greatest(F.lit(0.0), F.col("ss_y") - slope * F.col("s_xy"))
    residual = F.when(F.col("n") > 2, F.sqrt(left / F.nullif(F.col("n") - 2, F.lit(0))))
    mean_x = F.col("mean_x") + by_key("var_x", means)
    mean_y = F.col("mean_y") + by_key("var_y", means)
    return sums.select(
        "var_x",
        "var_y",
        "n",
        slope.alias("slope"),
        (mean_y - slope * mean_x).alias("intercept"),
        residual.alias("residual_sd"),
        F.when(F.col("ss_x") > 0, residual / F.sqrt("ss_x")).alias("slope_se"),
        (_bounded_r(F.col("s_xy"), F.col("ss_x"), F.col("ss_y")) ** 2).alias("r2"),
    )
