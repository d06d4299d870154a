"""Correlation and rank tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import GAPPY, VARIABLES, gappy_lineitem, rounded, table
from fieldstats.operators import correlation as C
from fieldstats.operators import ranks as R
from fieldstats.operators.columns import significant_only

# Small enough for dozens of segments on the test tables.
SEGMENT_ROWS = 100
CODES = {"l_quantity": 1, "l_extendedprice": 1, "l_discount": 100, "l_tax": 100}


def corr_pairs(spark, sf_dir) -> DataFrame:
    return rounded(C.corr_pairs(gappy_lineitem(spark, sf_dir), VARIABLES))


def corr_pairs_spearman(spark, sf_dir) -> DataFrame:
    return rounded(C.corr_pairs(table(spark, sf_dir, "lineitem"), VARIABLES, "spearman"))


def corr_pairs_spearman_gaps(spark, sf_dir) -> DataFrame:
    return rounded(C.corr_pairs(gappy_lineitem(spark, sf_dir), VARIABLES, "spearman"))


def corr_test(spark, sf_dir) -> DataFrame:
    return rounded(C.corr_test(C.corr_pairs(gappy_lineitem(spark, sf_dir), VARIABLES)), t=4)


def corr_pairs_spearman_coded(spark, sf_dir) -> DataFrame:
    """Coded measures with gaps: many rows are equal but for what is missing."""
    coded = {c: F.floor(F.col(c) * k) % 3 for c, k in CODES.items()}
    rows = gappy_lineitem(spark, sf_dir).withColumns(coded)
    rows = rows.withColumn("l_quantity", F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")))
    return rounded(C.corr_pairs(rows, VARIABLES, "spearman"))


def corr_pairs_spearman_segmented(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return rounded(C.corr_pairs(lines, VARIABLES, "spearman", rows_per_segment=SEGMENT_ROWS))


def corr_significant(spark, sf_dir) -> DataFrame:
    # At the tests' scale some of these pairs pass and some do not.
    return rounded(C.corr_significant(gappy_lineitem(spark, sf_dir), VARIABLES, alpha=0.5))


def corr_significant_mixed(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return rounded(C.corr_significant(lines, VARIABLES, "spearman", "pearson", alpha=0.5))


def pair_regression(spark, sf_dir) -> DataFrame:
    return rounded(C.pair_regression(gappy_lineitem(spark, sf_dir), VARIABLES), 5)


def _strata(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select((F.col("user_id") % 3).alias("stratum"), "event_type", "value")


def kruskal_wallis(spark, sf_dir) -> DataFrame:
    return rounded(R.kruskal_wallis(_strata(spark, sf_dir), ["stratum"], "event_type", "value"))


def dunn_test(spark, sf_dir) -> DataFrame:
    return rounded(R.dunn_test(_strata(spark, sf_dir), ["stratum"], "event_type", "value"))


def kruskal_wallis_segmented(spark, sf_dir) -> DataFrame:
    rows = _strata(spark, sf_dir)
    return rounded(R.kruskal_wallis(rows, ["stratum"], "event_type", "value", rows_per_segment=SEGMENT_ROWS))


def dunn_test_segmented(spark, sf_dir) -> DataFrame:
    rows = _strata(spark, sf_dir)
    return rounded(R.dunn_test(rows, ["stratum"], "event_type", "value", rows_per_segment=SEGMENT_ROWS))


def significant(spark, sf_dir) -> DataFrame:
    tests = R.dunn_test(_strata(spark, sf_dir), ["stratum"], "event_type", "value")
    return rounded(significant_only(tests, "p", 0.3))


QUERIES = {
    "corr_pairs": corr_pairs,
    "corr_pairs_spearman": corr_pairs_spearman,
    "corr_pairs_spearman_gaps": corr_pairs_spearman_gaps,
    "corr_pairs_spearman_coded": corr_pairs_spearman_coded,
    "corr_pairs_spearman_segmented": corr_pairs_spearman_segmented,
    "kruskal_wallis_segmented": kruskal_wallis_segmented,
    "dunn_test_segmented": dunn_test_segmented,
    "corr_test": corr_test,
    "corr_significant": corr_significant,
    "corr_significant_mixed": corr_significant_mixed,
    "pair_regression": pair_regression,
    "kruskal_wallis": kruskal_wallis,
    "dunn_test": dunn_test,
    "significant_only": significant,
}


def simpson(f: str, upper: str, steps: int = 2000) -> str:
    """Integral of ``f`` (in terms of ``u``) from 0 to ``upper`` by Simpson's rule."""
    u = f"({upper}) * i / {steps}::DOUBLE"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"(({upper}) / {3 * steps}::DOUBLE * list_sum(list_transform(range(0, {steps + 1}), "
        f"lambda i: {weight} * {f.replace('{u}', u)})))"
    )


def normal_upper_sql(z: str) -> str:
    area = simpson("exp(-({u}) * ({u}) / 2)", f"least(abs({z}), 40)")
    return f"greatest(0, 0.5::DOUBLE - {area} / sqrt(2 * pi()))"


def student_sql(t: str, df: str) -> str:
    """Two-sided tail by integrating the density."""
    body = f"exp(-(({df}) + 1) / 2 * ln(1 + ({{u}}) * ({{u}}) / ({df})))"
    norm = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi())"
    return f"greatest(0, 1 - 2 * {norm} * {simpson(body, f'least(abs({t}), 40)')})"


def _pairs(cols) -> list[tuple[str, str]]:
    return list(combinations(sorted(cols), 2))


def pairs_sql(source: str, body: str, cols=tuple(VARIABLES)) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS var_x, '{y}' AS var_y, {body.format(x=x, y=y)} FROM {source}"
        for x, y in _pairs(cols)
    )


_R = "regr_count({y}, {x}) AS n, corr({x}, {y}) AS r"
_TESTED = f"""tested AS (
    SELECT var_x, var_y, CAST(n AS BIGINT) AS n, r, t, {student_sql("t", "(n::DOUBLE - 2)")} AS p
    FROM (SELECT *, r * sqrt((n::DOUBLE - 2) / (1 - r * r)) AS t FROM pearson))"""


def spearman_sql(source: str, cols=tuple(VARIABLES)) -> str:
    """Correlation of average ranks within the complete rows of each pair."""

    def mid(c: str) -> str:
        return (
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
        )

    return " UNION ALL ".join(
        f"""SELECT '{x}' AS var_x, '{y}' AS var_y, count(*) AS n, corr(a, b) AS r
            FROM (SELECT {mid(x)} AS a, {mid(y)} AS b FROM {source}
                  WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""
        for x, y in _pairs(cols)
    )


STRATA = """s AS (SELECT user_id % 3 AS stratum, event_type, value FROM events)"""


def rank_groups_sql(source: str, strata: str, group: str, value: str) -> str:
    """CTEs ``g`` (rank sums per group) and ``m`` (totals per stratum)."""
    by = f"PARTITION BY {strata}" if strata else ""
    with_value = f"PARTITION BY {strata}, {value}" if strata else f"PARTITION BY {value}"
    head = f"{strata}, " if strata else ""
    return f"""k AS (SELECT {head}{group} AS grp, {value},
        rank() OVER ({by} ORDER BY {value})
          + (count(*) OVER ({with_value}) - 1) / 2.0::DOUBLE AS rk,
        count(*) OVER ({with_value}) AS ties
      FROM {source} WHERE {value} IS NOT NULL AND {group} IS NOT NULL),
    g AS (SELECT {head}grp, count(*) AS n, sum(rk) AS rs FROM k GROUP BY {head}grp),
    m AS (SELECT {head}count(*)::DOUBLE AS nn, sum(ties * ties - 1)::DOUBLE AS tie
          FROM k {"GROUP BY " + strata if strata else ""})"""


def dunn_sql(strata: str) -> str:
    cols = [c.strip() for c in strata.split(",")]
    on_b = " AND ".join(f"a.{c} = b.{c}" for c in cols)
    on_m = " AND ".join(f"a.{c} = m.{c}" for c in cols)
    head = ", ".join(f"a.{c}" for c in cols)
    count_on = " AND ".join(f"a.{c} = c.{c}" for c in cols)
    return f"""zs AS (SELECT {head}, a.grp AS group_a, b.grp AS group_b,
        (a.rs / a.n - b.rs / b.n)
          / sqrt((nn * (nn + 1) / 12 - tie / (12 * (nn - 1))) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS z,
        kk * (kk - 1) / 2 AS tests
      FROM g a JOIN g b ON {on_b} AND a.grp < b.grp JOIN m ON {on_m}
        JOIN (SELECT {strata}, count(*)::DOUBLE AS kk FROM g GROUP BY {strata}) c ON {count_on}),
    dunn AS (SELECT *, {normal_upper_sql("z")} AS p FROM zs)"""


DUNN_COLUMNS = """group_a, group_b, round(z, 6) AS z, round(p, 6) AS p,
    round(least(1.0::DOUBLE, p * tests), 6) AS p_adjusted"""

ORACLES = {
    "corr_pairs": f"""WITH {GAPPY}, pearson AS ({pairs_sql("gappy", _R)})
      SELECT var_x, var_y, CAST(n AS BIGINT) AS n, round(r, 6) AS r FROM pearson""",
    "corr_pairs_spearman": f"""WITH sp AS ({spearman_sql("lineitem")})
      SELECT var_x, var_y, n, round(r, 6) AS r FROM sp""",
    "corr_pairs_spearman_gaps": f"""WITH {GAPPY}, sp AS ({spearman_sql("gappy")})
      SELECT var_x, var_y, n, round(r, 6) AS r FROM sp""",
    "corr_test": f"""WITH {GAPPY}, pearson AS ({pairs_sql("gappy", _R)}), {_TESTED}
      SELECT var_x, var_y, n, round(r, 6) AS r, round(t, 4) AS t, round(p, 6) AS p FROM tested""",
    "corr_significant": f"""WITH {GAPPY}, pearson AS ({pairs_sql("gappy", _R)}), {_TESTED}
      SELECT var_x, var_y, n, round(r, 6) AS r, round(p, 6) AS p FROM tested WHERE p <= 0.5""",
    "corr_significant_mixed": f"""WITH pearson AS ({pairs_sql("lineitem", _R)}), {_TESTED},
      sp AS ({spearman_sql("lineitem")})
      SELECT var_x, var_y, sp.n, round(sp.r, 6) AS r, round(p, 6) AS p
      FROM sp JOIN tested USING (var_x, var_y) WHERE p <= 0.5""",
    "pair_regression": f"""WITH {GAPPY}, fit AS ({pairs_sql("gappy",
        "CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_slope({y}, {x}) AS slope, "
        "regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2, "
        "regr_sxx({y}, {x}) AS sxx, "
        "sqrt(greatest(0, regr_syy({y}, {x}) - regr_sxy({y}, {x}) ** 2 / regr_sxx({y}, {x})) "
        "/ (regr_count({y}, {x}) - 2)) AS res")})
      SELECT var_x, var_y, n, round(slope, 5) AS slope, round(intercept, 5) AS intercept,
        round(r2, 5) AS r2, round(res, 5) AS residual_sd, round(res / sqrt(sxx), 5) AS slope_se FROM fit""",
    "kruskal_wallis": f"""WITH {STRATA}, {rank_groups_sql("s", "stratum", "event_type", "value")},
      h AS (SELECT g.stratum, any_value(nn) AS nn, count(*) AS k,
              (12 / (any_value(nn) * (any_value(nn) + 1)) * sum(rs * rs / n) - 3 * (any_value(nn) + 1))
              / (1 - any_value(tie) / (any_value(nn)**3 - any_value(nn))) AS h
            FROM g JOIN m ON g.stratum = m.stratum GROUP BY g.stratum)
      SELECT stratum, CAST(nn AS BIGINT) AS n, k, round(h, 6) AS h, k - 1 AS df,
        round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM h""",
    "dunn_test": f"""WITH {STRATA}, {rank_groups_sql("s", "stratum", "event_type", "value")},
      {dunn_sql("stratum")} SELECT stratum, {DUNN_COLUMNS} FROM dunn""",
    "significant_only": f"""WITH {STRATA}, {rank_groups_sql("s", "stratum", "event_type", "value")},
      {dunn_sql("stratum")} SELECT stratum, {DUNN_COLUMNS} FROM dunn WHERE p <= 0.3""",
}
ORACLES["corr_pairs_spearman_segmented"] = ORACLES["corr_pairs_spearman"]
ORACLES["kruskal_wallis_segmented"] = ORACLES["kruskal_wallis"]
ORACLES["dunn_test_segmented"] = ORACLES["dunn_test"]
ORACLES["corr_pairs_spearman_coded"] = f"""WITH {GAPPY}, coded AS (SELECT
      {", ".join(f"CAST(floor({c} * {k}) AS BIGINT) % 3 AS {c}" for c, k in CODES.items() if c != "l_quantity")},
      CASE WHEN l_partkey % 5 <> 0 THEN CAST(floor(l_quantity * {CODES["l_quantity"]}) AS BIGINT) % 3 END AS l_quantity
      FROM gappy), sp AS ({spearman_sql("coded")})
    SELECT var_x, var_y, n, round(r, 6) AS r FROM sp"""
