"""Cut points by a tree of sketches, mergeable sketches, and column names of any kind."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fieldstats.kept import kept
from fieldstats.names import make_names
from fieldstats.operators import columns, correlation, distribution, joins, missing, ranks, recoding, reshape, summary
from fieldstats.operators.positions import SEGMENT, counted, segmented, sketch_quantiles, sketch_tree
from fieldstats.sources.io import preview, read_survey, table_schema


def test_ten_thousand_segments(spark):
    n = 40_000
    values = spark.range(n).select(F.pow(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 30), F.lit(3)).alias("v"))
    cells = segmented(kept(counted(values, [], "v")), "v", 4)
    plan = len(cells._jdf.queryExecution().logical().toString())
    rows = cells.groupBy(SEGMENT).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy(SEGMENT).collect()
    assert len(rows) > 9_000 and sum(r.n for r in rows) == n and max(r.n for r in rows) < 16
    assert all(a.high < b.low for a, b in zip(rows, rows[1:]))
    # Ten times the segments add nothing to the plan.
    fewer = segmented(kept(counted(values, [], "v")), "v", 40)
    assert plan < 1.05 * len(fewer._jdf.queryExecution().logical().toString())
    ranked = ranks.mid_rank(values, [], "v", rows_per_segment=4).orderBy("v").collect()
    assert [r.mid_rank for r in ranked] == list(range(1, n + 1))


def test_segments_of_odd_values(spark):
    odd = [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, 1.0] * 3 + [float(i) for i in range(600)]
    frame = spark.createDataFrame([(v,) for v in odd], "v double")
    got = ranks.mid_rank(frame, [], "v", rows_per_segment=1).collect()
    order = sorted(odd)
    for r in got:
        assert r.mid_rank == order.index(r.v) + (order.count(r.v) + 1) / 2
    same = spark.createDataFrame([(float("inf"),)] * 50, "v double")
    assert {r.mid_rank for r in ranks.mid_rank(same, [], "v", rows_per_segment=1).collect()} == {25.5}


def test_sketch_tree_per_key(spark):
    frame = spark.range(40_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")).repartition(7)
    for r in sketch_tree(frame, "v", ["g"]).select("g", sketch_quantiles(F.col("sketch"), 4).alias("q")).collect():
        assert r.q == pytest.approx([10_000, 20_000, 30_000], abs=400)


def test_merged_quantile_sketches(spark):
    """Halves merged keep the bound of the whole; small ones are exact."""
    n, k = 60_000, 512
    frame = spark.range(n).select((F.col("id") % 2).alias("half"), F.pmod(F.col("id") * 7_919, F.lit(n)).cast("double").alias("v"))
    frame = frame.union(spark.createDataFrame([(0, None), (None, 1.0), (1, float("nan"))], "half long, v double"))
    parts = distribution.quantile_sketches(frame, ["half"], "v", k)
    assert {r.half: r.n for r in parts.collect()} == {0: n // 2, 1: n // 2}
    [r] = distribution.sketched_quartiles(distribution.merge_quantile_sketches(parts, [])).collect()
    bound = 4 * 2.3 / k**0.9 * n
    assert r.n == n and (r.q1, r.median, r.q3) == pytest.approx((n / 4, n / 2, 3 * n / 4), abs=bound)
    few = distribution.quantile_sketches(frame.filter("v < 100"), [], "v")
    assert [tuple(r) for r in distribution.sketched_quartiles(few).collect()] == [(101, 24.0, 49.0, 74.0)]


def test_merged_distinct_sketches(spark):
    frame = spark.range(90_000).select((F.col("id") % 3).alias("part"), (F.col("id") % 20_000).alias("k"), (F.col("id") % 7 / 7).alias("x"))
    frame = frame.union(spark.createDataFrame([(0, None, float("nan")), (1, None, -0.0)], "part long, k long, x double"))
    parts = summary.distinct_sketches(frame, ["part"], "k")
    [whole] = summary.sketched_distinct(summary.merge_distinct_sketches(parts, [])).collect()
    [direct] = summary.sketched_distinct(summary.distinct_sketches(frame, [], "k")).collect()
    assert whole.n_distinct == direct.n_distinct == pytest.approx(20_000, rel=0.06)
    assert {r.n_distinct for r in summary.sketched_distinct(summary.distinct_sketches(frame, ["part"], "x")).collect()} == {7}


def test_make_names():
    raw = ["Water temp (C)", "a", "a", "a.1", "a", "1st", ".2x", ".x", "_y", "", None, "if", "größe", "x-y", "x.y"]
    assert make_names(raw) == [
        "Water.temp..C.", "a", "a.2", "a.1", "a.3", "X1st", "X.2x", ".x", "X_y", "X", "NA.", "if.", "größe", "x.y", "x.y.1",
    ]


def test_read_survey_checks_names(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    with open(path, "w") as f:
        f.write('Site no,"DO (mg/L)",Date,DO (mg/L),2nd\n1,3.5,02/01/2020,x,NA\n2,NA,31/12/2019,y,7\n')
    schema = "`X2nd` int, `DO..mg.L.` double, `Date` date, `DO..mg.L..1` string"
    got = read_survey(spark, path, schema, check_names=True)
    assert got.columns == ["X2nd", "DO..mg.L.", "Date", "DO..mg.L..1"]
    assert [(r[0], r[1], str(r[2]), r[3]) for r in got.collect()] == [(None, 3.5, "2020-01-02", "x"), (7, None, "2019-12-31", "y")]
    with pytest.raises(ValueError, match="no such columns"):
        read_survey(spark, path, "Other int", check_names=True)
    with open(path, "a") as f:
        f.write("3,bad,01/01/2020,z,1\n")
    kept_rows = read_survey(spark, path, schema, bad_cells="keep", check_names=True).collect()
    assert len(kept_rows) == 3 and kept_rows[2]["_bad_line"].startswith("3,bad")


CALLS = [
    (summary.mean_sem, ["a.g"], "a.v"),
    (summary.mean_sem_wide, ["a.g"], {"x": "a.v", "y": "b.w"}),
    (summary.group_sum, ["a.g"], ["a.v", "b.w"]),
    (summary.contingency_share, "a.g", "h`k"),
    (summary.category_count, "a.g", "h`k"),
    (summary.distinct_count, "a.g"),
    (summary.distinct_values, "a.g"),
    (summary.rescale, ["a.v"], 2.0),
    (summary.symbol_size, ["a.v"]),
    (distribution.box_stats, ["a.g"], "a.v"),
    (distribution.box_outliers, ["a.g"], "a.v"),
    (distribution.box_stats_many, ["a.g"], ["a.v", "b.w"]),
    (distribution.group_histogram, "a.g", "a.v", 5),
    (distribution.describe_numeric, ["a.v", "b.w"]),
    (distribution.quantile_sketches, ["a.g"], "a.v"),
    (ranks.mid_rank, ["a.g"], "a.v"),
    (ranks.kruskal_wallis, ["h`k"], "a.g", "a.v"),
    (ranks.dunn_test, ["h`k"], "a.g", "a.v"),
    (correlation.corr_pairs, ["a.v", "b.w"]),
    (correlation.corr_pairs, ["a.v", "b.w"], "spearman"),
    (correlation.pair_regression, ["a.v", "b.w"]),
    (missing.missing_share, ["a.v", "b.w"]),
    (missing.missing_pattern, ["a.v", "b.w"]),
    (missing.impute_mean, ["a.v"]),
    (missing.margin_summary, "a.v", "b.w"),
    (reshape.to_long, ["a.g"], ["a.v", "b.w"]),
    (columns.select_cols, ["a.v"]),
    (columns.drop_cols, ["a.v"]),
    (columns.select_range, "a.g", "a.v"),
    (columns.reorder_cols, ["b.w", "a.v", "h`k", "a.g"]),
    (columns.cast_category, ["a.g"]),
    (columns.complete_cases, ["a.v"]),
    (columns.sort_rows, ["a.v"]),
    (recoding.recode_exact, "a.g", {"p": "P"}),
    (recoding.order_levels, "a.g", ["q", "p"]),
    (preview, "a.v"),
    (table_schema,),
]


@pytest.fixture(scope="module")
def plain(spark):
    draw = random.Random(4)
    rows = [(draw.choice("pqr"), draw.choice("mn"), draw.choice([None, round(draw.gauss(5, 2), 2)]), draw.gauss(0, 1)) for _ in range(120)]
    return spark.createDataFrame(rows, "g string, u string, v double, w double").coalesce(1).cache()


@pytest.mark.parametrize("call", CALLS, ids=lambda c: c[0].__name__)
def test_dotted_names(plain, call):
    """The same result as with plain names, under the real names."""
    real = {"g": "a.g", "u": "h`k", "v": "a.v", "w": "b.w"}
    short = {v: k for k, v in real.items()}

    def shorten(x):
        if isinstance(x, str):
            return short.get(x, x)
        if isinstance(x, dict):
            return {shorten(k): shorten(v) for k, v in x.items()}
        return [shorten(v) for v in x] if isinstance(x, list) else x

    operator, *args = call
    dotted = operator(plain.toDF(*[real[c] for c in plain.columns]), *args)
    want = operator(plain, *map(shorten, args))

    def long(name):
        for k, v in real.items():
            if name == k or name.startswith(k + "_") or name == f"has_{k}":
                return name.replace(k, v, 1) if name != f"has_{k}" else f"has_{v}"
        return name

    as_rows = lambda df: sorted(repr(["" if isinstance(x, bytearray) else short.get(x, x) if isinstance(x, str) else x for x in r]) for r in df.collect())
    assert dotted.columns == [long(c) for c in want.columns]
    assert as_rows(dotted) == as_rows(want)


def test_dotted_keys_join(plain):
    table = plain.sparkSession.createDataFrame([("p", 1), ("q", 2), (None, 3)], "g string, n int").withColumnRenamed("g", "a.g")
    dotted = plain.withColumnRenamed("g", "a.g")
    for join in (joins.left_lookup, joins.right_lookup):
        got = join(dotted, table, "a.g")
        want = join(plain, table.withColumnRenamed("a.g", "g"), "g")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
        assert "a.g" in got.columns
