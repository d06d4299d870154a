"""Null rules, degenerate groups and other edges; segments against a plain sort."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats.functions.tails import student_two_sided
from fieldstats.kept import kept
from fieldstats.operators import columns as C
from fieldstats.operators import joins as J
from fieldstats.operators import positions, ranks
from fieldstats.operators.correlation import corr_pairs, corr_significant, corr_test, pair_regression
from fieldstats.operators.distribution import (
    box_outliers,
    box_stats,
    describe_numeric,
    group_histogram,
    variable_summary,
)
from fieldstats.operators.missing import impute_mean, margin_summary, missing_pattern, missing_share
from fieldstats.operators.positions import SEGMENT
from fieldstats.operators.ranks import dunn_test, kruskal_wallis, mid_rank
from fieldstats.operators.reshape import to_long
from fieldstats.operators.summary import (
    emission_share,
    group_sum,
    mean_sem,
    mean_sem_wide,
    share_of_total,
    sum_of_means,
    symbol_size,
)
from fieldstats.plans.flows import index_totals
from fieldstats.sources.io import lookup_table, preview, read_survey, write_table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), ("c", None), (None, 7.0)],
        "g string, v double",
    )


def test_mean_sem_null_rules(gaps):
    got = {r["g"]: (r["n"], r["mean"], r["sem"]) for r in mean_sem(gaps, ["g"], "v").collect()}
    assert got == {"a": (2, 2.0, pytest.approx(1.0)), "b": (1, 5.0, None)}
    wide = {r["g"]: (r["n"], r["mean"], r["sem"]) for r in mean_sem_wide(gaps, ["g"], {"v": "v"}).collect()}
    assert wide == got


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("a", 4.0)], "g string, v double")
    [r] = mean_sem(df, ["g"], "v").collect()
    assert (r["n"], r["mean"]) == (2, 3.0)
    [b] = box_stats(df, ["g"], "v").collect()
    assert (b["n"], b["median"]) == (2, 3.0)


def test_sum_of_means_policies(spark):
    summary = spark.createDataFrame(
        [("a", 1.0, 0.5), ("a", 2.0, None), ("b", 4.0, None)], "g string, mean double, sem double"
    )
    assert rows_of(sum_of_means(summary, ["g"])) == [("a", 3.0, 0.5)]
    assert rows_of(sum_of_means(summary, ["g"], sem_policy="zero")) == [("a", 3.0, 0.5), ("b", 4.0, 0.0)]
    with pytest.raises(ValueError):
        sum_of_means(summary, ["g"], sem_policy="other")


def test_index_totals_keep_only_the_zero_index(spark):
    summary = spark.createDataFrame(
        [("Prati Index", "x", 1.0, None), ("Oregon Index", "y", 2.0, None)],
        "wqi string, label string, mean_co2eq double, sem_co2eq double",
    )
    assert rows_of(index_totals(summary)) == [("Oregon Index", "y", 2.0, 0.0)]


def test_group_sum_policies(gaps):
    strict = {r["g"]: r["v"] for r in group_sum(gaps, ["g"], ["v"]).collect()}
    assert strict == {"a": None, "b": 5.0, "c": None, None: 7.0}
    zero = {r["g"]: r["v"] for r in group_sum(gaps, ["g"], ["v"], "zero").collect()}
    assert zero == {"a": 4.0, "b": 5.0, "c": 0.0, None: 7.0}
    omit = {r["g"]: r["v"] for r in group_sum(gaps, ["g"], ["v"], "omit").collect()}
    assert omit == {"a": 4.0, "b": 5.0, "c": None, None: 7.0}


def test_emission_share_is_strict(spark):
    df = spark.createDataFrame(
        [("Cuenca", 1.0, 1.0), ("Tarqui", 3.0, None)], "river string, x double, y double"
    )
    got = {(r["river"], r["variable"]): r for r in emission_share(df, "river", ["x", "y"]).collect()}
    assert got["Tarqui", "x"]["fraction"] == 0.75
    assert got["Cuenca", "y"]["flux_sum"] == 1.0 and got["Cuenca", "y"]["fraction"] is None


def test_shares_add_to_100(sites):
    shares = share_of_total(mean_sem(sites, ["river"], "flux").withColumn("gas", F.lit("CO2")), ["gas"], "mean")
    assert shares.agg(F.sum("mean_pct")).first()[0] == pytest.approx(100)


def test_empty_and_single_group_boxes(spark, gaps):
    got = {r["g"]: r for r in box_stats(gaps, ["g"], "v").collect()}
    assert set(got) == {"a", "b"}
    assert (got["b"]["q1"], got["b"]["whisker_high"], got["b"]["n_outliers"]) == (5.0, 5.0, 0)
    empty = spark.createDataFrame([], "g string, v double")
    assert box_stats(empty, ["g"], "v").count() == 0
    assert box_stats(empty, [], "v").count() == 0
    assert kruskal_wallis(empty, [], "g", "v").first()["h"] is None


def _messy(spark, n=3000, seed=11):
    """Ties, a heavy value, outliers, nulls and groups of very different size."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "big" if i % 3 else rnd.choice(["s1", "s2", "tiny"] if i % 90 == 0 else ["s1", "s2"])
        v = 0.0 if i % 3 == 0 else round(rnd.gauss(5, 3), rnd.choice([0, 1, 4]))
        if rnd.random() < 0.01:
            v = v * 50 - 7
        rows.append((i, g, rnd.choice("xyz"), None if i % 97 == 0 else v, rnd.random() if i % 5 else None))
    return spark.createDataFrame(rows, "id long, g string, h string, v double, w double").cache()


@pytest.fixture(scope="module")
def messy(spark):
    return _messy(spark)


def test_segments_do_not_change_boxes(messy):
    one = rows_of(box_stats(messy, ["g"], "v").drop("mean"))
    assert rows_of(box_stats(messy, ["g"], "v", rows_per_segment=100).drop("mean")) == one
    assert rows_of(box_stats(messy, [], "v", rows_per_segment=77).drop("mean")) == rows_of(
        box_stats(messy, [], "v").drop("mean")
    )


def test_boxes_match_builtin_percentiles(messy):
    exact = messy.filter("v is not null").groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("q"))
    want = {r["g"]: r["q"] for r in exact.collect()}
    for r in box_stats(messy, ["g"], "v", rows_per_segment=50).collect():
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(want[r["g"]])


def test_approximate_boxes_count_everything(messy):
    want = {r["g"]: r["n"] for r in box_stats(messy, ["g"], "v").collect()}
    got = {r["g"]: r for r in box_stats(messy, ["g"], "v", approx=True).collect()}
    assert {g: r["n"] for g, r in got.items()} == want
    assert box_stats(messy, [], "v", approx=True).first()["n"] == sum(want.values())


def test_outlier_rows_agree_with_their_count(messy):
    counts = {r["g"]: r["n_outliers"] for r in box_stats(messy, ["g"], "v").collect()}
    rows = box_outliers(messy, ["g"], "v", rows_per_segment=100)
    assert rows.columns == messy.columns
    got = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    assert got == {g: n for g, n in counts.items() if n}


def _brute_ranks(rows):
    out = {}
    by = {}
    for r in rows:
        if r["v"] is not None:
            by.setdefault(r["g"], []).append(r)
    for members in by.values():
        values = sorted(r["v"] for r in members)
        first, last = {}, {}
        for i, v in enumerate(values, start=1):
            first.setdefault(v, i)
            last[v] = i
        for r in members:
            out[r["id"]] = (first[r["v"]] + last[r["v"]]) / 2
    return out


@pytest.mark.parametrize("rows_per_segment", [10_000, 40])
def test_mid_rank_against_a_sort(messy, rows_per_segment):
    ranked = mid_rank(messy, ["g"], "v", rows_per_segment=rows_per_segment)
    assert {r["id"]: r["mid_rank"] for r in ranked.collect()} == _brute_ranks(messy.collect())


def test_ranks_add_up(messy):
    per = mid_rank(messy, ["g"], "v").groupBy("g").agg(F.sum("mid_rank").alias("s"), F.count("v").alias("n"))
    for r in per.collect():
        assert r["s"] == r["n"] * (r["n"] + 1) / 2


@pytest.mark.parametrize("strata", [["h"], []])
def test_segments_do_not_change_rank_tests(messy, strata):
    def close(a, b):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-9)

    def kw(size):
        return sorted(tuple(r)[-5:] for r in kruskal_wallis(messy, strata, "g", "v", rows_per_segment=size).collect())

    def dunn(size):
        tests = dunn_test(messy, strata, "g", "v", rows_per_segment=size)
        return [tuple(r)[-3:] for r in tests.orderBy(*strata, "group_a", "group_b").collect()]

    close(kw(10_000), kw(60))
    close(dunn(10_000), dunn(60))


def test_degenerate_rank_tests(spark):
    tied = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert kruskal_wallis(tied, [], "g", "v").first()["h"] is None
    assert dunn_test(tied, [], "g", "v").count() == 0
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    row = kruskal_wallis(one, [], "g", "v").first()
    assert (row["k"], row["h"], row["p"]) == (1, None, None)
    assert dunn_test(one, [], "g", "v").count() == 0


def test_bonferroni_never_lowers_p(messy):
    for r in dunn_test(messy, ["h"], "g", "v").collect():
        assert r["p"] <= r["p_adjusted"] <= 1
    raw = dunn_test(messy, ["h"], "g", "v", adjust="none")
    assert raw.filter("p <> p_adjusted").count() == 0
    with pytest.raises(ValueError):
        dunn_test(messy, ["h"], "g", "v", adjust="holm")


def _brute_spearman(pairs):
    def ranks(values):
        order = sorted(values)
        return [order.index(v) + (order.count(v) + 1) / 2 for v in values]

    a, b = ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    return cov / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5


@pytest.mark.parametrize("size", [10_000, 60])
def test_spearman_with_gaps_against_brute_force(messy, size):
    data = messy.filter("id < 600").withColumn("u", F.col("id") % 7)
    got = {(r["var_x"], r["var_y"]): r for r in corr_pairs(data, ["u", "v", "w"], "spearman", size).collect()}
    rows = data.collect()
    for x, y in (("u", "v"), ("u", "w"), ("v", "w")):
        both = [(r[x], r[y]) for r in rows if r[x] is not None and r[y] is not None]
        assert got[x, y]["n"] == len(both)
        assert got[x, y]["r"] == pytest.approx(_brute_spearman(both), abs=1e-12)


def test_pearson_with_gaps_against_pandas(messy):
    data = messy.select(
        "v",
        "w",
        (F.col("id") * 1e6 + F.col("v")).alias("far"),
        F.when(F.col("id") % 4 != 0, F.col("v") * 2 + F.col("id") % 3).alias("near"),
        (F.col("id") % 5).alias("five"),
    )
    want = data.toPandas().astype(float).corr()
    got = corr_pairs(data, data.columns).collect()
    assert len(got) == 10
    for r in got:
        assert r["r"] == pytest.approx(want.loc[r["var_x"], r["var_y"]], abs=1e-12)
    lines = {(r["var_x"], r["var_y"]): r for r in pair_regression(data, ["near", "v"]).collect()}
    both = data.toPandas()[["near", "v"]].dropna().astype(float)
    slope = both["near"].cov(both["v"]) / both["near"].var()
    assert lines["near", "v"]["slope"] == pytest.approx(slope)
    assert lines["near", "v"]["intercept"] == pytest.approx(both["v"].mean() - slope * both["near"].mean())


def test_wide_and_long_means_agree(messy):
    cols = {f"c{i}": F.col("v") * i + F.col("w") for i in range(15)}
    many = mean_sem_wide(messy, ["g"], cols)
    few = mean_sem_wide(messy, ["g"], {k: cols[k] for k in ("c0", "c9")})
    wide = {(r["g"], r["variable"]): tuple(r)[2:] for r in few.collect()}
    long = {(r["g"], r["variable"]): tuple(r)[2:] for r in many.collect()}
    assert len(long) == 15 * len(wide) // 2
    for key, numbers in wide.items():
        assert long[key] == pytest.approx(numbers)


def test_degenerate_correlations(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, 2.0, None), (2.0, 5.0, 4.0, None), (3.0, 5.0, 6.0, 1.0)],
        "a double, b double, c double, d double",
    )
    for method in ("pearson", "spearman"):
        got = {(r["var_x"], r["var_y"]): r for r in corr_test(corr_pairs(df, list("abcd"), method)).collect()}
        assert got["a", "b"]["r"] is None and got["a", "b"]["p"] is None
        assert got["a", "d"]["n"] == 1 and got["a", "d"]["r"] is None
        assert got["a", "c"]["r"] == pytest.approx(1.0)
        assert got["a", "c"]["p"] == pytest.approx(0.0, abs=1e-7)
    sig = corr_significant(df, list("abcd"), "spearman", "pearson")
    assert [(r["var_x"], r["var_y"]) for r in sig.collect()] == [("a", "c")]
    lines = {(r["var_x"], r["var_y"]): r for r in pair_regression(df, list("abcd")).collect()}
    assert lines["a", "c"]["slope"] == pytest.approx(2.0) and lines["a", "c"]["r2"] == pytest.approx(1.0)
    assert lines["b", "c"]["slope"] is None


def test_histogram_counts_everything(spark, messy):
    hist = group_histogram(messy, "g", "v", bins=7)
    want = {r["g"]: r["n"] for r in messy.groupBy("g").agg(F.count("v").alias("n")).collect()}
    got = {r["g"]: (r["n"], r["b"]) for r in hist.groupBy("g").agg(F.sum("count").alias("n"), F.count("bin").alias("b")).collect()}
    assert got == {g: (n, 7) for g, n in want.items()}
    flat = spark.createDataFrame([("c", 4.0)] * 3, "g string, v double")
    rows = {r["bin"]: r for r in group_histogram(flat, "g", "v", bins=2).collect()}
    assert (rows[0]["low"], rows[1]["high"]) == (3.5, 4.5)
    assert (rows[0]["count"], rows[1]["count"]) == (0, 3)


def test_left_lookup_matches_missing_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    lookup = lookup_table(spark, [("a", "A"), (None, "none")], "k string, v string")
    got = rows_of(J.left_lookup(df, lookup, "k"))
    assert got == [(1, "a", "A"), (2, None, "none"), (3, "z", None)]


def test_right_lookup_keeps_unused_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "z")], "id int, k string")
    lookup = lookup_table(spark, [("a", "A"), ("b", "B")], "k string, v string")
    assert rows_of(J.right_lookup(df, lookup, "k")) == [(1, "a", "A"), (2, "a", "A"), (None, "b", "B")]


def test_lookup_tables_are_broadcast_by_their_size(spark, messy):
    lookup = lookup_table(spark, [("big", 1)], "g string, size int")
    plan = J.left_lookup(messy, lookup, "g")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert lookup_table(spark, [("x", 1)] * 100_001, "g string, size int").count() == 100_001


def test_align_rejects_duplicate_keys(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(2, 0.5), (1, 0.25)], "k int, y double")
    assert rows_of(J.align_by_key(a, b, "k")) == [(1, "a", 0.25), (2, "b", 0.5)]
    with pytest.raises(Exception, match="duplicate key in k: 2"):
        J.align_by_key(a, b.union(b.filter("k = 2")), "k").collect()


def test_joins_with_group_statistics_keep_every_row(spark):
    # One key holds most rows, many others a single one each.
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") < 4000, 0).otherwise(F.col("id")))
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert J.join_stats(rows, stats, ["k"]).filter("n = 4000").count() == 4000
    assert J.join_stats(rows, stats, ["k"]).select("id").distinct().count() == 5000


def test_impute_leaves_text_alone(spark):
    df = spark.createDataFrame([("a", 1, None), (None, None, 4.0), ("c", 4, 6.0)], "s string, i int, d double")
    assert rows_of(impute_mean(df)) == [("a", 1.0, 5.0), ("c", 4.0, 6.0), (None, 2.5, 4.0)]
    assert dict(impute_mean(df).dtypes)["i"] == "double"


def test_missing_tables(spark, gaps):
    got = [tuple(r) for r in missing_share(gaps, ["g", "v"]).collect()]
    assert got == [("v", 2, pytest.approx(2 / 6)), ("g", 1, pytest.approx(1 / 6))]
    margins = {r["other"]: r for r in margin_summary(gaps, "v", "g").collect()}
    assert margins["missing"]["n"] == 1 and margins["present"]["n"] == 3
    assert (margins["present"]["missing_x_only"], margins["present"]["missing_y_only"]) == (2, 1)


def test_profiles(spark, gaps):
    [d] = describe_numeric(gaps).collect()
    assert (d["count"], d["min"], d["median"], d["max"], d["n_missing"]) == (4, 1.0, 4.0, 7.0, 2)
    [v] = variable_summary(gaps, "v").collect()
    assert (v["q1"], v["q3"]) == (2.5, 5.5)
    nothing = spark.createDataFrame([(None,)], "v double")
    [e] = describe_numeric(nothing).collect()
    assert (e["count"], e["median"], e["n_missing"]) == (0, None, 1)


def test_symbol_size(spark):
    df = spark.createDataFrame([(4.0, 100.0), (1.0, 25.0), (None, -1.0)], "a double, b double")
    got = rows_of(symbol_size(df, ["a"], 60).select("a_size"))
    assert got == [(30.0,), (60.0,), (None,)]
    shared = symbol_size(df, ["a", "b"], 100, shared_max=True).select("a_size", "b_size")
    assert rows_of(shared) == [(10.0, 50.0), (20.0, 100.0), (None, None)]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, " x ", 3)], "a int, b double, c string, d int")
    assert C.select_range(df, "b", "d").columns == ["b", "c", "d"]
    assert C.rename_cols(df, {"a": "z"}).columns == ["z", "b", "c", "d"]
    assert C.reorder_cols(df, list("dcba")).columns == list("dcba")
    assert C.cast_category(df, ["a", "c"]).first()[:3] == ("1", 2.0, "x")
    for bad in (
        lambda: C.select_range(df, "d", "b"),
        lambda: C.rename_cols(df, {"q": "z"}),
        lambda: C.reorder_cols(df, ["a", "b"]),
    ):
        with pytest.raises(ValueError):
            bad()


def test_significance_ignores_missing_p(spark):
    tests = spark.createDataFrame([(0.05,), (0.051,), (None,)], "p_adjusted double")
    assert rows_of(C.significant_only(tests)) == [(0.05,)]


def test_to_long_keeps_nulls_and_widens(spark):
    df = spark.createDataFrame([(1, None, 2.5), (2, 7, None)], "id int, i int, d double")
    assert rows_of(to_long(df, ["id"], ["i", "d"])) == [
        (1, "d", 2.5), (1, "i", None), (2, "d", None), (2, "i", 7.0),
    ]


def test_survey_csv_round_trip(spark, tmp_path):
    schema = T.StructType(
        [
            T.StructField("Number", T.IntegerType()),
            T.StructField("Date", T.DateType()),
            T.StructField("Time", T.StringType()),
            T.StructField("CH4 Flux  (mg/m2/d)", T.DoubleType()),
        ]
    )
    path = str(tmp_path / "survey.csv")
    with open(path, "w") as f:
        f.write("Number,Date,Time,CH4 Flux  (mg/m2/d)\n1,17/09/2018,10:25,0.5\n2,NA,9:30,NA\n")
    df = read_survey(spark, path, schema)
    want = [(1, datetime.date(2018, 9, 17), "10:25", 0.5), (2, None, "9:30", None)]
    assert [tuple(r) for r in df.orderBy("Number").collect()] == want
    for fmt in ("csv", "parquet"):
        out = str(tmp_path / fmt)
        write_table(df, out, fmt)
        again = read_survey(spark, out, schema, fmt)
        assert [tuple(r) for r in again.orderBy("Number").collect()] == want


def test_preview(spark):
    df = spark.range(20)
    assert [r[0] for r in preview(df, "id", 3).collect()] == [0, 1, 2]
    assert [r[0] for r in preview(df, "id", 2, last=True).collect()] == [19, 18]


def test_spearman_of_coded_rows_with_gaps(spark):
    """Many rows are equal but for what is missing in them."""
    draw = np.random.default_rng(4)
    frame = pd.DataFrame(draw.integers(0, 3, (300, 5)).astype(float), columns=list("abcde"))
    frame = frame.mask(draw.random((300, 5)) < 0.3)
    frame.loc[0], frame.loc[1] = [1, None, 2, 2, 0], [None, 1, 2, 2, 0]
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in frame.to_numpy().tolist()], "a double, b double, c double, d double, e double")
    want = frame.corr(method="spearman")
    for size in (4_000_000, 20):
        for r in corr_pairs(df, list("abcde"), "spearman", size).collect():
            both = frame[[r["var_x"], r["var_y"]]].dropna()
            assert r["n"] == len(both)
            assert r["r"] == pytest.approx(want.loc[r["var_x"], r["var_y"]], abs=1e-9)


def test_correlation_of_many_columns(spark):
    cols = [f"c{i:03d}" for i in range(320)]
    df = spark.range(20).select(*[((F.col("id") * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(cols)])
    assert corr_pairs(df, cols).count() == 320 * 319 // 2


def test_dunn_of_many_groups(spark):
    df = spark.range(4_000).select((F.col("id") % 2_000).alias("g"), (F.col("id") % 997).cast("double").alias("v"))
    assert dunn_test(df, [], "g", "v").count() == 2_000 * 1_999 // 2


def test_ranks_keep_whole_numbers_apart(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (5,)], "v long")
    for size in (4_000_000, 1):
        ranks = {r["v"]: r["mid_rank"] for r in mid_rank(df, [], "v", rows_per_segment=size).collect()}
        assert ranks == {5: 1.0, 2**53: 2.0, 2**53 + 1: 3.0}


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, nan), ("b", 3, 8.0), ("b", 2**53 + 1, None)], "g string, k long, v double")
    assert {r["v"] for r in impute_mean(df, keep=["k"]).collect()} == {2.0, 5.0, 8.0}
    assert [r["k"] for r in impute_mean(df, keep=["k"]).orderBy("k").collect()] == [1, 2, 3, 2**53 + 1]
    assert [r["n_missing"] for r in missing_share(df, ["v"]).collect()] == [2]
    assert {(r["has_v"], r["n"]) for r in missing_pattern(df, ["v"]).collect()} == {(0, 2), (1, 2)}
    assert {r["g"]: r["v"] for r in group_sum(df, ["g"], ["v"], "omit").collect()} == {"a": 2.0, "b": 8.0}
    assert {r["g"]: r["v"] for r in group_sum(df, ["g"], ["v"]).collect()} == {"a": None, "b": None}
    assert [r["v_size"] for r in symbol_size(df, ["v"], 10).orderBy("k").collect()] == [5.0, None, 10.0, None]


def test_bad_cells_of_a_survey(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    with open(path, "w") as f:
        f.write("site,v\n1,2.5\n2,abc\n3,NA\n")
    with pytest.raises(Exception):
        read_survey(spark, path, "site int, v double").collect()
    got = read_survey(spark, path, "site int, v double", bad_cells="keep").orderBy("site").collect()
    assert [(r["site"], r["v"], r["_bad_line"]) for r in got] == [(1, 2.5, None), (2, None, "2,abc"), (3, None, None)]


def test_student_tail_for_any_degrees_of_freedom(spark):
    df = spark.createDataFrame([(t, d) for t in (0.0, 0.3, 1.5, 2.0, 6.0) for d in (1.0, 3.0, 40.0, 1e5, 1e6, 1e12)], "t double, d double")
    for r in df.withColumn("p", student_two_sided(F.col("t"), F.col("d"))).collect():
        if r["d"] == 1:
            assert r["p"] == pytest.approx(1 - 2 / math.pi * math.atan(r["t"]), rel=1e-9)
        if r["d"] >= 1e6:
            rel = 1e-4 if r["d"] == 1e12 else 1e-2
            assert r["p"] == pytest.approx(math.erfc(r["t"] / math.sqrt(2)), rel=rel)


def test_regression_errors(spark):
    x = [1.0, 2.0, 4.0, 7.0, 9.0]
    y = [1.5, 2.0, 4.5, 6.0, 9.5]
    [r] = pair_regression(spark.createDataFrame(list(zip(x, y)), "x double, y double"), ["x", "y"]).collect()
    slope, intercept = np.polyfit(x, y, 1)
    left = np.array(y) - slope * np.array(x) - intercept
    sd = math.sqrt((left**2).sum() / 3)
    assert r["residual_sd"] == pytest.approx(sd)
    assert r["slope_se"] == pytest.approx(sd / math.sqrt(((np.array(x) - np.mean(x)) ** 2).sum()))


@pytest.mark.parametrize("size", [1_000_000, 30])
def test_labels_side_by_side_are_tested_like_long_rows(spark, size):
    rows = [(f"p{i % 3}" if i % 7 else None, f"q{i * i % 4}" if i % 5 else None, "AB"[i % 2], float(i * 37 % 101), 1 + i % 3) for i in range(400)]
    cells = spark.createDataFrame(rows, "`a x` string, b string, gas string, v double, n long")
    sides = {"first": ["a x"], "second": ["b"], "both": ["a x", "b"]}
    lines = [(side, r[("a x", "b").index(c)], *r[2:]) for r in rows for side, columns in sides.items() for c in columns]
    long = spark.createDataFrame(lines, "side string, label string, gas string, v double, n long")
    for many, one in ((ranks.dunn_test_by_label, ranks.dunn_test), (ranks.kruskal_wallis_by_label, ranks.kruskal_wallis)):
        got = many(kept(cells), ["gas"], sides, "side", "label", "v", rows_per_segment=size)
        want = one(long, ["side", "gas"], "label", "v", weight="n")
        assert got.columns == want.columns
        for g, w in zip(sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, want.collect()), key=str), strict=True):
            assert g == pytest.approx(w)


def test_dunn_sorts_its_cells_once(messy):
    plan = ranks.dunn_test(messy, [], "g", "v", rows_per_segment=50)._jdf.queryExecution().optimizedPlan().toString()
    assert SEGMENT not in plan and "Window" in plan


def test_quartiles_sort_the_segments_that_hold_them_only(spark, monkeypatch):
    monkeypatch.setattr(positions, "SMALLEST", 20)
    values = [(g, float((i * 7919) % 4001)) for g in ("a", "b") for i in range(4001)]
    rows = spark.createDataFrame(values + [("c", 3.0)] * 500, "g string, v double")
    pos = positions.locate(rows, ["g"], "v", least=positions.COARSE)
    sorted_cells = []
    ranked = positions.ranked_cells
    monkeypatch.setattr(positions, "ranked_cells", lambda p, tied: sorted_cells.append(p.cells.count()) or ranked(p, tied))
    got = {r.g: (r.q1, r.median, r.q3) for r in positions.quartiles(pos).collect()}
    assert got == {"a": (1000.0, 2000.0, 3000.0), "b": (1000.0, 2000.0, 3000.0), "c": (3.0, 3.0, 3.0)}
    assert pos.cells.count() == 8003 and sorted_cells[0] < 400


def test_boxes_of_folded_cells(spark, messy):
    cells = [("a", 1.0, 2), ("a", 2.0, 1), ("a", 1.0, 3), ("a", 50.0, 1), ("b", 4.0, 1), (None, 9.0, 1), ("b", None, 5)]
    frame = spark.createDataFrame(cells, "g string, v double, w int")
    plain = spark.createDataFrame([(g, v) for g, v, w in cells for _ in range(w)], "g string, v double")
    want = rows_of(box_stats(plain, ["g"], "v"))
    assert rows_of(box_stats(kept(frame), ["g"], "v", weight="w", folded=True)) == want
    assert rows_of(box_stats(frame, ["g"], "v", weight="w")) == want
