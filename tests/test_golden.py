"""Published and reproduced numbers of the study."""

import pytest
from pyspark.sql import functions as F

from fieldstats.operators.correlation import corr_pairs, corr_test
from fieldstats.operators.distribution import box_stats
from fieldstats.operators.ranks import dunn_test, kruskal_wallis
from fieldstats.operators.summary import annual_emission, mean_sem


def test_mean_and_error_by_river(sites):
    got = {r["river"]: (r["n"], r["mean"], r["sem"]) for r in mean_sem(sites, ["river"], "flux").collect()}
    want = {
        "Cuenca": (4, 2414.187993, 681.037899),
        "Machangara": (5, 831.791287, 84.315558),
        "Tarqui": (9, 2175.484983, 965.750817),
        "Tomebamba": (11, 4527.941641, 1256.330873),
        "Yanuncay": (7, 858.944928, 67.228615),
    }
    assert set(got) == set(want)
    for river, (n, mean, sem) in want.items():
        assert got[river][0] == n
        assert got[river][1:] == pytest.approx((mean, sem), abs=1e-6)


def test_mean_overall_and_by_class(sites):
    [all_sites] = mean_sem(sites, [], "flux").collect()
    assert (all_sites["mean"], all_sites["sem"]) == pytest.approx((2478.195717, 508.370348), abs=1e-6)
    got = {r["prati"]: (r["mean"], r["sem"]) for r in mean_sem(sites, ["prati"], "flux").collect()}
    assert got["Very Heavily Polluted"] == pytest.approx((9014.786264, 2926.935134), abs=1e-6)
    assert got["Good Quality"] == pytest.approx((673.381350, 46.287475), abs=1e-6)


def test_published_yearly_emission(sites):
    yearly = annual_emission(mean_sem(sites, ["river"], "flux"), "river", ["mean", "sem"])
    [row] = yearly.filter("river = 'Tomebamba'").collect()
    assert (row["mean_gg_yr"], row["sem_gg_yr"]) == pytest.approx((186.805, 51.831), abs=1e-3)


@pytest.mark.parametrize("rows_per_segment", [1_000_000, 5])
def test_box_by_river(sites, rows_per_segment):
    boxes = box_stats(sites, ["river"], "flux", rows_per_segment=rows_per_segment)
    got = {r["river"]: r for r in boxes.collect()}
    want = {
        "Cuenca": (1719.7918, 1902.5286, 2596.9248, 1425.1336, 1987.0460, 1),
        "Machangara": (680.0387, 846.7939, 945.8034, 613.3004, 1073.0200, 0),
        "Tarqui": (577.0827, 954.0528, 1228.1190, 562.8787, 1228.1190, 2),
        "Tomebamba": (1755.4032, 2616.4133, 6119.2476, 881.9777, 8173.2747, 1),
        "Yanuncay": (743.5557, 863.0987, 916.5843, 641.1246, 929.0135, 1),
    }
    for river, numbers in want.items():
        r = got[river]
        found = [r[c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")]
        assert found == pytest.approx(numbers, abs=1e-4)


def test_correlation_with_oxygen(sites):
    [p] = corr_test(corr_pairs(sites, ["DO", "flux"])).collect()
    assert (p["r"], p["t"]) == pytest.approx((-0.899751, -12.021892), abs=1e-6)
    assert p["p"] == pytest.approx(8.5568e-14, rel=1e-3)
    for rows_per_segment in (1_000_000, 7):
        [s] = corr_pairs(sites, ["DO", "flux"], "spearman", rows_per_segment).collect()
        assert s["r"] == pytest.approx(-0.748922, abs=1e-6)


@pytest.mark.parametrize("rows_per_segment", [1_000_000, 6])
def test_rank_tests_of_dissolved_co2(sites, rows_per_segment):
    data = sites.withColumn("gas", F.lit("CO2"))
    args = (data, ["gas"], "prati", "dissolved")
    [h] = kruskal_wallis(*args, rows_per_segment=rows_per_segment).collect()
    assert h["h"] == pytest.approx(21.711712, abs=1e-6) and h["df"] == 4
    tests = dunn_test(*args, rows_per_segment=rows_per_segment).collect()
    assert len(tests) == 10
    got = {(t["group_a"], t["group_b"]): (t["z"], t["p_adjusted"]) for t in tests if t["p_adjusted"] <= 0.05}
    want = {
        ("Acceptable Quality", "Heavily Polluted"): (-2.752558, 0.029566),
        ("Good Quality", "Heavily Polluted"): (-3.561978, 0.001840),
        ("Acceptable Quality", "Very Heavily Polluted"): (-2.989873, 0.013955),
        ("Good Quality", "Very Heavily Polluted"): (-3.691358, 0.001115),
    }
    assert set(got) == set(want)
    for pair, numbers in want.items():
        assert got[pair] == pytest.approx(numbers, abs=1e-6)
