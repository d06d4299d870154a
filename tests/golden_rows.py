"""36 published sites, only what the golden numbers need.

Columns: river, Prati class, dissolved oxygen (mg/L), CO2 flux (mg/m2/d), dissolved CO2
(mg/L).
"""

SITES = """
Tarqui,Good Quality,7.24,562.878686,1080.625597
Tarqui,Acceptable Quality,7.3,577.0826525,1057.474314
Tarqui,Good Quality,7.56,564.2625208,1045.239915
Tarqui,Acceptable Quality,6.67,1228.119025,1507.843418
Tarqui,Acceptable Quality,6.39,954.0527564,1352.980655
Tarqui,Very Heavily Polluted,5.54,4721.774534,6435.652859
Tarqui,Polluted,6.73,851.9754813,1496.067774
Yanuncay,Good Quality,7.33,641.1245606,815.4738168
Yanuncay,Acceptable Quality,7.2,904.1549977,1002.341072
Yanuncay,Good Quality,7.1,728.884922,853.2873572
Yanuncay,Acceptable Quality,7.2,758.226465,856.6146504
Yanuncay,Good Quality,7.3,863.0987358,833.9686183
Yanuncay,Polluted,7.12,929.013514,854.3465216
Yanuncay,Polluted,6.97,1188.111304,971.5350555
Tomebamba,Very Heavily Polluted,3.26,14607.79551,11612.09961
Tomebamba,Very Heavily Polluted,2.73,7714.788748,8030.550723
Tomebamba,Acceptable Quality,6.74,1339.135757,1565.185755
Machangara,Acceptable Quality,7.75,613.3004209,982.9701223
Machangara,Acceptable Quality,7.35,945.8034071,1100.838797
Machangara,Acceptable Quality,7.42,846.7938948,1260.83269
Machangara,Good Quality,7.42,680.0386745,1044.209889
Machangara,Acceptable Quality,7.07,1073.020036,1228.405995
Cuenca,Heavily Polluted,6.68,1425.133645,1562.743004
Cuenca,Heavily Polluted,5.87,4426.561176,4417.265419
Cuenca,Heavily Polluted,7.01,1987.046006,2106.19694
Cuenca,Heavily Polluted,6.95,1818.011146,1957.154197
Tomebamba,Polluted,7.6,1419.659626,1703.332096
Tomebamba,Polluted,7.74,2091.146762,1730.848512
Tomebamba,Acceptable Quality,7.08,881.9776689,565.1967371
Tomebamba,Acceptable Quality,6.48,4323.083752,2351.194753
Tomebamba,Heavily Polluted,3.24,8173.274679,4607.680534
Tomebamba,Polluted,6.88,2616.413326,1769.26455
Tomebamba,Polluted,6.96,2116.375857,1743.103383
Tomebamba,Polluted,6.51,4523.70637,2928.849424
Tarqui,Heavily Polluted,2.69,9068.358209,7335.585204
Tarqui,Polluted,6.91,1050.860986,1161.742736
"""


def site_rows() -> list[tuple]:
    rows = []
    for line in SITES.strip().splitlines():
        river, prati, do, flux, dissolved = line.split(",")
        rows.append((river, prati, float(do), float(flux), float(dissolved)))
    return rows
