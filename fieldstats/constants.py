"""Fixed values of the river greenhouse-gas study.

Everything here is a published number or a label; none of it is tuned.
"""

# Global warming potential, relative to CO2.
GWP = {"CO2": 1.0, "CH4": 28.0, "N2O": 265.0}

# Catchment area in km2.
AREAS = {
    "Cuenca": 95.92,
    "Machangara": 111.19,
    "Tarqui": 138.98,
    "Tomebamba": 113.03,
    "Yanuncay": 113.81,
}

# Molar mass used when a molar flux becomes a mass flux (g/mol).
FLUX_MOLAR_MASS = {"CO2": 44.0, "CH4": 16.0, "N2O": 44.0}

# Molar mass used in the headspace equilibration (g/mol).
AQUEOUS_MOLAR_MASS = {"CO2": 44.0, "CH4": 16.0, "N2O": 44.0}

# Henry coefficients A, B, C, D.
HENRY = {
    "N2O": (-180.95, 13205.8, 20.0399, 0.0238544),
    "CH4": (-365.183, 18106.7, 49.7554, -0.00028503),
    "CO2": (-317.658, 17371.2, 43.0607, -0.000219107),
}

GAS_CONSTANT_CAL = 1.98719  # cal / (K mol)
KELVIN = 273.15
MOLAR_VOLUME_STP = 22.4  # L/mol at 0 C
MOLAR_VOLUME_25C = 24.45  # L/mol at 25 C
WATER_MOLARITY = 55.5  # mol/L

# ug/L to ppm: (molar mass) for N2O and CH4, (slope, intercept) for CO2.
PPM_MOLAR_MASS = {"N2O": 44.013, "CH4": 16.04}
PPM_CO2_LINE = (581.68, -5.2707)

DAYS_PER_YEAR = 365.0

# Water-quality classes, best first.
PRATI_LEVELS = [
    "Good Quality",
    "Acceptable Quality",
    "Polluted",
    "Heavily Polluted",
    "Very Heavily Polluted",
]
OREGON_LEVELS = ["Good", "Fair", "Poor", "Very Poor"]
OREGON_TO_PRATI = {
    "Good": "Acceptable Quality",
    "Fair": "Polluted",
    "Poor": "Heavily Polluted",
    "Very Poor": "Very Heavily Polluted",
}

# The same pairs in the order the sequential replacement applies them.
OREGON_REPLACEMENTS = [
    ("Good", "Acceptable Quality"),
    ("Fair", "Polluted"),
    ("Very Poor", "Very Heavily Polluted"),
    ("Poor", "Heavily Polluted"),
]

LAND_USE_CLASS = {
    "Forest": "Nature",
    "River": "Nature",
    "Factory": "Industry",
    "Mining": "Industry",
    "Arable": "Agriculture",
    "Orchard": "Agriculture",
    "Road": "Road",
    "Construction": "Urban",
    "Resident": "Urban",
    "Urban": "Urban",
}
LAND_USE_LEVELS = ["Nature", "Industry", "Agriculture", "Road", "Urban"]

TRIBUTARY_ORDER = ["Machangara", "Yanuncay", "Cuenca", "Tarqui", "Tomebamba"]

# Predictors of the per-gas model input, in output order.
FEATURE_COLUMNS = {
    "CO2": ["DO", "NH", "NO", "Vel", "Depth", "Tw"],
    "CH4": ["DO", "COD", "Vel", "Depth", "Tw"],
    "N2O": ["DO", "NH", "NO", "COD", "Depth", "Tw"],
}
