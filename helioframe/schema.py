"""Column contracts and the fixed values every job shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names and thresholds of the public data contract ---------
LONG_BAND = "0.1-0.8nm"
SHORT_BAND = "0.05-0.4nm"

LONG = "GOES_LONG_FLUX"
SHORT = "GOES_SHORT_FLUX"
SOFT_COUNTS = "SoLEXS_COUNTS"
HARD_COUNTS = "HEL1OS_COUNTS"
TIME = "timestamp"

LONG_DEFAULT, LONG_FLOOR = 1e-8, 1e-9
SHORT_DEFAULT, SHORT_FLOOR = 1e-9, 1e-10

FLUX_CUTS = (1e-6, 1e-5, 1e-4)
RISK_LABELS = ("NOMINAL", "C-CLASS", "M-CLASS", "X-CLASS")

# look-ahead name -> number of rows
HORIZONS = {"15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240}
LONG_HORIZONS = {"12h": 720, "24h": 1440}

FEATURES = (
    "GOES_LONG_FLUX", "GOES_SHORT_FLUX", "SoLEXS_COUNTS", "HEL1OS_COUNTS",
    "goes_long_smooth", "goes_long_vel", "goes_long_accel",
    "goes_short_smooth", "goes_short_vel", "goes_short_accel",
    "hardness_ratio", "long_flux_var_5m", "log_volatility_10m",
)

READABLE_NAMES = {
    "GOES_LONG_FLUX": "GOES Long Flux",
    "GOES_SHORT_FLUX": "GOES Short Flux",
    "SoLEXS_COUNTS": "SoLEXS Soft X-Ray",
    "HEL1OS_COUNTS": "HEL1OS Hard X-Ray",
    "goes_long_smooth": "Long Flux Smooth",
    "goes_long_vel": "Long Flux Velocity",
    "goes_long_accel": "Long Flux Accel",
    "goes_short_smooth": "Short Flux Smooth",
    "goes_short_vel": "Short Flux Velocity",
    "goes_short_accel": "Short Flux Accel",
    "hardness_ratio": "Hardness Ratio (S/L)",
    "long_flux_var_5m": "Flux Variance (5m)",
    "log_volatility_10m": "Flux Volatility (10m)",
}
# -----------------------------------------------------------------------------

FEED_SCHEMA = T.StructType([
    T.StructField("energy", T.StringType()),
    T.StructField("flux", T.DoubleType()),
    T.StructField("time_tag", T.StringType()),
])

RAW_COLUMNS = (TIME, LONG, SHORT, SOFT_COUNTS, HARD_COUNTS)

FEATURE_COLUMNS = (
    RAW_COLUMNS
    + FEATURES[4:]
    + ("PredictedClass", "RiskLabel")
    + tuple(f"Target{kind}_{h}" for h in HORIZONS for kind in ("Class", "Peak"))
)
