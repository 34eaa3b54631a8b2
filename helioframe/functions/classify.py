"""Class ladders, labels, decisions and rewards as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.schema import FLUX_CUTS, RISK_LABELS

# --- fixed values: cost table of the scorer ----------------------------------
SAMPLE_WEIGHTS = {0: 0.5, 1: 1.0, 2: 8.0, 3: 20.0}
CORRECT_REWARDS = {0: 0.1, 1: 0.5, 2: 2.0, 3: 5.0}
MISSED_X, MISSED_M, MISSED_C, OTHER_ERROR = -20.0, -8.0, -0.3, -0.5
DECISION_CUTS = (0.30, 0.20, 0.15)
# lower bound of the peak flux, text, unit of the quoted figure
BLACKOUT_SCALE = (
    (2e-3, "R5 (Extreme Blackout)", None),
    (1e-3, "R4 (Severe Blackout)", None),
    (1e-4, "R3 (Strong Blackout - X%.1f)", 1e-4),
    (5e-5, "R2 (Moderate Blackout - M%.1f)", 1e-5),
    (1e-5, "R1 (Minor Blackout - M%.1f)", 1e-5),
    (1e-6, "R0 (No Radio Blackout - C-Class)", None),
)
QUIET_SUN = "R0 (Normal Quiet Sun)"
ACTIVE_DIAGNOSIS = "High Magnetic Reconnection Activity"
QUIET_DIAGNOSIS = "Nominal Quiet Sun Solar Magnetic Field"
REWARD_LABELS = {
    5.0: "X-CLASS CORRECT",
    2.0: "M-CLASS CORRECT",
    -20.0: "MISSED X-CLASS",
    -8.0: "MISSED M-CLASS",
}
# -----------------------------------------------------------------------------


def _lookup(key: Column, table: dict, default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def flux_class(flux: Column, cuts: Sequence[float] = FLUX_CUTS) -> Column:
    """0..len(cuts); a bound belongs to the upper class and a missing flux is class 0."""
    out = None
    for level in range(len(cuts), 0, -1):
        hit = flux >= F.lit(cuts[level - 1])
        out = F.when(hit, F.lit(level)) if out is None else out.when(hit, F.lit(level))
    return out.otherwise(F.lit(0))


def risk_label(code: Column) -> Column:
    return _lookup(code, dict(enumerate(RISK_LABELS)), RISK_LABELS[0])


def sample_weight(code: Column) -> Column:
    return _lookup(code, SAMPLE_WEIGHTS)


def decide(p1: Column, p2: Column, p3: Column, cuts: Sequence[float] = DECISION_CUTS) -> Column:
    """Most severe class whose own threshold is reached; not an arg-max."""
    c, m, x = (F.lit(v) for v in cuts)
    return F.when(p3 >= x, 3).when(p2 >= m, 2).when(p1 >= c, 1).otherwise(0)


def reward(y_true: Column, y_pred: Column) -> Column:
    return (
        F.when(y_true == y_pred, _lookup(y_true, CORRECT_REWARDS))
        .when((y_true == 3) & (y_pred < 3), F.lit(MISSED_X))
        .when((y_true == 2) & (y_pred < 2), F.lit(MISSED_M))
        .when((y_true == 1) & (y_pred == 0), F.lit(MISSED_C))
        .otherwise(F.lit(OTHER_ERROR))
    )


def reward_label(value: Column) -> Column:
    return _lookup(value, REWARD_LABELS, "")


def radio_blackout(flux: Column) -> Column:
    """Blackout scale text for a peak flux; graded steps quote the peak in their own unit."""
    out = None
    for floor, text, unit in BLACKOUT_SCALE:
        shown = F.lit(text) if unit is None else F.format_string(text, flux / F.lit(unit))
        out = F.when(flux >= floor, shown) if out is None else out.when(flux >= floor, shown)
    return out.otherwise(F.lit(QUIET_SUN))


def diagnosis(m_count: Column, x_count: Column) -> Column:
    return F.when(m_count + x_count > 0, ACTIVE_DIAGNOSIS).otherwise(QUIET_DIAGNOSIS)
