"""Numeric expressions used by metrics, selection and forecast clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Square kilometres used when a table carries no density.
LAND_AREA_KM2 = 62710.0
# Replacements for an unusable predicted share, and the range that autoregressive shares are held in.
SHARE_FILL = {"nan": 0.05, "posinf": 0.3, "neginf": 0.01}
SHARE_RANGE = (0.01, 0.5)
# Error size treated as an exploded forecast, floor of the train error, penalty weight.
EXPLODED_ERROR = 1e150
TRAIN_FLOOR = 0.5
OVERFIT_WEIGHT = 0.5
# Fixed value: growth per month of the fallback total forecast.
MONTHLY_GROWTH = 0.008

_INF = float("inf")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(_INF))


def is_valid(c: Column) -> Column:
    """A prediction that can be scored: neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def replace_nonfinite(c: Column, nan: float, posinf: float, neginf: float) -> Column:
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(nan))
        .when(c == F.lit(_INF), F.lit(posinf))
        .when(c == F.lit(-_INF), F.lit(neginf))
        .otherwise(c)
    )


def clean_share(c: Column, limits: tuple[float, float] | None = None) -> Column:
    """Predicted share made usable: held inside ``limits`` if there are any, infinite ones too, then what is not finite is replaced."""
    bounded = c if limits is None else F.when(is_valid(c), clip(c, *limits)).otherwise(c)
    return replace_nonfinite(bounded, **SHARE_FILL)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def truncate(c: Column) -> Column:
    return c.cast("long")


def linear_growth(value: Column, months: Column, rate: float = MONTHLY_GROWTH) -> Column:
    return value * (F.lit(1.0) + F.lit(rate) * months)


def density(total: Column, area: float = LAND_AREA_KM2) -> Column:
    return total / F.lit(area)


def part_of(total: Column, pct: Column) -> Column:
    return total * (pct / F.lit(100.0))


def accuracy(mape: Column) -> Column:
    return F.lit(100.0) - mape


def val_train_ratio(train: Column, val: Column, floor: float = TRAIN_FLOOR) -> Column:
    return val / F.greatest(train, F.lit(floor))


def selection_score(train: Column, val: Column) -> Column:
    """Validation error, raised when it exceeds the (floored) train error; lower is better."""
    excess = F.greatest(F.lit(0.0), val_train_ratio(train, val) - 1)
    return val * (1 + F.lit(OVERFIT_WEIGHT) * excess)


def aicc(aic: Column, n: Column, k: Column) -> Column:
    """Small-sample correction; NULL when the series is too short for it."""
    room = n - k - 1
    return F.when(room > 0, aic + 2 * k * (k + 1) / room)


def fit_status(train: Column, val: Column) -> Column:
    """Label from train and validation error: too much bias, too much variance, or good. Any validation error over a train error of 0 is variance."""
    # The labels.
    return (
        F.when(train > 5, "Underfitting (High Bias)")
        .when(((train == 0) & (val > 0)) | (val / F.nullif(train, F.lit(0.0)) > 5), "Overfitting (High Variance)")
        .otherwise("Good Fit")
    )


def overfit_level(train: Column, val: Column) -> Column:
    """Two-step variant: label by the ratio of validation to train error, floor 0.01."""
    ratio = val / F.greatest(train, F.lit(0.01))
    return F.when(ratio < 5, "OK").when(ratio < 10, "Check").otherwise("Overfitting")
