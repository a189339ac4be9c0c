"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero: sums depend on their order in the last bits."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def normalised(value: Column, mean: float = 0.0, sd: float = 0.0) -> Column:
    """v, v - mean, or (v - mean) / sd, as mean and sd are zero or not."""
    v = value.cast("double")
    if mean == 0:
        return v
    return v - mean if sd == 0 else (v - mean) / sd


def range_threshold(value: Column, low: float, high: float, on: int = 255) -> Column:
    """`on` inside the range; outside it the value stays as it is."""
    return F.when(value.between(low, high), F.lit(on)).otherwise(value)


def above_line(axis: Column, z: Column, value: Column, slope: float, offset: float) -> Column:
    """Zero at and beyond the line z = slope * axis + offset."""
    return F.when(z >= F.greatest(F.lit(0), F.floor(axis * slope + offset)), F.lit(0)).otherwise(value)


def no_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(0.0))


def binary_target(grade: Column, limit: int = 1) -> Column:
    return (grade > limit).cast("int")


def clipped(prediction: Column, high: Column | float, low: float = 0.0) -> Column:
    return F.least(F.greatest(prediction, F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def forward(grade: Column, kind: str | None) -> Column:
    """Target transform before a fit: exp, log or none."""
    return F.exp(grade) if kind == "exp" else F.log(grade) if kind == "log" else grade


def backward(prediction: Column, kind: str | None) -> Column:
    return F.log(prediction) if kind == "exp" else F.exp(prediction) if kind == "log" else prediction


def sample_name(path: Column) -> Column:
    """File name without its last part after an underscore and without its ending."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"[.][^.]*$", "")
    return F.regexp_replace(base, r"_[^_]*$", "")


def subject_name(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "_", 1)


def without_sub_image(name: Column) -> Column:
    return F.regexp_replace(name, r"_?sub[0-9]+$", "")


def uniform_code(code: Column, n: int = 8) -> Column:
    """riu2: codes with at most two changes around the circle become their number of ones, all others n + 1."""
    turned = F.shiftright(code, 1).bitwiseOR(F.shiftleft(code.bitwiseAND(1), n - 1))
    ones = F.bit_count(code)
    return F.when(F.bit_count(code.bitwiseXOR(turned)) <= 2, ones).otherwise(n + 1)


def lcg(seed: Column, steps: int = 3) -> Column:
    """A repeatable draw below 2**31 - 1 from whole numbers; plain modular arithmetic, so that SQL can say the same."""
    x = F.pmod(seed.cast("long"), F.lit(2147483647))
    for _ in range(steps):
        x = F.pmod(x * 48271 + 11, F.lit(2147483647))
    return x
