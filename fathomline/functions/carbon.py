"""Carbon intensity: reference, required, attained and grade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reduction per year in percent.
REDUCTION = {2023: 5.0, 2024: 7.0, 2025: 9.0, 2026: 11.0, 2027: 13.625, 2028: 16.25, 2029: 18.875, 2030: 21.5}
#: Upper bounds of the grades A to D as shares of the required value.
BOUNDS = {"A": 0.86, "B": 0.94, "C": 1.06, "D": 1.18}


def reference(dwt: Column) -> Column:
    return F.lit(4745.0) * F.pow(dwt, F.lit(-0.622))


def reduction(year: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for y, z in REDUCTION.items():
        out = out.when(year == y, F.lit(z))
    return out


def required(dwt: Column, year: Column) -> Column:
    return reference(dwt) * (100.0 - reduction(year)) / 100.0


def attained(co2_t: Column, dwt: Column, miles: Column) -> Column:
    return F.try_divide(co2_t * 1e6, dwt * miles)


def grade(value: Column, req: Column) -> Column:
    """Ties go to the better grade."""
    out = F.when(value.isNull() | req.isNull(), F.lit(None).cast("string"))
    for name, share in BOUNDS.items():
        out = out.when(value <= req * share, name)
    return out.otherwise("E")


def status(year: Column, dwt: Column, co2: Column, miles: Column) -> Column:
    """Why no grade can be given, in a fixed order, or ``ok``."""
    return (
        F.when(year.isNull() | reduction(year).isNull(), "year")
        .when(dwt.isNull() | (dwt <= 0), "dwt")
        .when(co2.isNull() | (co2 < 0), "co2")
        .when(miles.isNull() | (miles <= 0), "distance")
        .otherwise("ok")
    )
