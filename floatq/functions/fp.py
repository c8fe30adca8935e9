"""Floating-point rules, in one place, as column expressions.

Spark orders NaN above all numbers and equals it to itself, and its empty aggregates are null. Here
comparisons follow IEEE 754, minimum and maximum skip NaN, and empty input gives 0, +inf and -inf.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def eq(v: Column, x: float) -> Column:
    """NaN equals nothing."""
    return F.lit(False) & v.isNotNull() if math.isnan(x) else ~F.isnan(v) & (v == F.lit(float(x)))


def ne(v: Column, x: float) -> Column:
    """NaN differs from everything."""
    return v.isNotNull() if math.isnan(x) else F.isnan(v) | (v != F.lit(float(x)))


def bound(v: Column, x: float, op: str) -> Column:
    """v op x for op in > >= < <=; false if either is NaN."""
    if math.isnan(x):
        return F.lit(False) & v.isNotNull()
    c = F.lit(float(x))
    return ~F.isnan(v) & {">": v > c, ">=": v >= c, "<": v < c, "<=": v <= c}[op]


def sum_(v: Column) -> Column:
    return F.coalesce(F.sum(v), F.lit(0.0))


def min_(v: Column) -> Column:
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.lit(INF))


def max_(v: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(-INF))


def negative(v: Column) -> Column:
    """The sign bit of a number, that of -0.0 included."""
    return F.when(v == 0, F.startswith(v.cast("string"), F.lit("-"))).otherwise(v < 0)


def div(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is x times an infinity of the zero's sign, so 0/0 is the NaN that the machine makes and NaN/0 is NaN."""
    return F.when(b != 0, a / b).when(b == 0, a * F.when(negative(b), F.lit(-INF)).otherwise(F.lit(INF)))


def round_scale(v: Column, scale: float) -> Column:
    """round(v * scale) / scale, halves away from zero on the scaled double; what rounds to zero keeps its sign."""
    x = F.round(v * F.lit(float(scale)), 0)
    return F.when((x == 0) & negative(v), F.lit(-0.0)).otherwise(x / F.lit(float(scale)))


def bits(v: Column) -> Column:
    """The 64 bits of a double as a long; tells -0.0 from 0.0 and NaNs from one another."""
    return F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), v).cast("long")


def from_bits(b: Column) -> Column:
    """The double of 64 bits, viewed without a copy in Arrow batches."""

    @F.pandas_udf("double")
    def view(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy("int64").view("float64"))

    return view(b)


def exponent(b: Column) -> Column:
    """Unbiased IEEE exponent of the bits of a double."""
    return F.shiftright(b, 52).bitwiseAND(F.lit(2047)) - 1023


def leading_zeros(x: Column) -> Column:
    """Leading zero bits of a long; 64 for 0."""
    return F.when(x == 0, 64).otherwise(64 - F.length(F.bin(x)))


def trailing_zeros(x: Column) -> Column:
    """Trailing zero bits of a long; 64 for 0."""
    return F.when(x == 0, 64).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.bin(x), F.lit("0"))))


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1)))


def bit_length(x: Column) -> Column:
    """Bits up to the highest that is set; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def decimal_digits(s: Column) -> Column:
    """Digits after the point of a numeric string, its exponent (after e) counted in; 0 at least."""
    mantissa, exp = F.split_part(s, F.lit("e"), F.lit(1)), F.split_part(s, F.lit("e"), F.lit(2))
    digits = F.when(F.instr(mantissa, ".") > 0, F.length(mantissa) - F.instr(mantissa, ".")).otherwise(0)
    return F.greatest(F.lit(0), digits - F.when(exp == "", F.lit("0")).otherwise(exp).cast("int"))
