"""Scalar functions as column expressions; all stay in the JVM except the bit view of a float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Mersenne prime: products of two values below it fit a signed 64-bit number, in Spark and in SQL engines alike.
PRIME = 2147483647


def float_add(a, b) -> Column:
    return F.col(a).cast("float") + F.col(b).cast("float")


def float_multiply(a, b) -> Column:
    """Single precision; an operand too small to be normal counts as zero."""
    flush = lambda c: F.when(F.abs(F.col(c).cast("float")) < F.lit(1.17549435e-38).cast("float"), F.lit(0.0).cast("float")).otherwise(F.col(c).cast("float"))
    return flush(a) * flush(b)


def float_divide(a, n) -> Column:
    """A float by an integer; null for zero."""
    return F.col(a).cast("double") / F.nullif(F.col(n).cast("double"), F.lit(0.0))


def divide_with_remainder(a, b) -> tuple[Column, Column]:
    """(quotient, remainder) of non-negative integers, both null for a zero divisor."""
    divisor = F.nullif(F.col(b).cast("long"), F.lit(0).cast("long"))
    remainder = F.col(a).cast("long") % divisor
    return ((F.col(a).cast("long") - remainder) / divisor).cast("long"), remainder


def float_bits():
    """pandas UDF: the bits of a single-precision float as an unsigned number."""
    import numpy as np
    import pandas as pd

    def bits(x):
        return pd.Series(x.to_numpy(dtype="float32").view(np.uint32).astype("int64"))

    bits.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(bits, "long")


def ones(n) -> Column:
    """n low bits set, n below 63."""
    return F.expr(f"shiftleft(CAST(1 AS BIGINT), {n}) - 1")


def popcount(c) -> Column:
    return F.bit_count(F.col(c))


def bit_vector(c) -> Column:
    """A number with the bits of an array of booleans, first element lowest."""
    return F.aggregate(F.reverse(F.col(c)), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long"))


def pack(fields: list[tuple[str, int]]) -> Column:
    """One number from (column, width) fields, first field lowest."""
    out, at = F.lit(0).cast("long"), 0
    for name, width in fields:
        out = out.bitwiseOR(F.shiftleft(F.col(name).cast("long").bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


def unpack(c: str, fields: list[tuple[str, int]]) -> list[Column]:
    out, at = [], 0
    for name, width in fields:
        out.append(F.shiftright(F.col(c), at).bitwiseAND(F.lit((1 << width) - 1)).alias(name))
        at += width
    return out


def bit_width(c: Column) -> Column:
    """Bits that tell n values apart: ceil(log2(n)), 0 for n below 2. Exact: counts the bits of n - 1."""
    return F.when(c < 2, 0).otherwise(F.length(F.bin(c - 1)))


def bit_reverse(c: Column, width: int) -> Column:
    """The low bits of a number in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(c), width, "0")), 2, 10).cast("long")


def tokens(line: Column) -> Column:
    """(first, second) words of a line that has the form of an edge; null otherwise."""
    first, second = (F.regexp_extract(line, r"(\w+)\s(\w+)", k) for k in (1, 2))
    return F.when(first != "", F.struct(first.alias("first"), second.alias("second")))


def _mixed(x: Column) -> Column:
    return ((x * x) % PRIME + (x * F.lit(48271)) % PRIME + F.lit(11)) % PRIME


def draw(seed: int, row: Column, number: Column | int = 0) -> Column:
    """A pseudo-random number in [0, PRIME), a function of (seed, row, number) only: the same on any partitioning."""
    number = F.lit(number) if isinstance(number, int) else number
    x = ((row.cast("long") % PRIME) * F.lit(16807) + number.cast("long") * F.lit(69621) + F.lit(seed * 40692 + 12345)) % PRIME
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), x, lambda acc, _: _mixed(acc))  # a fold keeps the expression small


def uniform(seed: int, row: Column, number: Column | int = 0) -> Column:
    """draw() as a double in [0, 1)."""
    return draw(seed, row, number).cast("double") / F.lit(float(PRIME))


def draw_sql(seed: int, row: str, number: str = "0") -> str:
    """draw() as SQL text, for engines that hold results against each other."""
    x = f"(((CAST({row} AS BIGINT) % {PRIME}) * 16807 + CAST({number} AS BIGINT) * 69621 + {seed * 40692 + 12345}) % {PRIME})"
    for _ in range(4):
        x = f"list_transform([{x}], lambda x: ((x * x) % {PRIME} + (x * 48271) % {PRIME} + 11) % {PRIME})[1]"
    return x
