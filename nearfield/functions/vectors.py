"""Scalar functions over vectors as Spark expressions; sums run in double, first component to last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def mips_score(a: Column, b: Column) -> Column:
    """Smaller is better; never -0.0."""
    return F.lit(0.0) - inner_product(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def normalized(a: Column) -> Column:
    return F.transform(F.array(F.greatest(norm(a), F.lit(1e-12))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def quantized(a: Column, code_bytes: int) -> Column:
    """The first ``code_bytes`` components in [-1, 1] as whole numbers 0..255; a missing one counts as 0."""
    def code(i: Column) -> Column:
        x = F.coalesce(F.get(a, i).cast("double"), F.lit(0.0))
        return F.least(F.greatest(F.round((x * 0.5 + 0.5) * 255.0), F.lit(0.0)), F.lit(255.0)).cast("smallint")

    return F.transform(F.sequence(F.lit(0), F.lit(code_bytes - 1)), code)


def code_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def from_half(bits: Column) -> Column:
    """The value of 16 bits of half precision, given as a whole number; subnormals count as a signed zero, as NaN and infinity stay."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(0x1F), bits.bitwiseAND(0x3FF)
    normal = sign * F.pow(F.lit(2.0), exponent - 15) * (F.lit(1.0) + fraction / 1024.0)
    return F.when(exponent == 0, sign * 0.0).when((exponent == 31) & (fraction != 0), F.lit(float("nan"))).when(exponent == 31, sign * float("inf")).otherwise(normal)
