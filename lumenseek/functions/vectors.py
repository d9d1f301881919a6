"""Vector arithmetic on array<float> columns. Sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda total, x: total + x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v.cast("array<float>"))


def is_finite(x: Column) -> Column:
    x = x.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def checked(v: Column, dim: int) -> Column:
    """The vector itself; a query that meets another length fails."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected a vector of {dim}, got "), F.size(v).cast("string"))).cast("array<float>"))


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)).cast("float") for x in values))
