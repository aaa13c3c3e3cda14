"""Vector expressions from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double; null for a null or zero vector, or unlike lengths (zip_with would pad)."""
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))))


def similarity(distance: Column) -> Column:
    return 1 - distance


def l2_normalize(v: Column) -> Column:
    """A vector of length 1 as floats; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)).cast("float"))


def check_dim(v: Column, dim: int) -> Column:
    """v itself; a vector of another length fails the job."""
    return F.when(F.assert_true(v.isNull() | (F.size(v) == dim), F.lit(f"vector length is not {dim}")).isNull(), v)
