"""Vector expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors given as arrays; 0 when one of them has no direction."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
