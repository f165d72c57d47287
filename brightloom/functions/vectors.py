"""Vector expressions over ARRAY<FLOAT>; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightloom.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def is_zero(a: Column, tolerance: float = 1e-8) -> Column:
    return ~F.exists(a, lambda x: F.abs(x) > tolerance)


def unit(a: Column) -> Column:
    """The vector divided by its length; a vector shorter than 1e-10 stays as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n < 1e-10, 1.0).otherwise(n)))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is zero."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-20, 0.0).otherwise(dot(a, b) / n)


def euclidean_similarity(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return 1 / (1 + F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A unit vector of word counts in hashed places, for texts without a model's embedding; null for null.

    Each word adds to one place, with a sign of its own. A text without words has the zero vector.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{IsHan}]|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))
    places = F.transform(
        words,
        lambda w: let(F.xxhash64(w), lambda h: F.struct(F.pmod(h, F.lit(dims)).alias("p"), F.when(h < 0, -1.0).otherwise(1.0).alias("s"))),
    )

    def counts(pairs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.aggregate(F.filter(pairs, lambda x: x["p"] == i), F.lit(0.0), lambda acc, x: acc + x["s"]),
        )

    return F.when(text.isNotNull(), let(let(places, counts), unit))
