"""Vector functions as columns, and the deterministic embedding that stands in for a model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column, space: str = "l2") -> Column:
    """Cosine, inner-product or squared Euclidean distance; an unknown space is taken as l2. Vectors of different length give null."""
    if space == "cosine":
        return 1 - dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))
    if space == "ip":
        return 1 - dot(a, b)
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def vocabulary_embedding(text: Column, vocabulary: Iterable[str], weight: float = 3.0, floor: float = 0.01) -> Column:
    """Counts of fixed words as a vector: an embedding that needs no model."""
    return F.array(*(F.lit(floor) + weight * F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)) for w in vocabulary))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Words hashed into a vector of ``dims`` counts."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counts = F.aggregate(slots, F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<double>")), lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != s), F.create_map(s, F.coalesce(F.element_at(m, s), F.lit(0.0)) + 1.0)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at(counts, i.cast("bigint")), F.lit(0.0)))


def stored_dimensions(v: Column) -> Column:
    return F.when(v.isNotNull(), F.size(v))
