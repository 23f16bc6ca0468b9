"""Vector expressions on ARRAY<FLOAT> columns, summed in double."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.sqrt(s))


def l2_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), lambda s: F.sqrt(s))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, always divided by both norms; null for a zero vector."""
    return F.try_divide(inner_product(a, b), F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0)))


def l2_normalize(a: Column) -> Column:
    """Unit vector in double, null for a zero vector. The norm is computed once per row."""
    return F.aggregate(
        a,
        F.lit(0.0),
        lambda s, x: s + x.cast("double") * x.cast("double"),
        lambda s: F.when(s > 0, F.transform(a, lambda x: x.cast("double") / F.sqrt(s))),
    )


def vector_to_text(a: Column) -> Column:
    numbers = F.transform(a, lambda x: x.cast("double").cast("string"))
    return F.concat(F.lit("["), F.array_join(numbers, ","), F.lit("]"))


def vector_from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")
