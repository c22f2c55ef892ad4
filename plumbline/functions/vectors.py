"""Vector arithmetic on ARRAY<DOUBLE> columns, and the deterministic hash embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, text_or_empty


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    return let(
        norm(a) * norm(b),
        lambda scale: F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale),
    )


def clamp01(c: Column) -> Column:
    """``c`` within [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def unit(v: Column) -> Column:
    return let(
        v,
        lambda x: let(
            norm(x),
            lambda n: F.when(n == 0.0, x).otherwise(F.transform(x, lambda e: e / n)),
        ),
    )


def hash_embedding(text: Column, dims: int = 32) -> Column:
    """Component i is read from the first two bytes of sha256("i:text"), scaled
    to [-1, 1]; the vector then gets unit length."""

    def raw(t: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.conv(
                F.substring(F.sha2(F.concat(i.cast("string"), F.lit(":"), t), 256), 1, 4), 16, 10
            ).cast("double")
            / 65535.0
            * 2.0
            - 1.0,
        )

    return unit(let(text_or_empty(text), raw))
