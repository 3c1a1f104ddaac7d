"""Vector expressions: products accumulate in double precision on the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import tenths


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine within -1 and 1; 0 for missing, empty or unequally long vectors or a vanishing norm."""
    width = lambda x: F.coalesce(F.size(x), F.lit(-1))
    scale = norm(a) * norm(b)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), scale)))
    return F.when((width(a) != width(b)) | (width(a) <= 0) | (scale <= 1e-12), 0.0).otherwise(value)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def semantic_score(cosine: Column) -> Column:
    """0 to 100: half of the scale below a cosine of 0, a rising curve above, 50 for NaN."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    score = F.when(c >= 0, F.pow(F.least(c / 0.65, F.lit(1.0)), F.lit(0.8)) * 50.0 + 50.0).otherwise((c + 1.0) / 2.0 * 50.0)
    return F.when(F.isnan(cosine), 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), tenths(score))))


def semantic_score_of_texts(text: Column, other: Column, cosine: Column) -> Column:
    blank = lambda t: t.isNull() | ~F.regexp_like(t, F.lit(r"(?U)\S"))
    return F.when(blank(text) | blank(other), 50.0).otherwise(semantic_score(cosine))


def normalize_l2(a: Column) -> Column:
    """Unit length, as floats; a vanishing vector is unchanged."""
    length = norm(a)
    return F.when(length <= 1e-12, a.cast("array<float>")).otherwise(F.transform(a, lambda x: F.try_divide(x.cast("double"), length).cast("float")))


def mean_pooled(chunks: Column, width: int) -> Column:
    """Element-wise mean of an array of vectors, at unit length."""
    total = F.aggregate(chunks, F.array_repeat(F.lit(0.0), width), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return normalize_l2(F.transform(total, lambda x: F.try_divide(x, F.size(chunks).cast("double"))))


@F.pandas_udf(T.BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats, for export."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(b: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        if len(x) % 4:
            raise ValueError("a vector's bytes must be a multiple of 4")
        return np.frombuffer(x, "<f4")

    return b.map(one)
