"""Vector functions on array columns; sums are in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _checked(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / size))


def euclidean(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of byte values."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("int"))


def sign_bytes(v: Column, size: int) -> Column:
    """A bit for each positive value, eight to a byte, the first bit highest."""
    return F.array(*[sum((F.when(v[8 * k + j] > 0, 1 << (7 - j)).otherwise(0) for j in range(8)), F.lit(0)) for k in range(size // 8)])


def truncate(v: Column, size: int) -> Column:
    """The first dimensions, normalised again; a shorter vector is an error."""
    return F.when(F.size(v) >= size, unit(F.slice(v, 1, size))).otherwise(F.raise_error(F.lit(f"a vector has fewer than {size} dimensions")).cast("array<double>"))


@F.pandas_udf(T.BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))
