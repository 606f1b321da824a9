"""Vector math as column expressions: dot, distance, normalisation, arithmetic, padding.

Arithmetic is in double precision whatever the storage. Null vectors give null. ``distance`` does not normalise its
inputs: on unit vectors it is (1 - cosine) / 2, on others the clamped value of the same formula.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANTS = ("default", "simd", "scalar")


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products from left to right; null if the lengths differ."""
    total = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def clamp01(x: Column) -> Column:
    """x within [0, 1], -0.0 as 0.0; NaN passes through."""
    return F.when(x <= 0, F.lit(0.0)).when((x >= 1) & ~F.isnan(x), F.lit(1.0)).otherwise(x)


def distance_of_dot(d: Column) -> Column:
    return clamp01((d - 1) / F.lit(-2.0))


def _block(v: pa.Array) -> np.ndarray | None:
    """Lists of one common length without nulls as a matrix in double precision; None where they are not such."""
    sizes = pc.unique(pc.list_value_length(v))
    if len(sizes) != 1 or sizes[0].as_py() is None or v.flatten().null_count:
        return None
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), sizes[0].as_py())


def _row(v) -> np.ndarray | None:
    x = v.as_py()
    return None if x is None or None in x else np.array(x, np.float64)


@F.arrow_udf(T.DoubleType())
def _block_dot(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = _block(a), _block(b)
    if x is not None and y is not None and x.shape == y.shape:
        return pa.array(np.einsum("ij,ij->i", x, y))
    pairs = [(_row(p), _row(q)) for p, q in zip(a, b)]
    return pa.array([float(p @ q) if p is not None and q is not None and len(p) == len(q) else None for p, q in pairs], pa.float64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _block_normalize(v: pa.Array) -> pa.Array:
    x = _block(v)
    with np.errstate(divide="ignore", invalid="ignore"):
        if x is not None:
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
        rows = [_row(p) for p in v]
        return pa.array([None if p is None else p / np.sqrt(p @ p) for p in rows], pa.list_(pa.float64()))


def _named(variant: str) -> str:
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    return "scalar" if variant == "default" else variant


def distance(a: Column, b: Column, variant: str = "default") -> Column:
    """The reference distance of the raw vectors: ``scalar`` (the default) adds up component by component in the JVM,
    ``simd`` takes Arrow blocks of rows as matrices. They agree but for the order of addition."""
    return distance_of_dot(_block_dot(a, b) if _named(variant) == "simd" else dot(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column, variant: str = "default") -> Column:
    """v scaled to length 1; the zero vector gives NaN components, as 0/0 does. Variants as for ``distance``."""
    if _named(variant) == "simd":
        return _block_normalize(v)
    n = norm(v)
    return F.when(n == 0, F.transform(as_double(v), lambda x: F.lit(float("nan")))).otherwise(F.transform(as_double(v), lambda x: F.try_divide(x, n)))


def cosine_distance(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2: normalises its inputs; null where one has no length."""
    n = norm(a) * norm(b)
    return distance_of_dot(F.try_divide(dot(a, b), n))


def analogy(a: Column, b: Column, c: Column) -> Column:
    """a - b + c, componentwise, not normalised again."""
    return F.zip_with(F.zip_with(as_double(a), as_double(b), lambda x, y: x - y), as_double(c), lambda x, y: x + y)


def same_vector(a: Column, b: Column) -> Column:
    return a == b


def pad_trim(v: Column, dim: int) -> Column:
    """Exactly ``dim`` components: cut at the end or filled up with zeros."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def empty_embedding(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def random_embedding(dim: int, seed: int = 42) -> Column:
    """Uniform components in [0, 1), the same for a seed, partitioning and row."""
    return F.array(*(F.rand(seed + k).cast("float") for k in range(dim)))


def random_normalized_embedding(dim: int, seed: int = 42) -> Column:
    # the lambda's variable stands for one draw; the expression itself would draw anew wherever it is used
    one = F.transform(F.array(random_embedding(dim, seed)), lambda v: normalize(v))
    return F.element_at(one, 1).cast("array<float>")


def euclidean_radius(threshold: float) -> float:
    """The Euclidean distance of unit vectors at a distance: 2 * sqrt(threshold)."""
    return 2 * threshold**0.5
