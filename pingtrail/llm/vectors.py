"""Integer vectors and exact products of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest size of an integer component.
LARGEST = 2 ** 31 - 1


def integer_vectors(rows: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``label`` and ``v`` (components as ``floor(scale * x)``) of the
    rows whose vector is not NULL and has only finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.where(F.col(vector).isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), parts.alias("v"))


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column as int64 rows of ``dim`` components, shorter ones ended with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) and (flat.max() > LARGEST or flat.min() < -LARGEST):
        raise ValueError(f"a component is beyond {LARGEST}")
    if len(ends) * dim == len(flat) and (ends == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(ends), dim), "i8")
    out[np.arange(dim) < ends[:, None]] = flat
    return out


def _limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 digits of integers in base 2**bits, lowest first; the last is signed."""
    out = []
    while True:
        if not a.size or (-(1 << bits) < a.min() and a.max() < 1 << bits):
            return [*out, a.astype("f8")]
        out.append((a & ((1 << bits) - 1)).astype("f8"))
        a = a >> bits


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exactly: split into limbs so small that
    float64 products of them stay below 2**53, recombined in int64."""
    dim = max(a.shape[1], 1)
    largest = lambda m: int(np.abs(m).max()) if m.size else 0
    if dim * largest(a) * largest(b) >= 2 ** 63:
        raise ValueError("products do not fit 64 bits")
    bits = (53 - dim.bit_length()) // 2
    out = np.zeros((len(a), len(b)), "i8")
    right = _limbs(b, bits)
    for i, x in enumerate(_limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype("i8") << (bits * (i + j))
    return out
