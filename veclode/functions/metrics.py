"""Similarities of vectors, as Spark columns and as numpy products. Larger is always better."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE_EPS, NORM_EPS = 1e-8, 1e-9
ALIASES = {"l2": "euclidean", "dot": "inner", "angular": "cosine", "l1": "manhattan"}


def canonical(metric: str) -> str:
    name = ALIASES.get(metric, metric)
    if name not in ("euclidean", "inner", "cosine", "manhattan"):
        raise ValueError(f"no such metric: {metric}")
    return name


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column, eps: float = NORM_EPS) -> Column:
    """a / (|a| + eps)"""
    # the norm is an element of an array, so that it is computed once a vector and not once an element
    return F.get(F.transform(F.array(norm(a) + F.lit(eps)), lambda n: F.transform(a, lambda x: x / n)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalize(a, COSINE_EPS), normalize(b, COSINE_EPS))


def similarity(metric: str, a: Column, b: Column) -> Column:
    name = canonical(metric)
    if name == "euclidean":
        return F.lit(0.0) - squared_l2(a, b)
    if name == "manhattan":
        return F.lit(0.0) - l1(a, b)
    return dot(a, b) if name == "inner" else cosine(a, b)


#: The element functions of a product, by name, each summed over the elements.
ELEMENT = {
    "madd": dot,
    "nmadd": lambda a, b: F.lit(0.0) - dot(a, b),
    "squared_l2": squared_l2,
    "negative_squared_l2": lambda a, b: F.lit(0.0) - squared_l2(a, b),
    "l1": l1,
    "negative_l1": lambda a, b: F.lit(0.0) - l1(a, b),
}


def residual(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def subvector(v: Column, sub: Column, width: int) -> Column:
    return F.slice(v, sub * width + 1, width)


def half(v: Column, scale: bool = False) -> Column:
    """Elements divided by the largest magnitude and rounded to 11 significant bits, as half precision keeps them, then
    multiplied back (with scale); without it, only rounded. Normal half-precision numbers only; underflow is to zero."""
    top = F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(1e-30)) if scale else F.lit(1.0)

    def rounded(x: Column) -> Column:
        y = x / top
        unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(y))), F.lit(-14)) - 10)
        return F.when(y == 0, F.lit(0.0)).otherwise(F.rint(y / unit) * unit * top)

    return F.transform(v, rounded)


def unit_rows(x: np.ndarray, eps: float) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(-1, keepdims=True)) + eps)


def matrix(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of each row of q and each row of b, in double precision."""
    name = canonical(metric)
    if name == "cosine":
        q, b = unit_rows(q, COSINE_EPS), unit_rows(b, COSINE_EPS)
    if name == "manhattan":
        return -np.abs(q[:, None, :] - b[None, :, :]).sum(-1)
    s = q @ b.T
    return s if name != "euclidean" else 2 * s - (q * q).sum(1)[:, None] - (b * b).sum(1)[None]


def each_pair(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of each row of q and each row of b as sums over the elements, in slices that stay in a core's cache."""
    name = canonical(metric)
    if name == "cosine":
        q, b = unit_rows(q, COSINE_EPS), unit_rows(b, COSINE_EPS)
    out, bt = np.zeros((len(q), len(b))), np.ascontiguousarray(b.T)
    wide = 2048
    for j in range(0, len(b), wide):
        part = bt[:, j : j + wide]
        for i in range(0, len(q), 8):
            own, s = q[i : i + 8], out[i : i + 8, j : j + wide]
            total, x = np.zeros(s.shape), np.empty(s.shape)
            for d in range(q.shape[1]):
                if name in ("euclidean", "manhattan"):
                    np.subtract(own[:, d, None], part[d], out=x)
                    np.abs(x, out=x) if name == "manhattan" else np.multiply(x, x, out=x)
                else:
                    np.multiply(own[:, d, None], part[d], out=x)
                total += x
            s[:] = -total if name in ("euclidean", "manhattan") else total
    return out


def half_matrix(metric: str, q: np.ndarray, b: np.ndarray, mode: str = "none") -> np.ndarray:
    """Similarities as matrix, of elements kept in half precision: mode "a" divides the queries by their largest magnitude
    before and multiplies after, "b" the base vectors, "both" either, "none" neither (beyond 65504 is infinite then)."""
    if mode not in ("a", "b", "both", "none"):
        raise ValueError("mode: a, b, both or none")

    def kept(x: np.ndarray, scaled: bool) -> np.ndarray:
        top = max(float(np.abs(x).max(initial=0)), 1e-30) if scaled else 1.0
        with np.errstate(over="ignore"):
            return (x / top).astype(np.float16).astype(np.float64) * top

    return matrix(metric, kept(q, mode in ("a", "both")), kept(b, mode in ("b", "both")))


def direct(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of rows of q with the rows of b at the same place, without cancellation."""
    name = canonical(metric)
    if name == "cosine":
        q, b = unit_rows(q, COSINE_EPS), unit_rows(b, COSINE_EPS)
    if name == "euclidean":
        return -((q - b) ** 2).sum(-1)
    return -np.abs(q - b).sum(-1) if name == "manhattan" else (q * b).sum(-1)
