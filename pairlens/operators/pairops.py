"""Operators that make a pair's features of two drug vectors, as JVM-side array expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def absdiff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def hadamard_absdiff(a: Column, b: Column) -> Column:
    return F.concat(hadamard(a, b), absdiff(a, b))


def concat_sym(a: Column, b: Column) -> Column:
    mean = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return F.concat(mean, mean)


def vector_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


#: Name to (builder, width as a multiple of the vectors'); all but concat are symmetric.
OPERATORS: dict[str, tuple[Callable[[Column, Column], Column], int]] = {
    "hadamard": (hadamard, 1),
    "absdiff": (absdiff, 1),
    "hadamard_absdiff": (hadamard_absdiff, 2),
    "concat_sym": (concat_sym, 2),
    "sum": (vector_sum, 1),
    "concat": (concat, 2),
}


def hadamard_absdiff_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``hadamard_absdiff`` of the rows of two matrices."""
    return np.concatenate([a * b, np.abs(a - b)], axis=1)


def output_dim(name: str, dim: int) -> int:
    """Width of a pair's features; an unknown operator raises ValueError."""
    return _operator(name)[1] * dim


def _operator(name: str) -> tuple[Callable[[Column, Column], Column], int]:
    if name not in OPERATORS:
        raise ValueError(f"unknown pair operator {name!r}; choose from {sorted(OPERATORS)}")
    return OPERATORS[name]


def with_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs with ``a`` and ``b``, the vectors of their drugs; pairs that lack one are left out.

    Where vectors have a ``method``, a pair comes once for each method that has both.
    """
    by = [c for c in vectors.columns if c == "method"]
    a = vectors.select(*by, F.col("drug").alias("drug_1"), F.col("vector").alias("a"))
    b = vectors.select(*by, F.col("drug").alias("drug_2"), F.col("vector").alias("b"))
    return pairs.join(a, "drug_1").join(b, ["drug_2", *by])


def pair_features(pairs: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """The pairs with ``features`` by the named operator."""
    build = _operator(name)[0]
    return with_vectors(pairs, vectors).withColumn("features", build(F.col("a"), F.col("b"))).drop("a", "b")


def dot(*vectors: Column) -> Column:
    """Sum of the elementwise product of two or three vectors."""
    product = vectors[0]
    for v in vectors[1:]:
        product = hadamard(product, v)
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def simple_score(h1: Column, r1: Column, t2: Column, h2: Column, r2: Column, t1: Column) -> Column:
    """Half the sum of both directions; first and second tables of entities and relations."""
    return (dot(h1, r1, t2) + dot(h2, r2, t1)) / 2


def trivec_score(h: tuple[Column, ...], r: tuple[Column, ...], t: tuple[Column, ...]) -> Column:
    """h1 r1 t3 + h2 r2 t2 + h3 r3 t1, with three tables each."""
    return dot(h[0], r[0], t[2]) + dot(h[1], r[1], t[1]) + dot(h[2], r[2], t[0])


def basis_matrix(weights: Column, bases: Column) -> Column:
    """A relation's matrix: the sum of basis matrices (array of arrays of rows) by its weights."""
    scaled = F.zip_with(weights, bases, lambda a, m: F.transform(m, lambda row: F.transform(row, lambda x: a * x)))
    add = lambda m, n: F.zip_with(m, n, lambda p, q: F.zip_with(p, q, lambda x, y: x + y))
    return F.aggregate(F.slice(scaled, 2, F.size(scaled) - 1), F.get(scaled, F.lit(0)), add)


def bilinear_score(a: Column, matrix: Column, b: Column) -> Column:
    """a' M b for a full matrix, as an array of rows."""
    return dot(a, F.transform(matrix, lambda row: dot(row, b)))


FEATURE_MODES = ("target_only", "fp_only", "target+fp", "all")


def feature_store(vectors: DataFrame, blocks: dict[str, str], width: int) -> DataFrame:
    """One row per drug with a column for each block; zeros where the drug lacks a vector of the block's method.

    ``blocks`` maps a block to its method; a drug has at most one vector of a method.
    """
    zeros = F.array_repeat(F.lit(0.0), width)
    found = vectors.groupBy("drug").agg(*(F.max(F.when(F.col("method") == m, F.col("vector"))).alias(b) for b, m in blocks.items()))
    return found.select("drug", *(F.coalesce(b, zeros).alias(b) for b in blocks))


def feature_mode(profile: Column | str, embedding: Column | str, fingerprint: Column | str, mode: str) -> Column:
    """A drug's features for a mode; null blocks must have been replaced by zeros before."""
    if mode not in FEATURE_MODES:
        raise ValueError(f"unknown feature mode {mode!r}; choose from {FEATURE_MODES}")
    profile, embedding, fingerprint = (F.col(c) if isinstance(c, str) else c for c in (profile, embedding, fingerprint))
    return {"target_only": embedding, "fp_only": fingerprint, "target+fp": F.concat(embedding, fingerprint), "all": F.concat(profile, embedding, fingerprint)}[mode]
