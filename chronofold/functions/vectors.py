"""Vectors as ARRAY<DOUBLE> columns. All expressions stay in the JVM; FLOAT arrays are widened first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column, eps: float = 1e-12) -> Column:
    """v divided by its length, or by eps if that is larger."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(eps)))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def project_in_time(e: Column, w: Column, gap: Column) -> Column:
    """Linear time projection: e * (1 + w * gap), the gap as it is."""
    return F.zip_with(e, w, lambda x, y: x * (1.0 + y * gap))


def align(features: Column, size: int) -> Column:
    """The first size features, padded with zeros."""
    return F.slice(F.concat(features, F.array_repeat(F.lit(0.0), size)), 1, size)


def linear(v: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """A linear layer: a row of weights for each output."""
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    out = F.transform(rows, lambda row: dot(row, v))
    return out if bias is None else F.zip_with(out, F.array(*[F.lit(float(b)) for b in bias]), lambda x, b: x + b)


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def mlp(v: Column, first: list[list[float]], first_bias: list[float], second: list[list[float]], second_bias: list[float]) -> Column:
    """Two linear layers with a ReLU between them."""
    return linear(relu(linear(v, first, first_bias)), second, second_bias)


def attention_network(center: Column, neighbour: Column, hidden: list[list[float]], bias: list[float], out: list[float], out_bias: float) -> Column:
    """The score of a neighbour by a network over both vectors and their absolute difference."""
    apart = F.zip_with(center, neighbour, lambda x, y: F.abs(x - y))
    return F.get(mlp(F.concat(center, neighbour, apart), hidden, bias, [out], [out_bias]), 0)


def project_in_time_mlp(e: Column, gap: Column, first: list[list[float]], first_bias: list[float], second: list[list[float]], second_bias: list[float]) -> Column:
    """Time projection by a network of the gap: e * (1 + mlp(gap)), the gap as it is."""
    return F.zip_with(e, mlp(F.array(gap), first, first_bias, second, second_bias), lambda x, y: x * (1.0 + y))
