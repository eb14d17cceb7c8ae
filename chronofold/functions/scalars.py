"""Scalar expressions: decays, losses, switches, ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("on", "true", "1", "yes")


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def time_decay(gap: Column, kind: str) -> Column:
    """none: 1; exp: exp(-gap); inverse: 1 / (1 + gap); negative gaps count as 0."""
    if kind == "exp":
        return F.exp(-positive(gap))
    if kind == "inverse":
        return 1.0 / (1.0 + positive(gap))
    if kind == "none":
        return F.lit(1.0)
    raise ValueError(f"unknown decay {kind!r}")


def log_gap(gap: Column) -> Column:
    return F.log1p(positive(gap))


def activation(x: Column, kind: str) -> Column:
    """none, relu, tanh or gelu."""
    if kind == "relu":
        return positive(x)
    if kind == "tanh":
        return F.tanh(x)
    if kind == "gelu":
        return 0.5 * x * (1.0 + erf(x / 2.0**0.5))
    if kind == "none":
        return x
    raise ValueError(f"unknown activation {kind!r}")


#: Intervals of the integral of the error function, and where it is 1 to more than twelve digits.
_ERF_STEPS, _ERF_END = 128, 8.5 / 2.0**0.5


def erf(x: Column) -> Column:
    """The error function by Simpson's rule over exp(-t * t), to about 1e-7: Spark has no expression for it."""
    end = F.least(F.abs(x), F.lit(_ERF_END))
    weight = lambda i: F.when((i == 0) | (i == _ERF_STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    parts = F.transform(F.sequence(F.lit(0), F.lit(_ERF_STEPS)), lambda i: weight(i) * F.exp(-F.pow(i / _ERF_STEPS * end, F.lit(2.0))))
    area = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) * end / (3.0 * _ERF_STEPS)
    return F.signum(x) * F.least(area * (2.0 / math.pi**0.5), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def bpr_loss(positive_score: Column, negative_score: Column) -> Column:
    """-log sigmoid(positive - negative)."""
    return F.log1p(F.exp(negative_score - positive_score))


def switched_on(x: Column, default: bool) -> Column:
    """on/true/1/yes in any case; null gives the default."""
    return F.when(x.isNull(), F.lit(default)).otherwise(F.lower(F.trim(x.cast("string"))).isin(*TRUE_WORDS))


def choose(x: Column, choices: list[str], default: str) -> Column:
    return F.when(x.isin(*choices), x).otherwise(F.lit(default))


def finite(text: Column) -> Column:
    """The number a text says, null if it is none or not finite."""
    x = text.try_cast("double")
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(x)


def whole(text: Column) -> Column:
    """The number a text says, cut towards zero."""
    return finite(text).try_cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def percent_delta(new: Column, old: Column) -> Column:
    return ratio((new - old) * 100.0, old)


def per_hour(n: Column, seconds: Column) -> Column:
    return ratio(n * 3600.0, seconds)


def visible_devices(text: Column) -> Column:
    """How many devices a comma-separated list names; 1 for none."""
    names = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.greatest(F.size(names), F.lit(1))


def epoch_seed(seed: Column | int, epoch: Column, partition: Column) -> Column:
    return F.lit(seed) + epoch * 100000 + partition


def bar(value: Column, most: Column, width: int) -> Column:
    """A bar of blocks in proportion to the largest value."""
    length = F.floor(F.coalesce(ratio(value, most), F.lit(0.0)) * width + 1e-9).cast("int")
    return F.repeat(F.lit("█"), F.greatest(F.least(length, F.lit(width)), F.lit(0)))


def number_text(x: Column, digits: int = 4) -> Column:
    """A number with so many digits, N/A for none."""
    return F.when(x.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def mean_std_text(mean: Column, std: Column, digits: int = 4) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", mean), F.lit(" ± "), F.format_string(f"%.{digits}f", std))
