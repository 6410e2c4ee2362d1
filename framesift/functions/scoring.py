"""Chunk scores from sampling statistics, as column expressions over a chunk's counters.

Chance comes from counters, not from a generator: the number behind (seed, step, draw, chunk) is a hash of
these, so a retried task, another partitioning and SQL in another engine all draw the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A plug-in gets the chunk table, the number of draws and a generator; it returns draws × chunks scores.
ScoreFunction = Callable[[pd.DataFrame, int, np.random.Generator], np.ndarray]

# The statistic each name stands for, as a column of the chunk table.
STATISTICS = {"gt": "n_once", "unique": "n_unique", "hits": "n_hits"}
#: Tries of a gamma draw, each taken with a chance of 0.95 or more; and halvings that end a quantile search.
TRIES, HALVINGS = 6, 100
COUNTER = ("seed", "step", "draw", "chunk_id")


def key_of(salt: Column | str, parts: tuple[str, ...] = COUNTER) -> Column:
    """Hash of a counter as hex text."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts], salt.cast("string")))


def unit(key: Column, part: int = 0) -> Column:
    """One of three uniform numbers in (0, 1) that a key holds."""
    return (F.conv(F.substring(key, 10 * part + 1, 10), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 40))


def normal(key: Column) -> Column:
    """Standard normal number of a key."""
    return F.sqrt(-2.0 * F.ln(unit(key, 0))) * F.cos(F.lit(2 * np.pi) * unit(key, 1))


def gamma_draw(shape: Column) -> Column:
    """Draw of Gamma(shape, 1) for the row's counter.

    Of cubes of shifted normal numbers, the first that passes the rejection test for shape + 1 is taken, times a power
    of a uniform number that brings the shape down by one.  A counter whose tries all fail, fewer than one in
    10**7, takes the distribution's scale itself.
    """
    d = shape + 2.0 / 3.0
    c = 1.0 / F.sqrt(9.0 * d)

    def numbers(key: Column) -> Column:
        return F.struct(normal(key).alias("x"), unit(key, 2).alias("w"))

    def cubed(s: Column) -> Column:
        return F.struct(s["x"].alias("x"), s["w"].alias("w"), F.pow(1.0 + c * s["x"], 3.0).alias("v"))

    def passed(s: Column) -> Column:
        x, w, v = s["x"], s["w"], s["v"]
        return (v > 0) & (F.ln(w) < 0.5 * x * x + d - d * v + d * F.ln(F.when(v > 0, v).otherwise(1.0)))

    # One transform after the other, so that each number is made once.
    keys = F.transform(F.sequence(F.lit(1), F.lit(TRIES)), lambda k: key_of(k))
    tries = F.transform(F.filter(F.transform(F.transform(keys, numbers), cubed), passed), lambda s: s["v"])
    return d * F.coalesce(F.get(tries, 0), F.lit(1.0)) * F.pow(unit(key_of("0")), 1.0 / shape)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: seven factors, then the asymptotic series."""
    z = x + 7.0
    below = x
    for i in range(1, 7):
        below = below * (x + float(i))
    series = 1.0 / (12.0 * z) - 1.0 / (360.0 * F.pow(z, 3.0)) + 1.0 / (1260.0 * F.pow(z, 5.0)) - 1.0 / (1680.0 * F.pow(z, 7.0)) + 1.0 / (1188.0 * F.pow(z, 9.0))
    return (z - 0.5) * F.ln(z) - z + 0.5 * np.log(2 * np.pi) + series - F.ln(below)


def gamma_cdf(shape: Column, x: Column, scale: Column) -> Column:
    """Share of Gamma(shape, 1) below ``x`` by its power series; ``scale`` is log_gamma(shape + 1)."""
    terms = F.ceil(60.0 + 14.0 * F.sqrt(shape + 30.0)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * x / (shape + k)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), terms), start, add, lambda s: s["total"])
    return F.when(x <= 0, 0.0).otherwise(F.exp(shape * F.ln(F.greatest(x, F.lit(1e-300))) - x - scale) * total)


def gamma_quantile(shape: Column, q: Column) -> Column:
    """Quantile of Gamma(shape, 1) by halving."""
    scale = log_gamma(shape + 1.0)
    start = F.struct(F.lit(0.0).alias("lo"), (shape + 10.0 * F.sqrt(shape) + 60.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2.0
        low = gamma_cdf(shape, mid, scale) < q
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2.0)


@dataclass(frozen=True)
class GammaScorer:
    """Score by a Gamma(stat + alpha, frames + beta) belief about a chunk's yield.

    ``ts`` draws from it, ``bayes_ucb`` takes its upper 1/(n+1) quantile, ``none`` its mean.  The
    ``uniform`` statistic treats all chunks alike.
    """

    stat: str = "gt"
    policy: str = "ts"
    alpha: float = 0.1
    beta: float = 1.0

    def belief(self) -> tuple[Column, Column]:
        if self.stat == "uniform":
            return F.lit(1.0), F.lit(1.0)
        return F.col(STATISTICS[self.stat]).cast("double") + self.alpha, F.col("n_frames").cast("double") + self.beta

    @property
    def draws(self) -> bool:
        """Whether each draw has its own score; else those of a step share one per chunk."""
        return self.policy == "ts"

    def per_chunk(self) -> Column:
        shape, rate = self.belief()
        if self.policy == "bayes_ucb":
            return gamma_quantile(shape, 1.0 - 1.0 / (F.col("sampled").cast("double") + 1.0)) / rate
        if self.policy == "none":
            return shape / rate
        raise ValueError(self.policy)

    def per_draw(self) -> Column:
        shape, rate = self.belief()
        return gamma_draw(shape) / rate


@dataclass(frozen=True)
class RandomScorer:
    """Chunk choice by chance alone."""

    draws = True

    def per_draw(self) -> Column:
        return normal(key_of("0"))
