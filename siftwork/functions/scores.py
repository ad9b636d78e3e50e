"""Scoring signals as column expressions. Scores are single precision, divisions are narrowed at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 30.0
SIZE_INFLECTION = 500.0


@dataclass(frozen=True)
class Weights:
    """Weights of the four signals."""

    recency: float = 0.4
    size: float = 0.15
    proximity: float = 0.2
    dependency: float = 0.25

    @classmethod
    def focused(cls) -> Weights:
        """The weights used when focus paths are given."""
        return cls(0.15, 0.05, 0.45, 0.35)

    def as_tuple(self) -> tuple[float, float, float, float]:
        return self.recency, self.size, self.proximity, self.dependency


@dataclass(frozen=True)
class Budget:
    """A token budget and its layers' shares, narrowed in single precision."""

    total: int = 128_000
    l1_share: float = 0.05
    l2_share: float = 0.25
    l3_share: float = 0.70

    def _part(self, share: float) -> int:
        return int(np.float32(self.total) * np.float32(share))

    @property
    def l1(self) -> int:
        return self._part(self.l1_share)

    @property
    def l2(self) -> int:
        return self._part(self.l2_share)

    @property
    def l3(self) -> int:
        return self._part(self.l3_share)


def f32(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def unit(x: Column) -> Column:
    return F.greatest(F.least(x, f32(1)), f32(0))


def recency(age_days: Column) -> Column:
    """Halves every 30 days; within 0 and 1."""
    x = F.exp(F.lit(-float(np.log(2.0))) * age_days / F.lit(HALF_LIFE_DAYS))
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)).cast("float")


def entry_age_days(commit_age: Column, modified: Column, as_of: Column) -> Column:
    """The age of the last commit, or else of the modification; never negative."""
    own = F.greatest(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(modified.cast("timestamp")), F.lit(0)) / F.lit(86400.0)
    return F.coalesce(commit_age, own)


def size_signal(tokens: Column) -> Column:
    """One half at 500 tokens, falling with size."""
    return (F.lit(1.0) / (1 + (tokens / F.lit(SIZE_INFLECTION)).cast("float").cast("double"))).cast("float")


def dependency(distance: Column) -> Column:
    """One over one plus the graph distance; 0 where there is no path."""
    return F.coalesce((F.lit(1.0) / (1 + distance)).cast("float"), f32(0))


def composite(recency_: Column, size_: Column, proximity_: Column, dependency_: Column, weights: Weights = Weights()) -> Column:
    """The weighted mean of the signals within 0 and 1; 0 where the weights have no sum."""
    total = np.float32(0)
    for w in weights.as_tuple():
        total = np.float32(total + np.float32(w))
    if total <= 0:
        return f32(0)
    signals = [c.cast("float") for c in (recency_, size_, proximity_, dependency_)]
    terms = [f32(w) * s for w, s in zip(weights.as_tuple(), signals, strict=True)]
    return unit(((terms[0] + terms[1] + terms[2] + terms[3]) / f32(total)).cast("float"))


def with_feedback(score: Column, multiplier: Column) -> Column:
    """The score times what feedback says of it, if anything; within 0 and 1."""
    return unit(score.cast("float") * F.coalesce(multiplier.cast("float"), f32(1)))


def efficiency(score: Column, tokens: Column) -> Column:
    """Score per token; 0 without tokens."""
    return F.when(tokens > 0, (score.cast("float").cast("double") / tokens).cast("float")).otherwise(f32(0))


def budget_part(total: Column, share: float) -> Column:
    """A layer's tokens of a column of budgets: the single-precision product, cut off."""
    return F.floor((total.cast("float") * f32(share)).cast("double")).cast("long")
