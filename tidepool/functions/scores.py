"""Scoring functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.lexicons import BETA, HALF_LIFE, INVESTMENT, PERMANENT, STABLE, TECHNICAL, VOLATILE, WEIGHTS
from tidepool.functions.text import any_of, hits


def decay_tier(text: Column) -> Column:
    """volatile from two fast words, else stable from two slow ones, else whichever has more, else normal."""
    low = F.lower(text)
    v, s = hits(low, VOLATILE), hits(low, STABLE)
    return F.when(v >= 2, "volatile").when(s >= 2, "stable").when(v > s, "volatile").when(s > v, "stable").otherwise("normal")


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / 8.64e10


def retention(tier: Column, age: Column) -> Column:
    """Stretched exponential with a floor; 0.5 if the age is unknown. A negative age counts as 0."""
    out = F.lit(0.5)
    for name in HALF_LIFE:
        out = F.when(age.isNotNull() & (tier == name), F.greatest(F.lit(0.20), F.exp(-math.log(2) / HALF_LIFE[name] * F.pow(F.greatest(age, F.lit(0.0)), BETA[name])))).otherwise(out)
    return out


def frequency(recalls: Column) -> Column:
    return F.when(recalls > 0, F.least(F.lit(1.0), F.log2(recalls + 1) / 4)).otherwise(0.1)


def diversity(sessions: Column) -> Column:
    return F.when(sessions > 0, F.least(F.lit(1.0), sessions / 5)).otherwise(0.1)


def domain(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_of(low, [w.lower() for w in INVESTMENT]), 0.9).when(any_of(low, [w.lower() for w in TECHNICAL]), 0.6).otherwise(0.3)


def consolidation(recalls: Column, sessions: Column) -> Column:
    return F.when((recalls >= 3) & (sessions >= 2), F.least(F.lit(1.0), F.sqrt(recalls * sessions) / 4)).when(sessions >= 2, 0.4).otherwise(0.1)


def confidence(text: Column) -> Column:
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    n = F.size(w)
    share = F.when(n > 50, F.least(F.lit(1.0), 2.0 * F.size(F.array_distinct(w)) / n)).otherwise(0.3)
    return F.when(any_of(text, PERMANENT), 1.0).otherwise(share)


def novelty(distance: Column) -> Column:
    """From the distance of the nearest memory within 0.5; 0.9 without one."""
    return F.when(distance.isNotNull(), F.least(F.lit(1.0), distance / 0.5)).otherwise(0.9)


def importance(dimensions: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + weight * dimensions[name]
    return out


def decision(size: Column, score: Column, age: Column) -> Column:
    """boost, decay or keep, with the thresholds of single memories and of groups."""
    single = F.when((age > 90) & (score < 0.50), "decay").when(score > 0.7, "boost").when(score < 0.25, "decay")
    group = F.when(score >= 0.7, "boost").when(score < 0.25, "decay")
    return F.coalesce(F.when(size == 1, single).otherwise(group), F.lit("keep"))


def freshness(age: Column, is_dated: Column) -> Column:
    return F.when((age > 7) & is_dated, "stale").when(age <= 1, "fresh").when(age <= 7, "recent").otherwise("unknown")
