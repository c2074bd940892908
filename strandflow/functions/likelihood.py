"""Column functions of the mixture's likelihood and of the moves that change it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft(x: Column) -> Column:
    return 1 + F.signum(x) * F.sqrt(F.abs(x))


def edge_error(coverage: Column, weight: Column) -> Column:
    """Coverage without the edge's weight; an uncovered edge has coverage 0."""
    return F.coalesce(coverage, F.lit(0.0)) - weight


def edge_excess(path_weight: Column, error: Column) -> Column:
    return F.least(path_weight, error)


def path_excess(path_weight: Column, coverage: Column, weight: Column, edges: Column) -> Column:
    return F.least(path_weight, (coverage - weight) / edges)


def edge_delta(error: Column, change: Column) -> Column:
    """Change of -error**2 when an edge's coverage changes."""
    return -change * (2 * error + change)


def log_poisson(n: Column, rate: float) -> Column:
    """Log probability of n under a Poisson law; exact sums of logarithms for any n >= 0."""
    steps = F.when(n >= 1, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    logs = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return n * F.log(F.lit(rate)) - rate - logs


def move_mix(n: Column, rate: float) -> tuple[Column, Column, Column, Column]:
    """Probabilities of New, Move, Delete and Transfer with n paths."""
    one = n <= 1
    new, move = 1 / F.greatest(F.lit(6.0), rate + n), 1 / F.greatest(F.lit(6.0), rate + F.lit(rate) / n)
    delete = n / rate / (rate + n)
    half, none = F.lit(0.5), F.lit(0.0)
    return F.when(one, half).otherwise(new), F.when(one, half).otherwise(move), F.when(one, none).otherwise(delete), F.when(one, none).otherwise(1 - new - move - delete)


def clamp_new(draw: Column, weight: Column, least: float) -> Column:
    """The share a new path takes of its source: at least ``least``, and leaving as much."""
    return F.when(draw < least, F.lit(least)).when(draw > weight - least, weight - least).otherwise(draw)


def clamp_transfer(draw: Column, weight: Column, least: float) -> Column:
    return F.when(draw < 0, F.lit(0.0)).when(draw > weight - least, weight - least).otherwise(draw)
