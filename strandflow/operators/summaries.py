"""Frequencies, top lists, traces and move statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count and share of each value within ``by``."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, by) if by else counts.crossJoin(totals)  # one row of totals
    return joined.withColumn("share", F.col("n") / F.col("total")).drop("total")


def top(counts: DataFrame, value: str, by: list[str], most: int = 20) -> DataFrame:
    """The ``most`` commonest values of each group, with shares among those kept.

    Ties go to the smaller value, so the report doesn't depend on partitions.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= most)
    return kept.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by))).drop("rank")


def renormalise(rows: DataFrame, value: str, by: list[str], weight: str = "weight") -> DataFrame:
    """Duplicates of a value added up, and the sums divided by their total."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias(weight))
    totals = sums.groupBy(*by).agg(F.sum(weight).alias("_total"))
    return sums.join(totals, by).withColumn(weight, F.try_divide(weight, "_total")).drop("_total")


def histogram(rows: DataFrame, group: str, value: str, bins: int = 10) -> DataFrame:
    """(group, bin, n, avg): equal-width bins from each group's least to largest value."""
    ends = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("avg"))
    place = F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(place, F.lit(bins - 1))).cast("bigint")
    joined = rows.where(F.col(value).isNotNull()).join(ends, group)
    return joined.groupBy(group, at.alias("bin"), "avg").agg(F.count("*").alias("n"))


#: Steps of a chain that are added up in one group.
BLOCK = 4096


def trace(steps: DataFrame, by: list[str], order: str, start: Column) -> DataFrame:
    """Running log-likelihood: its start, plus the deltas of the accepted steps.

    ``order`` numbers the steps of a chain. Blocks of steps are summed up first; a block's steps
    then add to what the blocks before it come to, so a long chain is many groups and only
    its block sums are one.
    """
    block = F.floor(F.col(order) / BLOCK).alias("_block")
    amount = F.when(F.col("accept"), F.col("delta")).otherwise(0.0)
    sums = steps.groupBy(*by, block).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.struct(*by, "_block").alias("_key"), F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    joined = steps.withColumn("_key", F.struct(*by, block)).join(sums, "_key")
    within = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn("logl", start + F.col("_before") + F.sum(amount).over(within)).select(*steps.columns, "logl")


def best_states(trace: DataFrame, by: list[str]) -> DataFrame:
    """The highest log-likelihood of each chain; the earliest of equals."""
    best = F.max(F.struct("logl", (-F.col("iter")).alias("i"))).alias("m")
    return trace.groupBy(*by).agg(best).select(*by, F.col("m.logl").alias("logl"), (-F.col("m.i")).alias("iter"))


def acceptance(trace: DataFrame, by: list[str]) -> DataFrame:
    return trace.groupBy(*by).agg(F.avg(F.col("accept").cast("double")).alias("rate"), F.count("*").alias("steps"))


def merge_by_name(named: DataFrame, replacing: DataFrame, name: str, value: str) -> DataFrame:
    """``named`` with ``value`` taken from the row of ``replacing`` that has the same name."""
    return named.drop(value).join(replacing.select(name, value), name)
