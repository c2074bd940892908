"""Paths through layered graphs by composing layers in blocks.

A layer's steps lead from vertices at one position to vertices at the next. Steps of two
neighbouring blocks of layers compose to steps of both together, so a tree of blocks takes as many
rounds as the logarithm of the length, whatever the tails or bubbles of the graph; going down
again takes the state before a block to each of its halves. Every round is a join on vertices
and a sum, written in the shared folder, as the next reads it more than once. Rows are those of connected pairs of a block's two ends.

Tables of steps: key columns, position, src, dst and a weight ``w``; positions from ``lo`` to
``hi`` of each key are one sequence of layers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

#: Adds up the weights of a group.
Add = Callable[[Column], Column]


def _depth(spans: DataFrame) -> int:
    """Rounds until each key has one block."""
    differ = spans.agg(F.max(F.col("lo").bitwiseXOR(F.col("hi")))).first()[0]
    return int(differ or 0).bit_length()


def compose(steps: DataFrame, keys: list[str], spans: DataFrame, add: Add, scale: bool = False) -> list[DataFrame]:
    """Steps of blocks of 1, 2, 4 .. layers, up to one block for each key: (keys, lo, hi, block,
    src, dst, w). Block b of level j holds the layers from b * 2**j on.

    ``spans``: (keys, lo, hi). With ``scale``, weights of a block are shares of their total.
    """
    level = steps.join(spans, keys).where("position between lo and hi").select(*keys, "lo", "hi", F.col("position").cast("bigint").alias("block"), "src", "dst", "w")
    levels = [written(level, "layers")]
    for j in range(_depth(spans)):
        level = levels[-1]
        first, last = F.shiftright("lo", j), F.shiftright("hi", j)
        up = [*keys, "lo", "hi", F.shiftright("block", 1).alias("block")]
        odd = F.col("block").bitwiseAND(F.lit(1).cast("bigint")) == 1
        alone = F.when(odd, F.col("block") == first).otherwise(F.col("block") == last)
        left = level.where(~odd & ~alone).select(*up, "src", F.col("dst").alias("mid"), F.col("w").alias("w1"))
        right = level.where(odd & ~alone).select(*keys, F.shiftright("block", 1).alias("block"), F.col("src").alias("mid"), "dst", F.col("w").alias("w2"))
        both = left.join(right, [*keys, "block", "mid"]).groupBy(*keys, "lo", "hi", "block", "src", "dst").agg(add(F.col("w1") * F.col("w2")).alias("w"))
        made = both.select(*keys, "lo", "hi", "block", "src", "dst", "w").unionByName(level.where(alone).select(*up, "src", "dst", "w"))
        if scale:
            made = made.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "block")))
        levels.append(written(made, "layers"))
    return levels


def states(levels: list[DataFrame], keys: list[str], start: DataFrame, add: Add, scale: bool = False) -> DataFrame:
    """(keys, position, vertex, w): the state at each position, from ``start`` (keys, lo, hi,
    vertex, w), the state at ``lo``; the last one is behind the last layer."""
    state = start.select(*keys, "lo", "hi", F.shiftright(F.col("lo").cast("bigint"), len(levels) - 1).alias("block"), "vertex", "w")

    def through(state: DataFrame, level: DataFrame, block: Column) -> DataFrame:
        steps = level.select(*keys, "block", F.col("src").alias("vertex"), "dst", F.col("w").alias("step"))
        moved = state.join(steps, [*keys, "block", "vertex"]).groupBy(*keys, "lo", "hi", "block", "dst").agg(add(F.col("w") * F.col("step")).alias("w"))
        return moved.select(*keys, "lo", "hi", block.alias("block"), F.col("dst").alias("vertex"), "w")

    for j in range(len(levels) - 2, -1, -1):
        first, last = F.shiftright("lo", j), F.shiftright("hi", j)
        # the state before a block is that before its first half that there is
        half = F.when(F.col("block") * 2 >= first, F.col("block") * 2).otherwise(F.col("block") * 2 + 1)
        halves = state.withColumn("block", half)
        both = (F.col("block").bitwiseAND(F.lit(1).cast("bigint")) == 0) & (F.col("block") + 1 <= last)
        state = halves.unionByName(through(halves.where(both), levels[j], F.col("block") + 1))
        if scale:
            state = state.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "block")))
        state = written(state, "states")
    end = through(state.where(F.col("block") == F.col("hi")), levels[0], F.col("block") + 1)
    return state.unionByName(end).select(*keys, F.col("block").alias("position"), "vertex", "w")
