"""Synthetic references, mutants and reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.infix import infix_match
from .lineage import spread


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number from 0 to 1 that a digest of seed and parts gives, the same everywhere."""
    named = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(named), 1, 10), 16, 10).cast("bigint") / float(1 << 40)


def references_for(samples: DataFrame, length: int, seed: int = 42) -> DataFrame:
    """(sample_id, seq): uniform bases for each sample; a base depends on seed, sample and
    place alone."""
    base = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit("ACGT"), (1 + F.floor(uniform(seed, "sample_id", i) * 4)).cast("int"), F.lit(1)))
    return samples.select("sample_id", F.array_join(base, "").alias("seq"))


def reference(spark: SparkSession, length: int, samples: int = 1, seed: int = 42) -> DataFrame:
    """(sample_id, seq) of ``samples`` samples numbered from 0."""
    return references_for(spark.range(samples).select(F.col("id").alias("sample_id")), length, seed)


def mutants(references: DataFrame, number: int, rate: float, seed: int = 42) -> DataFrame:
    """(sample_id, hap_id, seq): a tree of copies, each of a random earlier one with a
    Poisson number of substitutions. Each sample is one group of ``number`` + 1 sequences."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        sample = int(rows["sample_id"].iloc[0])
        rng = np.random.Generator(np.random.PCG64([seed, sample]))
        found = [rows["seq"].iloc[0]]
        for _ in range(number):
            child = list(found[rng.integers(len(found))])
            for _ in range(rng.poisson(rate)):
                at = int(rng.integers(len(child)))
                child[at] = str(rng.choice([b for b in "ACGT" if b != child[at]]))
            found.append("".join(child))
        return pd.DataFrame({"sample_id": sample, "hap_id": range(len(found)), "seq": found})

    return references.select("sample_id", "seq").groupBy("sample_id").applyInPandas(grow, "sample_id bigint, hap_id bigint, seq string")


def simulate_reads(haplotypes: DataFrame, number: int, least: int, most: int, error: float, seed: int = 42) -> DataFrame:
    """(sample_id, read_id, start, read): reads of each sample's haplotypes by weight.

    Choices are digests of (seed, sample, read), so results don't depend on partitions.
    Reads end at the sequence's end; a wrong base may equal the right one.
    """
    u = lambda salt, *more: uniform(seed, F.lit(salt), "sample_id", "read_id", *more)
    order = Window.partitionBy("sample_id").orderBy("hap_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("weight").over(Window.partitionBy("sample_id"))
    ends = haplotypes.select("sample_id", "hap_id", "seq", (F.sum("weight").over(order) / total).alias("hi"), (F.col("weight") / total).alias("share"))
    ids = haplotypes.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(number - 1).cast("bigint"))).alias("read_id"))
    drawn = ids.withColumn("u", u("haplotype"))
    chosen = drawn.join(ends, "sample_id").where((F.col("u") < F.col("hi")) & (F.col("u") >= F.col("hi") - F.col("share")))
    start = F.floor(u("start") * F.length("seq")).cast("int")
    length = (least + F.floor(u("length") * (most - least + 1))).cast("int")
    cut = chosen.select("sample_id", "read_id", start.alias("start"), F.substring("seq", start + 1, length).alias("clean"))

    def noisy(c, i):
        other = F.substring(F.lit("ACGT"), (1 + F.floor(u("base", i) * 4)).cast("int"), F.lit(1))
        return F.when(u("wrong", i) < error, other).otherwise(c)

    return cut.select("sample_id", "read_id", "start", F.array_join(F.transform(F.split("clean", ""), noisy), "").alias("read"))


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order given by a seeded digest of ``key``, which is the column ``place``."""
    return rows.withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("place", key)


def infix_distances(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(sample_id, query, text, distance, start): least edit distance of ``query`` to any
    substring of ``text``, and where its best match begins: of several the one that ends
    first, and of those the shortest. Bit-parallel inside the row (``functions.infix``), the
    pairs dealt to a stated number of tasks."""
    pairs = queries.select("sample_id", "query").join(texts.select("sample_id", "text"), "sample_id")
    found = spread(pairs, "sample_id", "query").withColumn("m", infix_match("query", "text"))
    return found.select("sample_id", "query", "text", "m.distance", "m.start")


def infix_matches(queries: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same by the whole table of the dynamic programming, pair by pair; pairs of the same lengths step together.

    A cell holds edits * BIG - start, so the least cell has the fewest edits and, of
    those, the latest start.
    """
    big = 1 << 40
    distance, start = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    shapes: dict[tuple[int, int], list[int]] = {}
    for at, (q, t) in enumerate(zip(queries, texts, strict=True)):
        shapes.setdefault((len(q), len(t)), []).append(at)
    for (n, m), rows in shapes.items():
        q, t = (np.array([[ord(c) for c in x[at]] for at in rows], np.int32).reshape(len(rows), size) for x, size in ((queries, n), (texts, m)))
        cells = [np.full(len(rows), i * big, np.int64) for i in range(n + 1)]
        best = cells[n]
        for j in range(m):
            diagonal = cells[0]
            cells[0] = np.full(len(rows), -(j + 1), np.int64)
            for i in range(1, n + 1):
                here = np.minimum(diagonal + (q[:, i - 1] != t[:, j]) * big, np.minimum(cells[i], cells[i - 1]) + big)
                diagonal, cells[i] = cells[i], here
            fewer = -(-cells[n] // big) < -(-best // big)
            best = np.where(fewer, cells[n], best)
        edits = -(-best // big)
        distance[rows], start[rows] = edits, edits * big - best
    return distance, start


def infix_distance(query: str, text: str) -> tuple[int, int]:
    distance, start = infix_matches([query], [text])
    return int(distance[0]), int(start[0])
