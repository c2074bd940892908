"""Comparing recovered mixtures with the truth.

``truth`` and ``found``: (sample_id, seq, weight).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import hamming


def distances(truth: DataFrame, found: DataFrame, edit: bool = False) -> DataFrame:
    """(sample_id, i_seq, j_seq, distance) of every pair of a sample: Hamming, or edit."""
    a = truth.select("sample_id", F.col("seq").alias("i_seq"))
    b = found.select("sample_id", F.col("seq").alias("j_seq"))
    pairs = a.join(b, "sample_id")
    measure = F.levenshtein("i_seq", "j_seq") if edit else hamming("i_seq", "j_seq")
    return pairs.withColumn("distance", measure.cast("bigint"))


def _blocks(size: Column, number: int) -> Column:
    """(k, block) of a column ``seq`` cut at its first ``size`` letters into ``number`` blocks."""
    edge = lambda k: F.floor(k * size / number).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda k: F.struct(k.alias("k"), F.substring("seq", edge(k) + 1, edge(k + 1) - edge(k)).alias("block")))


def candidates(truth: DataFrame, found: DataFrame, below: int) -> DataFrame:
    """(sample_id, t, f): distinct pairs that may be within Hamming distance ``below``.

    Of two sequences with fewer than ``below`` differences, cut into as many blocks, one block
    is the same in both, so pairs meet in blocks instead of all with all; no pair is lost. As
    distances go over the length of ``t``, ``f`` is cut at each length that a ``t`` has.
    """
    t = truth.select("sample_id", "seq").distinct()
    sizes = t.select("sample_id", F.length("seq").alias("size")).distinct()
    f = found.select("sample_id", "seq").distinct().join(sizes, "sample_id").where(F.length("seq") >= F.col("size"))
    left = t.withColumn("size", F.length("seq")).select("sample_id", F.col("seq").alias("t"), "size", F.inline(_blocks(F.col("size"), below)))
    right = f.select("sample_id", F.col("seq").alias("f"), "size", F.inline(_blocks(F.col("size"), below)))
    return left.join(right, ["sample_id", "size", "k", "block"]).select("sample_id", "t", "f").distinct()


def near_pairs(truth: DataFrame, found: DataFrame, below: int) -> DataFrame:
    """(sample_id, t, f): distinct pairs of a sample within Hamming distance ``below``; an error
    if a sample has an ``f`` shorter than a ``t``, as the distance has none."""
    longest = truth.groupBy("sample_id").agg(F.max(F.length("seq")).alias("most"))
    shortest = found.groupBy("sample_id").agg(F.min(F.length("seq")).alias("least"))
    fits = F.when(F.col("least") < F.col("most"), F.raise_error(F.lit("the second sequence is shorter")).cast("boolean")).otherwise(F.lit(True))
    checked = longest.join(shortest, "sample_id").select("sample_id", fits.alias("fits")).where("fits")
    close = candidates(truth, found, below).where(hamming("t", "f") < below)
    return close.join(checked, "sample_id", "left_semi")


def precision_recall(truth: DataFrame, found: DataFrame, below: int = 9) -> DataFrame:
    """Precision and recall by weight: a sequence counts if the other side has weight
    within Hamming distance ``below``. Precision is null where nothing was found."""
    t = truth.groupBy("sample_id", F.col("seq").alias("t")).agg(F.sum("weight").alias("tw"))
    f = found.groupBy("sample_id", F.col("seq").alias("f")).agg(F.sum("weight").alias("fw"))
    near = near_pairs(truth, found, below).join(t, ["sample_id", "t"]).join(f, ["sample_id", "f"])
    hit = near.groupBy("sample_id", "t").agg(F.sum("fw").alias("mass")).where("mass > 0")
    true = t.join(hit, ["sample_id", "t"], "left_semi").groupBy("sample_id").agg(F.sum("tw").alias("tp"))
    close = near.groupBy("sample_id", "f").agg(F.sum("tw").alias("mass")).where("mass > 0")
    false = f.join(close, ["sample_id", "f"], "left_anti").groupBy("sample_id").agg(F.sum("fw").alias("fp"))
    samples = truth.select("sample_id").union(found.select("sample_id")).distinct()
    both = samples.join(true, "sample_id", "left").join(false, "sample_id", "left")
    tp, fp = F.coalesce("tp", F.lit(0.0)), F.coalesce("fp", F.lit(0.0))
    return both.select("sample_id", F.try_divide(tp, tp + fp).alias("precision"), tp.alias("recall"))


def with_reference(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """(sample_id, source, seq, weight): all predictions, and each sample's reference as one
    more, with the whole weight."""
    plain = references.select("sample_id", F.lit("_reference").alias("source"), "seq", F.lit(1.0).alias("weight"))
    return predictions.select("sample_id", "source", "seq", "weight").unionByName(plain)


def score_sources(truth: DataFrame, predictions: DataFrame, below: int = 9) -> DataFrame:
    """(sample_id, source, precision, recall) of every source of every sample."""
    key = F.struct("sample_id", "source").alias("sample_id")
    each = truth.join(predictions.select("sample_id", "source").distinct(), "sample_id")
    out = precision_recall(each.select(key, "seq", "weight"), predictions.select(key, "seq", "weight"), below)
    return out.select("sample_id.sample_id", "sample_id.source", "precision", "recall")


def transport_cost(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving ``supply`` to ``demand``: shortest augmenting paths.

    Totals must agree up to rounding; else the cost is not a number.
    """
    if abs(supply.sum() - demand.sum()) > 1e-6 * max(1.0, supply.sum()):
        return float("nan")
    n, m = cost.shape
    supply, demand, flow = supply.astype(float).copy(), demand.astype(float).copy(), np.zeros((n, m))
    while supply.max(initial=0) > 1e-12 and demand.max(initial=0) > 1e-12:
        # Bellman-Ford over sources and sinks of the residual network
        ds = np.where(supply > 1e-12, 0.0, np.inf)
        via_s, dt, via_t = np.full(n, -1), np.full(m, np.inf), np.full(m, -1)
        for _ in range(n + m):
            through = ds[:, None] + cost
            best = through.min(0)
            better = best < dt - 1e-12
            dt, via_t = np.where(better, best, dt), np.where(better, through.argmin(0), via_t)
            back = np.where(flow > 1e-12, dt[None, :] - cost, np.inf)
            best_s = back.min(1)
            better_s = best_s < ds - 1e-12
            ds, via_s = np.where(better_s, best_s, ds), np.where(better_s, back.argmin(1), via_s)
            if not better.any() and not better_s.any():
                break
        j = int(np.where(demand > 1e-12, dt, np.inf).argmin())
        route, t = [], j
        while True:
            s = int(via_t[t])
            route.append((s, t, 1))
            if via_s[s] < 0 or supply[s] > 1e-12 and ds[s] == 0:
                break
            t = int(via_s[s])
            route.append((s, t, -1))
        amount = min([supply[s], demand[j]] + [flow[a, b] for a, b, sign in route if sign < 0])
        for a, b, sign in route:
            flow[a, b] += sign * amount
        supply[s] -= amount
        demand[j] -= amount
    return float((flow * cost).sum())


def earth_movers(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(sample_id, distance): least edit distance, by weight, from found to truth.

    Distances come from a join; a sample's transport problem, bounded by its sequences,
    is solved in one group. Duplicate sequences of a side add up. Different totals give null.
    """
    sides = lambda df: df.groupBy("sample_id", "seq").agg(F.sum("weight").alias("weight"))
    t = sides(truth).select("sample_id", F.col("seq").alias("i_seq"), F.col("weight").alias("tw"))
    f = sides(found).select("sample_id", F.col("seq").alias("j_seq"), F.col("weight").alias("fw"))
    pairs = t.join(f, "sample_id").withColumn("cost", F.levenshtein("i_seq", "j_seq").cast("double"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        i, names_i = pd.factorize(rows["i_seq"], sort=True)
        j, names_j = pd.factorize(rows["j_seq"], sort=True)
        cost, a, b = np.zeros((len(names_i), len(names_j))), np.zeros(len(names_i)), np.zeros(len(names_j))
        cost[i, j], a[i], b[j] = rows["cost"], rows["tw"], rows["fw"]
        value = transport_cost(a, b, cost)
        return pd.DataFrame({"sample_id": [rows["sample_id"].iloc[0]], "distance": [None if np.isnan(value) else value]})

    return pairs.groupBy("sample_id").applyInPandas(solve, "sample_id bigint, distance double")
