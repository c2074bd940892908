"""Weighted paths laid over the graph: coverage, likelihood, and what moves change.

``paths``: (sample_id, path_id, seq, weight). ``edges``: normalised edges of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import likelihood as lk
from ..functions.sequence import path_edges

EDGE = ["sample_id", "position", "src", "dst"]


def explode_paths(paths: DataFrame, k: int) -> DataFrame:
    """(sample_id, path_id, weight, position, src, dst): the edges of each path."""
    return paths.select("sample_id", "path_id", "weight", F.inline(path_edges("seq", k)))


def eligible(paths: DataFrame, least: float) -> DataFrame:
    """The paths that can give weight to a new one and keep ``least`` themselves."""
    return paths.where(F.col("weight") >= 2 * least)


def coverage(paths: DataFrame, k: int) -> DataFrame:
    """Total weight of the paths through each edge."""
    return explode_paths(paths, k).groupBy(*EDGE).agg(F.sum("weight").alias("coverage"))


def errors(edges: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """Each edge of the graph with its coverage (0 without paths) and its error."""
    joined = edges.join(coverage(paths, k), EDGE, "left")
    return joined.select(*EDGE, "weight", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), lk.edge_error(F.col("coverage"), F.col("weight")).alias("error"))


def log_likelihood(edges: DataFrame, paths: DataFrame, k: int, rate: float) -> DataFrame:
    """(sample_id, paths, log_likelihood): squared errors over the graph's edges, and the
    Poisson law of the number of paths. Weight on edges outside the graph doesn't count."""
    fit = errors(edges, paths, k).groupBy("sample_id").agg((-F.sum(F.col("error") ** 2)).alias("fit"))
    number = paths.groupBy("sample_id").agg(F.count("*").alias("paths"))
    return fit.join(number, "sample_id").select("sample_id", "paths", (F.col("fit") + lk.log_poisson(F.col("paths"), rate)).alias("log_likelihood"))


def path_totals(edges: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """Edge weight, coverage, number of edges and excess of each path."""
    steps = explode_paths(paths, k).withColumnRenamed("weight", "path_weight")
    joined = steps.join(errors(edges, paths, k), EDGE)
    sums = joined.groupBy("sample_id", "path_id", "path_weight").agg(F.sum("weight").alias("edge_weight"), F.sum("coverage").alias("coverage"), F.count("*").alias("edges"))
    return sums.withColumn("excess", lk.path_excess(F.col("path_weight"), F.col("coverage"), F.col("edge_weight"), F.col("edges")))


def common_weight(edges: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """(sample_id, p, q, common, difference) of each ordered pair of paths.

    Pairs meet on shared edges, so the work follows shared edges and not the square of the
    paths; pairs that share none come from the paths' own list and have common 0.
    """
    steps = explode_paths(paths, k).join(edges.withColumnRenamed("weight", "edge_weight"), EDGE)
    one = steps.select(*EDGE, F.col("path_id").alias("p"), "edge_weight")
    two = steps.select(*EDGE, F.col("path_id").alias("q"))
    common = one.join(two, EDGE).groupBy("sample_id", "p", "q").agg(F.sum("edge_weight").alias("common"))
    whole = common.where("p = q").select("sample_id", "p", F.col("common").alias("total"))
    ids = paths.select("sample_id", F.col("path_id").alias("p"))
    pairs = ids.join(ids.withColumnRenamed("p", "q"), "sample_id").where("p <> q")
    joined = pairs.join(common, ["sample_id", "p", "q"], "left").join(whole, ["sample_id", "p"]).join(whole.select("sample_id", F.col("p").alias("q"), F.col("total").alias("other")), ["sample_id", "q"])
    shared = F.coalesce("common", F.lit(0.0))
    return joined.select("sample_id", "p", "q", shared.alias("common"), (F.col("total") + F.col("other") - 2 * shared).alias("difference"))


def holds_all(path_steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sample_id, path_id) of the paths that have every edge of ``wanted``."""
    need = wanted.groupBy("sample_id").agg(F.count("*").alias("need"))
    have = path_steps.join(wanted.select(*EDGE).distinct(), EDGE).groupBy("sample_id", "path_id").agg(F.count("*").alias("have"))
    return have.join(need, "sample_id").where("have = need").select("sample_id", "path_id")


def move_delta(edges: DataFrame, paths: DataFrame, moves: DataFrame, k: int) -> DataFrame:
    """(sample_id, move_id, delta) of the likelihood's fit when ``moves`` shift weight.

    ``moves``: (sample_id, move_id, source, target_seq, amount): ``amount`` leaves the path
    ``source`` for the path that spells ``target_seq``. Only edges where the two differ
    change. The Poisson part is +log(rate / (n + 1)) for a new path, and so on.
    """
    known = errors(edges, paths, k).select(*EDGE, "error")
    out = moves.join(paths.select("sample_id", F.col("path_id").alias("source"), "seq"), ["sample_id", "source"])
    steps = lambda c, sign: out.select("sample_id", "move_id", (F.col("amount") * sign).alias("change"), F.inline(path_edges(c, k)))
    both = steps("seq", -1).unionByName(steps("target_seq", 1)).groupBy("sample_id", "move_id", "position", "src", "dst").agg(F.sum("change").alias("change"), F.count("*").alias("sides"))
    changed = both.where("sides = 1").join(known, EDGE)
    return changed.groupBy("sample_id", "move_id").agg(F.sum(lk.edge_delta(F.col("error"), F.col("change"))).alias("delta"))
