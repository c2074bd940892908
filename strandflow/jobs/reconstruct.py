"""From aligned reads to scored mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, lineage, sampler


def clean_edges(reads: DataFrame, k: int) -> DataFrame:
    """Normalised edges of the reads' graph without dead ends."""
    return _clean(lineage.written(reads, "reads"), k)


def _clean(reads: DataFrame, k: int) -> DataFrame:
    """The same of ``reads`` that are a table: they are read three times."""
    edges, vertices, lengths = graph.edges(reads, k), graph.vertices(reads, k), graph.origin_length(reads)
    return graph.normalise(graph.cut_tails(vertices, edges, lengths, k))


def single_paths(edges: DataFrame) -> DataFrame:
    """(sample_id, seq, weight 1) of samples whose ``edges`` are one path, spelled along it."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("position", "src", "dst"))), lambda e: F.right(e["dst"], F.lit(1)))
    first = F.min(F.struct("position", "src"))["src"]
    return edges.groupBy("sample_id").agg(F.concat(first, F.array_join(steps, "")).alias("seq")).select("sample_id", "seq", F.lit(1.0).alias("weight"))


def reconstruct(reads: DataFrame, references: DataFrame | None = None, settings: sampler.Settings = sampler.Settings(), chains: int = 4) -> DataFrame:
    """(sample_id, seq, weight) for each sample of ``reads`` (sample_id, start, read[, n]).

    A sample whose graph has a single path takes what that path spells whole, without
    sampling; one whose graph has none is left out. ``references``: only its samples.
    """
    k = settings.k
    reads = reads if references is None else reads.join(references.select("sample_id").distinct(), "sample_id", "left_semi")
    reads = lineage.written(reads, "reads")
    edges = lineage.written(_clean(reads, k), "edges")
    kinds = graph.path_kinds(edges, graph.origin_length(reads), k)
    alone = single_paths(edges.join(kinds.where("kind = 'one'").select("sample_id"), "sample_id", "left_semi"))
    many = edges.join(kinds.where("kind = 'many'").select("sample_id"), "sample_id", "left_semi")
    return alone.unionByName(sampler.best_of_chains(sampler.mixtures(many, chains, settings)))
