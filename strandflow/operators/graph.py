"""The de Bruijn graph of aligned reads: vertices are (position, k-mer)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import windows
from . import layers
from .lineage import cut, written

LAYER = ["sample_id", "position"]
#: Residues are below this, so that the product of two fits into a long.
PRIME_BELOW = 1 << 31


def vertices(reads: DataFrame, k: int) -> DataFrame:
    """Distinct (sample_id, position, kmer), also of reads that have no edge."""
    i = F.explode(windows("read", k))
    rows = reads.select("sample_id", "start", "read", i.alias("i"))
    return rows.select("sample_id", (F.col("start") + F.col("i")).alias("position"), F.substring("read", F.col("i") + 1, F.lit(k)).alias("kmer")).distinct()


def edges(reads: DataFrame, k: int) -> DataFrame:
    """(sample_id, position, src, dst, weight): how many reads step from src to dst.

    ``reads`` may carry a count ``n``. Both k-mers come from the same row, so there is one
    shuffle, after partial sums.
    """
    n = F.col("n") if "n" in reads.columns else F.lit(1)
    rows = reads.select("sample_id", "start", "read", n.alias("n"), F.explode(windows("read", k + 1)).alias("i"))
    at = lambda d: F.substring("read", F.col("i") + d, F.lit(k))
    steps = rows.select("sample_id", (F.col("start") + F.col("i")).alias("position"), at(1).alias("src"), at(2).alias("dst"), "n")
    return steps.groupBy(*LAYER, "src", "dst").agg(F.sum("n").alias("weight"))


def origin_length(reads: DataFrame) -> DataFrame:
    """The largest end of a read, per sample."""
    return reads.groupBy("sample_id").agg(F.max(F.col("start") + F.length("read")).cast("bigint").alias("origin_length"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree of each vertex, 0 where it has none."""
    out = edges.groupBy("sample_id", "position", F.col("src").alias("kmer")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy("sample_id", (F.col("position") + 1).alias("position"), F.col("dst").alias("kmer")).agg(F.count("*").alias("in_degree"))
    key = ["sample_id", "position", "kmer"]
    joined = vertices.join(out, key, "left").join(into, key, "left")
    return joined.select(*key, F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"))


def dead_ends(degrees: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """Interior vertices that lack edges on one side."""
    inner = (F.col("position") > 0) & (F.col("position") + k < F.col("origin_length"))
    lacking = (F.col("in_degree") == 0) | (F.col("out_degree") == 0)
    return degrees.join(lengths, "sample_id").where(inner & lacking).select("sample_id", "position", "kmer")


def boundaries(vertices: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """Sources (position 0) and sinks (position + k is the length)."""
    both = vertices.join(lengths, "sample_id")
    kind = F.when(F.col("position") == 0, "source").when(F.col("position") + k == F.col("origin_length"), "sink")
    return both.select("sample_id", "position", "kmer", kind.alias("kind")).where("kind is not null")


def normalise(edges: DataFrame) -> DataFrame:
    """Weights as shares of their layer's total."""
    total = F.sum("weight").over(Window.partitionBy(*LAYER))
    return edges.withColumn("weight", F.col("weight") / total)


def layer_error(edges: DataFrame) -> DataFrame:
    """Sample standard deviation of the layer totals; 0 for a single layer."""
    totals = edges.groupBy(*LAYER).agg(F.sum("weight").alias("total"))
    return totals.groupBy("sample_id").agg(F.count("*").alias("layers"), F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("error"))


def branching(edges: DataFrame) -> DataFrame:
    """Vertices where paths may part (out) or meet (in): more than one edge on a side."""
    out = edges.groupBy("sample_id", "position", F.col("src").alias("kmer")).count().where("count > 1").select("sample_id", "position", "kmer", F.lit("out").alias("side"))
    into = edges.groupBy("sample_id", (F.col("position") + 1).alias("position"), F.col("dst").alias("kmer")).count().where("count > 1").select("sample_id", "position", "kmer", F.lit("in").alias("side"))
    return out.unionByName(into)


def _both_ways(edges: DataFrame) -> DataFrame:
    """Steps (sample_id, way, position, src, dst): way 1 as the edges go, way -1 against
    them, at negative positions."""
    ahead = edges.select("sample_id", F.lit(1).alias("way"), F.col("position").cast("bigint").alias("position"), "src", "dst")
    back = edges.select("sample_id", F.lit(-1).alias("way"), (-1 - F.col("position")).cast("bigint").alias("position"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return ahead.unionByName(back)


def reached(vertices: DataFrame, edges: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """(sample_id, way, position, kmer) of the vertices that are reached from position 0 (way
    1), and of those that reach the right boundary (way -1)."""
    keys = ["sample_id", "way"]
    ends = lengths.select("sample_id", (F.col("origin_length") - k).alias("last")).where("last > 0")
    span = ends.select("sample_id", F.explode(F.array(F.struct(F.lit(1).alias("way"), F.lit(0).cast("bigint").alias("lo"), (F.col("last") - 1).alias("hi")), F.struct(F.lit(-1).alias("way"), (-F.col("last")).alias("lo"), F.lit(-1).cast("bigint").alias("hi")))).alias("s")).select("sample_id", "s.*")
    spans = written(span, "spans")
    any_ = lambda w: F.max(w)
    levels = layers.compose(_both_ways(edges).withColumn("w", F.lit(1)), keys, spans, any_)
    at = vertices.select("sample_id", F.explode(F.array(F.struct(F.lit(1).alias("way"), F.col("position").cast("bigint").alias("at")), F.struct(F.lit(-1).alias("way"), (-F.col("position")).cast("bigint").alias("at")))).alias("s"), "kmer").select("sample_id", "s.*", "kmer")
    start = at.join(spans, keys).where(F.col("at") == F.col("lo")).select(*keys, "lo", "hi", F.col("kmer").alias("vertex"), F.lit(1).alias("w"))
    found = layers.states(levels, keys, start, any_)
    return found.select("sample_id", "way", (F.col("position") * F.col("way")).cast("int").alias("position"), F.col("vertex").alias("kmer"))


def cut_tails(vertices: DataFrame, edges: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """The edges left after peeling dead ends until there is none.

    In a layered graph an inner vertex stays if it is reached from the left boundary and
    reaches the right one; a boundary vertex if it had no inner edges or has a kept neighbour.
    Reachability comes from blocks of layers, so rounds follow the logarithm of the length,
    not the longest tail.
    """
    key = ["sample_id", "position", "kmer"]
    # each is read several times
    vertices, edges, lengths = written(vertices, "vertices"), written(edges, "edges"), written(lengths, "lengths")
    ways = reached(vertices, edges, lengths, k).groupBy(*key).agg(F.count("*").alias("ways")).where("ways = 2").select(*key, F.lit(True).alias("through"))
    marked = vertices.join(lengths, "sample_id").join(ways, key, "left")
    first, last = F.col("position") <= 0, F.col("position") + k >= F.col("origin_length")
    marked = written(marked.select(*key, first.alias("first"), last.alias("last"), (F.coalesce("through", F.lit(False)) | first | last).alias("on")), "marked")
    side = lambda name, shift, c: marked.select("sample_id", (F.col("position") - shift).alias("position"), F.col("kmer").alias(c), F.col("on").alias(f"{name}_on"), F.col("first").alias(f"{name}_first"), F.col("last").alias(f"{name}_last"))
    both = edges.join(side("a", 0, "src"), ["sample_id", "position", "src"]).join(side("b", 1, "dst"), ["sample_id", "position", "dst"])
    # what a boundary vertex leads to, or is led to by, must be left
    alive = both.where("a_on and b_on")
    held = alive.where("a_first").select("sample_id", "position", F.col("src").alias("kmer")).union(alive.where("b_last and not b_first").select("sample_id", F.col("position") + 1, "dst"))
    near = both.where("a_first").select("sample_id", "position", F.col("src").alias("kmer")).union(both.where("b_last and not b_first").select("sample_id", F.col("position") + 1, "dst"))
    lost = near.distinct().join(held.distinct(), key, "left_anti")
    kept = alive.join(lost.withColumnRenamed("kmer", "src"), ["sample_id", "position", "src"], "left_anti")
    kept = kept.join(lost.select("sample_id", (F.col("position") - 1).alias("position"), F.col("kmer").alias("dst")), ["sample_id", "position", "dst"], "left_anti")
    return kept.select("sample_id", "position", "src", "dst", "weight")


def cut_tails_in_rounds(vertices: DataFrame, edges: DataFrame, lengths: DataFrame, k: int, most: int = 10_000) -> DataFrame:
    """The same by rounds of anti-joins, each round written to the checkpoint folder: the
    better way where tails are known to be a few vertices long.

    Rounds are as many as the longest tail has vertices.
    """
    key = ["sample_id", "position", "kmer"]
    alive, kept = vertices, edges
    first = degrees(vertices, edges).join(lengths, "sample_id")
    inner = (F.col("position") > 0) & (F.col("position") + k < F.col("origin_length"))
    lost_out, lost_in = F.col("out_degree") == 0, F.col("in_degree") == 0
    gone = first.where(inner & (lost_out | lost_in)).select(*key)
    had = first.select(*key, F.col("in_degree").alias("had_in"), F.col("out_degree").alias("had_out"))
    for _ in range(most):
        if gone.isEmpty():
            return kept
        alive = cut(alive.join(gone, key, "left_anti"))
        kept = kept.join(gone.withColumnRenamed("kmer", "src"), ["sample_id", "position", "src"], "left_anti")
        kept = cut(kept.join(gone.select("sample_id", (F.col("position") - 1).alias("position"), F.col("kmer").alias("dst")), ["sample_id", "position", "dst"], "left_anti").select(*edges.columns))
        now = degrees(alive, kept).join(had, key)
        gone = now.where((lost_out & (F.col("had_out") > 0)) | (lost_in & (F.col("had_in") > 0))).select(*key)
    raise RuntimeError("tails are left")


def path_kinds(edges: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """(sample_id, kind) of graphs without dead ends: ``none``, ``one`` or ``many`` source-to-sink
    paths, without counting them. Every layer must have an edge, and more than one in
    any layer are paths that part."""
    of = edges.groupBy("sample_id").agg(F.countDistinct("position").alias("layers"), F.count("*").alias("edges")).join(lengths, "sample_id")
    kind = F.when(F.col("layers") < F.col("origin_length") - k, "none").when(F.col("edges") == F.col("layers"), "one").otherwise("many")
    return of.select("sample_id", kind.alias("kind"))


def _primes(number: int) -> list[int]:
    """The largest primes below PRIME_BELOW."""
    small = [p for p in range(2, 46_342) if all(p % q for q in range(2, int(p**0.5) + 1))]
    found, at = [], PRIME_BELOW
    while len(found) < number:
        at -= 1
        if all(at % p for p in small):
            found.append(at)
    return found


def count_paths(edges: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """(sample_id, paths, digits): source-to-sink paths; ``digits`` is the exact number as a
    string, ``paths`` the same as decimal(38,0), null where it has more digits.

    Paths are counted modulo as many primes as a bound of the number needs (the product
    of each layer's largest out-degree), by composing blocks of layers, and the number is
    rebuilt from its residues. Dead ends are on no such path, so the graph may have them: edges
    that none goes on from are left out before the bound is taken, longer tails count nothing.
    """
    edges = written(edges, "edges")
    ends = lengths.select("sample_id", (F.col("origin_length") - k).alias("last")).where("last > 0")
    inner = edges.join(ends, "sample_id").where("position >= 0 and position < last")
    on = edges.select("sample_id", (F.col("position") - 1).alias("position"), F.col("src").alias("dst"), F.lit(True).alias("on")).distinct()
    inner = written(inner.join(on, ["sample_id", "position", "dst"], "left").where("on or position = last - 1").drop("on"), "inner")
    out = inner.groupBy("sample_id", "position", "src").agg(F.count("*").alias("n"))
    layer = out.groupBy("sample_id", "position").agg(F.log2(F.max("n")).alias("bits"), F.log2(F.count("*")).alias("sources"))
    bits = layer.groupBy("sample_id").agg((F.sum("bits") + F.max(F.when(F.col("position") == 0, F.col("sources")).otherwise(0))).alias("bits"))
    # rounding must not take the last bit, and each prime gives more than 30
    needed = written(bits.select("sample_id", F.ceil((F.col("bits") * 1.000001 + 2) / 30).cast("int").alias("number")), "needed")
    primes = _primes(needed.agg(F.max("number")).first()[0] or 1)
    listed = F.array(*[F.lit(p).cast("bigint") for p in primes])
    residues = inner.join(needed, "sample_id").select("sample_id", F.explode(F.slice(listed, F.lit(1), F.col("number"))).alias("prime"), "position", "src", "dst", F.lit(1).cast("bigint").alias("w"))
    spans = ends.join(needed, "sample_id").select("sample_id", F.explode(F.slice(listed, F.lit(1), F.col("number"))).alias("prime"), F.lit(0).cast("bigint").alias("lo"), (F.col("last") - 1).alias("hi"))
    add = lambda w: F.sum(w % F.col("prime")) % F.col("prime")
    top = layers.compose(residues, ["sample_id", "prime"], written(spans, "spans"), add)[-1]
    sums = top.groupBy("sample_id", "prime").agg((F.sum("w") % F.col("prime")).alias("r"))
    rebuilt = sums.groupBy("sample_id").agg(_rebuild(F.sort_array(F.collect_list(F.struct("prime", "r")))).alias("digits"))
    found = edges.select("sample_id").distinct().join(rebuilt, "sample_id", "left").select("sample_id", F.coalesce("digits", F.lit("0")).alias("digits"))
    return found.select("sample_id", F.expr("try_cast(digits AS decimal(38,0))").alias("paths"), "digits")


@F.pandas_udf(T.StringType())
def _rebuild(residues: pd.Series) -> pd.Series:
    """The number below the product of the primes that has these residues, in digits."""

    def one(pairs) -> str:
        number, product = 0, 1
        for pair in pairs:
            prime, r = int(pair["prime"]), int(pair["r"])
            number += product * ((r - number) * pow(product, -1, prime) % prime)
            product *= prime
        digits = []
        while number >= 10**1000:  # str() of longer numbers is refused
            number, low = divmod(number, 10**1000)
            digits.append(f"{low:01000d}")
        return str(number) + "".join(reversed(digits))

    return residues.map(one)


def path_shares(edges: DataFrame) -> DataFrame:
    """(sample_id, position, kmer, count_left, count_right): shares of the paths that
    come to a vertex and that go on from it, normalised in each layer.

    A vertex that nothing comes to counts as much as the whole layer before it: that is a step
    from each vertex there. So shares are products of layers, which are composed in blocks
    and normalised on the way. A layer after a gap begins anew.
    """
    keys = ["sample_id", "way", "run"]
    steps = _both_ways(written(edges, "edges"))
    at = steps.select("sample_id", "way", "position", F.col("src").alias("kmer")).union(steps.select("sample_id", "way", F.col("position") + 1, "dst")).distinct()
    order = F.row_number().over(Window.partitionBy("sample_id", "way").orderBy("position"))
    runs = at.select("sample_id", "way", "position").distinct().withColumn("run", F.col("position") - order)
    spans = written(runs.groupBy(*keys).agg(F.min("position").alias("lo"), (F.max("position") - 1).alias("hi")), "spans")
    at = written(at.join(runs, ["sample_id", "way", "position"]), "places")
    fed = steps.select("sample_id", "way", (F.col("position") + 1).alias("position"), F.col("dst").alias("kmer")).distinct()
    new = at.join(fed, ["sample_id", "way", "position", "kmer"], "left_anti").select(*keys, (F.col("position") - 1).alias("position"), F.col("kmer").alias("dst"))
    fresh = at.withColumnRenamed("kmer", "src").join(new, [*keys, "position"])
    known = steps.join(runs, ["sample_id", "way", "position"])
    every = known.select(*keys, "position", "src", "dst").unionByName(fresh.select(*keys, "position", "src", "dst")).withColumn("w", F.lit(1.0))
    start = at.join(spans, keys).where(F.col("position") == F.col("lo")).select(*keys, "lo", "hi", F.col("kmer").alias("vertex"), F.lit(1.0).alias("w"))
    levels = layers.compose(every, keys, spans, F.sum, scale=True)
    found = layers.states(levels, keys, start, F.sum, scale=True)
    share = found.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "position")))
    share = share.select("sample_id", (F.col("position") * F.col("way")).cast("int").alias("position"), F.col("vertex").alias("kmer"), "way", "w")
    of = lambda way: F.coalesce(F.max(F.when(F.col("way") == way, F.col("w"))), F.lit(0.0))
    return share.groupBy("sample_id", "position", "kmer").agg(of(1).alias("count_left"), of(-1).alias("count_right"))


def unitigs(edges: DataFrame, most: int = 64) -> DataFrame:
    """``edges`` with their unitig (its first edge) and the mean weight along it.

    An edge goes on from the one before if the vertex between has one edge on each side.
    Each round takes the predecessor's predecessor, so rounds follow the logarithm of the
    longest unitig; each is written to the checkpoint folder.
    """
    name = F.concat_ws("-", F.col("position").cast("string"), "src", "dst")
    into = edges.groupBy("sample_id", (F.col("position") + 1).alias("position"), F.col("dst").alias("kmer")).agg(F.count("*").alias("n_in"), F.first(name).alias("before"))
    out = edges.groupBy("sample_id", "position", F.col("src").alias("kmer")).agg(F.count("*").alias("n_out"))
    plain = into.join(out, [*LAYER, "kmer"]).where("n_in = 1 and n_out = 1").select(*LAYER, F.col("kmer").alias("src"), "before")
    named = edges.join(plain, [*LAYER, "src"], "left").withColumn("edge", name)
    links = cut(named.select("sample_id", "edge", F.coalesce("before", "edge").alias("top")))
    for _ in range(most):
        up = links.select("sample_id", F.col("edge").alias("top"), F.col("top").alias("higher"))
        links = cut(links.join(up, ["sample_id", "top"]).select("sample_id", "edge", F.col("higher").alias("top"), (F.col("higher") != F.col("top")).alias("moved")))
        if links.where("moved").isEmpty():
            break
    joined = named.join(links.select("sample_id", "edge", F.col("top").alias("unitig")), ["sample_id", "edge"])
    means = joined.groupBy("sample_id", "unitig").agg(F.avg("weight").alias("mean"))
    # a unitig may be as long as the sequence, so the means are joined, not broadcast
    return joined.join(means, ["sample_id", "unitig"]).select(*LAYER, "src", "dst", "weight", "unitig", "mean")


def unitig_error(unitigs: DataFrame) -> DataFrame:
    """(sample_id, error): what weighing each edge by its unitig's mean would change, squared."""
    return unitigs.groupBy("sample_id").agg(F.sum((F.col("mean") - F.col("weight")) ** 2).alias("error"))


def first_vertices(vertices: DataFrame) -> DataFrame:
    """(sample_id, kmer): where a sample's first path starts, its least k-mer at position 0."""
    return vertices.where("position = 0").groupBy("sample_id").agg(F.min("kmer").alias("kmer"))
