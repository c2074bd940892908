"""Column functions on sequences over ACGT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, MISMATCH = 5, -4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(seq: Column | str) -> Column:
    """A with T and C with G exchanged; other characters stay."""
    return F.translate(_col(seq), "ACGT", "TGCA")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def orientations(seq: Column | str) -> Column:
    """The four ways to read a sequence; their order settles ties."""
    s = _col(seq)
    return F.array(s, complement(s), F.reverse(s), reverse_complement(s))


def base_index(base: Column | str) -> Column:
    """0 to 3 for A, C, G, T; an error for anything else."""
    at = F.instr(F.lit("ACGT"), _col(base)) - 1
    return F.when((at >= 0) & (F.length(_col(base)) == 1), at).otherwise(F.raise_error(F.concat(F.lit("Unknown nucleotide "), F.coalesce(_col(base), F.lit("null")))).cast("int"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing places over the length of ``a``; an error if ``b`` is shorter, while
    what ``b`` has beyond is ignored. Null if either is null."""
    a, b = _col(a), _col(b)
    other = F.split(F.substring(b, F.lit(1), F.length(a)), "")
    differ = F.aggregate(F.zip_with(F.split(a, ""), other, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, x: n + x)
    short = F.raise_error(F.lit("the second sequence is shorter")).cast("int")
    return F.when(F.length(b) < F.length(a), short).when(F.length(a) == 0, 0).otherwise(differ)


def ungapped_score(a: Column | str, b: Column | str) -> Column:
    """+5 for each match and -4 for each mismatch, without gaps."""
    return F.length(_col(a)) * MATCH - (MATCH - MISMATCH) * hamming(a, b)


def windows(seq: Column | str, size: int, least: int = 0) -> Column:
    """The start (from 0) of each window of ``size``; empty for shorter sequences."""
    n = F.length(_col(seq)) - size
    return F.when(n >= least, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def path_edges(seq: Column | str, k: int) -> Column:
    """(position, src, dst) of each step of the path that spells ``seq``."""
    s = _col(seq)
    piece = lambda i: F.struct(i.alias("position"), F.substring(s, i + 1, F.lit(k)).alias("src"), F.substring(s, i + 2, F.lit(k)).alias("dst"))
    return F.transform(windows(s, k + 1), piece)


def path_sequence(kmers: Column | str) -> Column:
    """The sequence that a walk of k-mers spells."""
    v = _col(kmers)
    last = F.array_join(F.transform(v, lambda x: F.right(x, F.lit(1))), "")
    return F.concat(F.left(F.get(v, F.lit(0)), F.length(F.get(v, F.lit(0))) - 1), last)


def splice(seq: Column | str, piece: Column | str, start: Column | str) -> Column:
    """``seq`` with ``piece`` laid over it from ``start`` (from 0) on."""
    return F.overlay(_col(seq), _col(piece), _col(start) + 1)


def fill_gaps(seq: Column | str, reference: Column | str) -> Column:
    """Each ``-`` replaced by the reference's base at the place."""
    pairs = F.zip_with(F.split(_col(seq), ""), F.split(F.substring(_col(reference), F.lit(1), F.length(_col(seq))), ""), lambda c, r: F.when(c == "-", r).otherwise(c))
    return F.array_join(pairs, "")


def wrap(seq: Column | str, width: int = 70) -> Column:
    """The sequence in lines of ``width``, as FASTA files have it."""
    s = _col(seq)
    starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(width))
    return F.array_join(F.transform(starts, lambda i: F.substring(s, i + 1, F.lit(width))), "\n")
