"""Sequences over ACGT as 64-bit words, two bits a base, compared by xor and bit counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases of a word, and the low bit of each of them.
BASES = 32
LOW_BITS = 0x5555555555555555


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def packable(seq: Column | str) -> Column:
    """Whether a sequence has no letters but A, C, G and T."""
    return F.length(F.translate(_col(seq), "ACGT", "")) == 0


def _word(digits: Column, at: Column) -> Column:
    """The word of up to BASES digits from place ``at`` (from 0) on, filled up with A."""
    return F.conv(F.rpad(F.substring(digits, at + 1, F.lit(BASES)), BASES, "0"), 4, -10).cast("bigint")


def pack(seq: Column | str) -> Column:
    """The words of a sequence over ACGT, one after the other; none of an empty one."""
    s = _col(seq)
    starts = F.when(F.length(s) > 0, F.sequence(F.lit(0), F.length(s) - 1, F.lit(BASES))).otherwise(F.array().cast("array<int>"))
    return let(F.translate(s, "ACGT", "0123"), lambda digits: F.transform(starts, lambda at: _word(digits, at)))


def word_at_each(seq: Column | str) -> Column:
    """The word that begins at each place of a sequence over ACGT."""
    s = _col(seq)
    starts = F.when(F.length(s) > 0, F.sequence(F.lit(0), F.length(s) - 1)).otherwise(F.array().cast("array<int>"))
    return let(F.translate(s, "ACGT", "0123"), lambda digits: F.transform(starts, lambda at: _word(digits, at)))


def _differing(x: Column, y: Column) -> Column:
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(LOW_BITS)))


def mismatches(a: Column, b: Column) -> Column:
    """Differing bases of two packed sequences of the same length."""
    return F.aggregate(F.zip_with(a, b, _differing), F.lit(0), lambda n, x: n + x)


def mismatches_at(words: Column, size: Column, places: Column, at: Column) -> Column:
    """Differing bases of a packed sequence of ``size`` bases and what ``places``, the words
    at each place of a longer one, has from ``at`` on."""

    def one(k: Column) -> Column:
        left = F.least(size - k * BASES, F.lit(BASES))  # bases of this word that count
        d = F.get(words, k).bitwiseXOR(F.get(places, at + k * BASES))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(LOW_BITS)).bitwiseAND(_top(left)))

    return F.when(size <= BASES, one(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), F.lit(0), lambda n, k: n + one(k)))


def _top(bases: Column) -> Column:
    """A mask of the first ``bases`` bases of a word."""
    masks = [-1 << 2 * (BASES - n) if n else 0 for n in range(BASES + 1)]
    return F.get(F.array(*[F.lit(m).cast("bigint") for m in masks]), bases)
