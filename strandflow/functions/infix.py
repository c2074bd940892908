"""Edit distance of a pattern to the best substring of a text, bit-parallel.

A column of the dynamic programming table is kept as its vertical differences, one bit for each
letter of the pattern in two words; a letter of the text takes a few word operations. Longer
patterns take several words, and the horizontal difference is carried from one to the next.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packed import let

#: Bits of a word that are used: sums of two words must not overflow.
BITS = 60
MASK = (1 << BITS) - 1


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _letters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _places(pattern: Column, words: Column) -> Column:
    """By letter of the pattern: words with a bit for each place that has it."""

    def of(letter: Column) -> Column:
        bit = lambda w: lambda found, b: F.when(F.substring(pattern, w * BITS + b + 1, F.lit(1)) == letter, found.bitwiseOR(F.call_function("shiftleft", _long(1), b))).otherwise(found)
        return F.transform(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), _long(0), bit(w)))

    return let(F.array_distinct(F.split(pattern, "")), lambda letters: F.map_from_arrays(letters, F.transform(letters, of)))


def _scan(pattern: Column, text: Column, anchored: bool) -> Column:
    """(best, end): the least distance of ``pattern``, which is not empty, to what ends at a
    place of ``text``, and the first such place; what is compared begins anywhere, or, if
    ``anchored``, where the text begins."""
    size = F.length(pattern)
    words = F.sequence(F.lit(0), F.floor((size - 1) / BITS).cast("int"))
    top = F.call_function("shiftleft", _long(1), ((size - 1) % BITS).cast("int"))

    def column(places: Column) -> Column:
        none = F.transform(words, lambda w: _long(0))
        start = F.struct(size.alias("score"), size.alias("best"), F.lit(0).alias("end"), F.lit(0).alias("at"), F.transform(words, lambda w: F.struct(_long(MASK).alias("p"), _long(0).alias("m"))).alias("column"))

        def letter(state: Column, c: Column) -> Column:
            def word(acc: Column, x: Column) -> Column:
                p, m, eq, h = x["x"]["p"], x["x"]["m"], x["eq"], acc["h"]
                down, up = F.when(h < 0, _long(1)).otherwise(_long(0)), F.when(h > 0, _long(1)).otherwise(_long(0))
                eq_in = eq.bitwiseOR(down)
                xv = eq.bitwiseOR(m)
                xh = (eq_in.bitwiseAND(p) + p).bitwiseXOR(p).bitwiseOR(eq_in)
                ph = m.bitwiseOR(F.bitwise_not(xh.bitwiseOR(p))).bitwiseAND(_long(MASK))
                mh = p.bitwiseAND(xh).bitwiseAND(_long(MASK))
                last = F.when(F.size(acc["column"]) == F.size(words) - 1, top).otherwise(_long(1 << BITS - 1))
                out = F.when(ph.bitwiseAND(last) != 0, 1).when(mh.bitwiseAND(last) != 0, -1).otherwise(0)
                ph2 = F.shiftleft(ph, 1).bitwiseAND(_long(MASK)).bitwiseOR(up)
                mh2 = F.shiftleft(mh, 1).bitwiseAND(_long(MASK)).bitwiseOR(down)
                made = F.struct(mh2.bitwiseOR(F.bitwise_not(xv.bitwiseOR(ph2))).bitwiseAND(_long(MASK)).alias("p"), ph2.bitwiseAND(xv).alias("m"))
                return F.struct(out.alias("h"), F.concat(acc["column"], F.array(made)).alias("column"))

            both = F.zip_with(state["column"], F.coalesce(F.try_element_at(places, c), none), lambda x, eq: F.struct(x.alias("x"), eq.alias("eq")))
            begin = F.struct(F.lit(1 if anchored else 0).alias("h"), F.slice(state["column"], 1, 0).alias("column"))

            def took(step: Column) -> Column:
                score, at = state["score"] + step["h"], state["at"] + 1
                better = score < state["best"]
                return F.struct(score.alias("score"), F.when(better, score).otherwise(state["best"]).alias("best"), F.when(better, at).otherwise(state["end"]).alias("end"), at.alias("at"), step["column"].alias("column"))

            return let(F.aggregate(both, begin, word), took)

        return F.aggregate(_letters(text), start, letter, lambda s: F.struct(s["best"].alias("best"), s["end"].alias("end")))

    return let(_places(pattern, words), column)


def infix_match(pattern: str, text: str) -> Column:
    """(distance, start): the least edit distance of ``pattern`` to a substring of ``text``, and
    where its best match begins: of several the one that ends first, and of those the
    shortest, which a second scan from that end backwards finds."""
    p, t = F.col(pattern), F.col(text)

    def back(found: Column) -> Column:
        ahead = F.reverse(F.left(t, found["end"]))
        near = F.left(ahead, F.length(p) + found["best"])
        return let(_scan(F.reverse(p), near, True), lambda b: F.struct(found["best"].cast("bigint").alias("distance"), (found["end"] - b["end"]).cast("bigint").alias("start")))

    empty = F.struct(_long(0).alias("distance"), _long(0).alias("start"))
    return F.when(F.length(p) == 0, empty).when(p.isNotNull() & t.isNotNull(), let(_scan(p, t, False), back))
