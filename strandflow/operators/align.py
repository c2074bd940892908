"""Alignment of reads to a reference, and the coverage check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packed
from ..functions.sequence import MATCH, MISMATCH, hamming, orientations
from .lineage import spread


#: Parts into which a sample's reads are dealt.
SALTS = 16


def _best(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The best place: highest score, then the first orientation, then the largest start."""
    rank = F.max(F.struct("score", (-F.col("orientation")).alias("o"), "start", "oriented")).alias("m")
    return scored.groupBy(*keys).agg(rank).select(*keys, *_spread("m"))


def _spread(m: str) -> list[Column]:
    full = F.col(f"{m}.score") == MATCH * F.length(f"{m}.oriented")
    return [F.col(f"{m}.oriented").alias("oriented"), F.col(f"{m}.start").alias("start"), (-F.col(f"{m}.o")).alias("orientation"), F.col(f"{m}.score").alias("score"), full.alias("full")]


def _by_letters(read: str, seq: str) -> Column:
    """(score, o, start, oriented) of a read's best place on a sequence, letter by letter: for
    letters besides A, C, G and T."""
    size, room = F.length(read), F.length(seq) - F.length(read)

    def along(bases: Column) -> Column:
        def of(oriented: Column, turn: Column) -> Column:
            def at(letters: Column) -> Column:
                def scored(i: Column) -> Column:
                    same = F.zip_with(letters, F.slice(bases, i + 1, size), lambda x, y: (x == y).cast("int"))
                    hits = F.aggregate(same, F.lit(0), lambda n, x: n + x)
                    return F.struct((hits * (MATCH - MISMATCH) + size * MISMATCH).alias("score"), (-turn).alias("o"), i.alias("start"))

                return F.array_max(F.transform(F.sequence(F.lit(0), room), scored))

            best = packed.let(F.split(oriented, ""), at)
            return F.struct(best["score"].alias("score"), best["o"].alias("o"), best["start"].alias("start"), oriented.alias("oriented"))

        return F.array_max(F.transform(orientations(read), of))

    return packed.let(F.split(seq, ""), along)


def best_place(read: str, places: str) -> Column:
    """(score, o, start, oriented) of a read's best place on a sequence: every orientation at
    every offset is scored inside the row, so nothing is exploded and nothing shuffled.

    ``places``: the packed word at each place of the sequence. Two words are compared by xor and
    a bit count, 32 bases at once.
    """
    size = F.length(read)

    def of(oriented: Column, turn: Column) -> Column:
        def at(words: Column) -> Column:
            def scored(i: Column) -> Column:
                wrong = packed.mismatches_at(words, size, F.col(places), i)
                return F.struct((size * MATCH - wrong * (MATCH - MISMATCH)).alias("score"), (-turn).alias("o"), i.alias("start"))

            return F.array_max(F.transform(F.sequence(F.lit(0), F.size(places) - size), scored))

        best = packed.let(packed.pack(oriented), at)
        return F.struct(best["score"].alias("score"), best["o"].alias("o"), best["start"].alias("start"), oriented.alias("oriented"))

    return F.array_max(F.transform(orientations(read), of))


def align(reads: DataFrame, references: DataFrame) -> DataFrame:
    """(sample_id, read, oriented, start, orientation, score, full) per distinct read.

    Scores each orientation at each offset. Distinct reads are aligned once; empty reads,
    reads longer than the reference and null reads have no place and are left out. Few
    bytes are much work here, so the reads of each sample are dealt to SALTS parts, with a copy
    of its reference in each, and these to a stated number of tasks.
    """
    salt = F.pmod(F.xxhash64("read"), F.lit(SALTS)).cast("int").alias("_salt")
    distinct = reads.where(F.length("read") > 0).select("sample_id", "read").distinct().select("sample_id", "read", salt)
    known = references.select("sample_id", "seq", F.when(packed.packable("seq"), packed.word_at_each("seq")).alias("places"))
    known = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    pairs = spread(distinct, "sample_id", "_salt").join(spread(known, "sample_id", "_salt"), ["sample_id", "_salt"]).where(F.length("read") <= F.length("seq"))
    plain = packed.packable("read") & F.col("places").isNotNull()
    place = F.when(plain, best_place("read", "places")).otherwise(_by_letters("read", "seq"))
    return pairs.select("sample_id", "read", place.alias("m")).select("sample_id", "read", *_spread("m"))


def align_seeded(reads: DataFrame, references: DataFrame, mismatches: int = 3) -> DataFrame:
    """The same as ``align``, for long references: first by an index of blocks.

    A read cut into ``mismatches`` + 1 blocks has one without a mismatch at each place with at
    most that many, so an equi-join of blocks with the reference's pieces of the same size
    finds all such places, exactly. The best of them is the read's best; reads without one,
    and those with fewer bases than blocks, are aligned at all offsets.
    """
    parts = mismatches + 1
    distinct = reads.where(F.length("read") > 0).select("sample_id", "read").distinct()
    turned = distinct.where(F.length("read") >= parts).select("sample_id", "read", F.posexplode(orientations("read")).alias("orientation", "oriented"))
    size = F.floor(F.length("read") / parts).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct((k * size).cast("int").alias("at"), F.substring("oriented", (k * size + 1).cast("int"), size).alias("block")))
    left = turned.select("sample_id", "read", "orientation", "oriented", F.inline(blocks))
    sizes = turned.select("sample_id", size.alias("size")).distinct()
    index = references.join(sizes, "sample_id").where(F.length("seq") >= F.col("size"))
    piece = F.transform(F.sequence(F.lit(0), F.length("seq") - F.col("size")), lambda i: F.struct(i.alias("ref_at"), F.substring("seq", i + 1, F.col("size")).alias("block")))
    right = index.select("sample_id", F.inline(piece))
    start = F.col("ref_at") - F.col("at")
    found = left.join(right, ["sample_id", "block"]).where(start >= 0).select("sample_id", "read", "orientation", "oriented", start.alias("start")).distinct()
    placed = found.join(references.select("sample_id", "seq"), "sample_id")
    inside = placed.withColumn("piece", F.substring("seq", F.col("start") + 1, F.length("oriented"))).where(F.length("piece") == F.length("oriented")).drop("seq")
    plain = packed.packable("oriented") & packed.packable("piece")
    wrong = F.when(plain, packed.mismatches(packed.pack("oriented"), packed.pack("piece"))).otherwise(hamming("oriented", "piece"))
    near = inside.withColumn("wrong", wrong).where(F.col("wrong") <= mismatches)
    seeded = _best(near.withColumn("score", MATCH * F.length("read") - (MATCH - MISMATCH) * F.col("wrong")), ["sample_id", "read"])
    rest = align(distinct.join(seeded.select("sample_id", "read"), ["sample_id", "read"], "left_anti"), references)
    return seeded.unionByName(rest)


def from_cache(lines: DataFrame, references: DataFrame) -> DataFrame:
    """Alignments from ``read start`` lines (sample_id, value) within the reference's end."""
    part = F.split("value", " ")
    rows = lines.select("sample_id", F.get(part, F.lit(0)).alias("read"), F.get(part, F.lit(1)).cast("int").alias("start")).where(F.length("read") > 0)
    kept = rows.join(references.select("sample_id", "seq"), "sample_id").where((F.col("start") >= 0) & (F.col("start") + F.length("read") <= F.length("seq")))
    return kept.select("sample_id", "read", "start", (F.substring("seq", F.col("start") + 1, F.length("read")) == F.col("read")).alias("full"))


def coverage_gaps(alignments: DataFrame, k: int) -> DataFrame:
    """Neighbouring places, by start, that overlap in fewer than k bases."""
    stop = F.col("start") + F.length("read")
    places = alignments.select("sample_id", "start", stop.alias("stop")).groupBy("sample_id", "start").agg(F.max("stop").alias("stop"))
    before = F.lag("stop").over(Window.partitionBy("sample_id").orderBy("start"))
    return places.withColumn("before", before).where(F.col("start") > F.col("before") - k + 1)
