"""Long repeated byte strings, found in suffix arrays of the places that can hold them.

Each string of SPAN bytes holds grams of GRAM bytes; the one with the least hash, the leftmost of
equals, is its anchor. Equal strings have equal anchors at equal places. The strings of a text
that have their anchor in common are neighbours: a segment. Segments with the same bytes are
counted by a digest. What is left are different segments around the same anchor: their bytes are
fetched, and the suffixes of all of them are sorted in two stages. Suffixes smaller than their
successors are sorted directly; the rest is induced, bucket by bucket, as a suffix that is larger
than its successor stands in its bucket in the order of those successors. Neighbours in that
order with SPAN bytes in common are repeated strings.

An anchor with very many different segments is taken apart first: segments are halved by the
distance from string to anchor, and the halves meet only where the bytes that all strings of
that distance have in common agree. At the last halving one string is left in each part, so
equal ones have been counted and no group is ever large.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, bound_batches, hot_keys, materialise, release, salted_join, spans, utf8

#: The length of a repeated string, and of the grams that are its anchors.
SPAN, GRAM = 400, 64
#: Places that a string has for its anchor, and a power of two that covers them.
REACH = SPAN - GRAM + 1
WIDTH = 512
#: Bytes of text that are hashed at once, and of segments that are sorted at once.
CHUNK, SORTED = 1 << 18, 1 << 20
#: Different segments of an anchor that are sorted together.
MOST_SEGMENTS = 1_024

_rng = np.random.Generator(np.random.PCG64(11))
BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, as many as a chunk needs."""
    if not _POWERS:
        for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
            x = np.full(CHUNK + SPAN + 1, b, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS


@np.errstate(over="ignore")
def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    power, inverse = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * power[: len(raw)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(raw) - GRAM + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _anchors(h: np.ndarray) -> np.ndarray:
    """For each start the place of the least of the next REACH hashes, the leftmost of equals."""
    size = len(h)
    place = np.uint64((1 << 20) - 1)  # a chunk has fewer places
    key = np.full(-(-size // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
    key[:size] = (h & ~place) | np.arange(size, dtype=np.uint64)
    blocks = key.reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = size - REACH + 1
    return (np.minimum(behind[:n], ahead[REACH - 1 : REACH - 1 + n]) & place).astype(np.int64)


def _stretches(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, end, offsets of rows within) of stretches of about CHUNK bytes; a longer
    text comes in pieces that overlap, so that every string is whole in one of them."""
    for i, j in spans(offsets, CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= CHUNK:
            yield lo, hi, offsets[i : j + 1]
            continue
        for at in range(lo, max(hi - SPAN + 1, lo + 1), CHUNK):
            yield at, min(at + CHUNK + SPAN - 1, hi), offsets[i : j + 1]


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, at, strings, before, anchor, content) of the segments of all rows."""
    for lo, hi, cuts in _stretches(offsets):
        if hi - lo < SPAN:
            continue
        raw = data[lo:hi]
        h = _gram_hashes(raw)
        anchor = _anchors(h)
        n = hi - lo - SPAN + 1
        row = np.searchsorted(cuts, np.arange(lo, lo + n), side="right") - 1
        whole = cuts[row + 1] - lo - SPAN >= np.arange(n)
        starts = np.flatnonzero(whole)
        if not len(starts):
            continue
        of = row[starts], anchor[starts]
        new = np.concatenate([[True], (np.diff(of[0]) != 0) | (np.diff(of[1]) != 0)])
        first = starts[new]
        last = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
        text = raw.tobytes()
        content = [blake2b(text[a : b + SPAN], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        r = row[first]
        shift = np.searchsorted(offsets, cuts[0])
        yield r + shift, first + lo - cuts[r], last - first + 1, anchor[first] - first, h[anchor[first]].view(np.int64), content


def segments(docs: DataFrame) -> DataFrame:
    """(ref, doc_id, at, strings, before, grp, content) of every row of ``docs`` (doc_id, ref,
    text): the segments' first strings, how many follow on each other, and how far the
    first is before its anchor."""
    bound_batches(docs.sparkSession)
    schema = "ref binary, doc_id bigint, at int, strings int, before int, grp bigint, content binary"
    names = ["ref", "doc_id", "at", "strings", "before", "grp", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for row, at, many, before, anchor, content in _segments(data, offsets):
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("ref").take(of), batch.column("doc_id").take(of), *[pa.array(x.astype(np.int32)) for x in (at, many, before)], pa.array(anchor), pa.array(content, pa.binary())], names=names)
        release()

    return docs.select("doc_id", "ref", "text").mapInArrow(run, schema)


# --- suffix arrays


def _larger(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than its successor. An end mark, 0, is the least
    symbol; in a run of equal symbols what follows the run decides."""
    ends = np.concatenate([np.flatnonzero(np.diff(symbols)), [len(symbols) - 1]])
    follows = np.concatenate([symbols[ends[:-1] + 1], [-1]])
    return np.repeat(symbols[ends] > follows, np.diff(np.concatenate([[-1], ends])))


def suffix_order(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all strings of SPAN bytes in order, as places in the pieces with an end
    mark after each; and the places where the pieces start.

    Strings with SPAN bytes in common are neighbours; which of them is first is open.
    """
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    raw = b"\0".join([*pieces, b""])
    symbols = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    stop = begin + sizes
    symbols[stop] = 0
    larger = _larger(symbols)
    # strings, and behind the last string of a piece what its order is induced from
    settled = np.flatnonzero(~larger | (symbols == 0))
    last = stop - SPAN
    upto = settled[np.searchsorted(settled, last)]
    edge = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, upto + 1, -1)
    wanted = np.cumsum(edge)[:-1] > 0
    # first stage: suffixes smaller than their successors
    direct = np.flatnonzero(wanted & ~larger & (symbols > 0))
    limit = np.minimum(direct + SPAN, stop[np.searchsorted(stop, direct)])
    keys = [raw[a:b] for a, b in zip(direct.tolist(), limit.tolist(), strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    cuts = np.searchsorted(symbols[direct], np.arange(258))
    # second stage: bucket by bucket, the others in the order of their successors
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    induced[0].append(np.flatnonzero(wanted & (symbols == 0)))
    out = []
    for c in range(257):
        bucket = list(induced[c])
        wave = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        while c and len(wave):  # runs of the bucket's own symbol
            wave = wave[wave > 0] - 1
            wave = wave[(symbols[wave] == c) & wanted[wave]]
            bucket.append(wave)
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[(symbols[before] > c) & wanted[before]]
        if len(before):
            of = symbols[before]
            order = np.argsort(of, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0]))
            for part in np.split(before[order], at[1:]):
                induced[symbols[part[0]]].append(part)
        induced[c] = []
    ordered = np.concatenate(out)
    is_string = ordered <= last[np.searchsorted(stop, ordered)]
    return ordered[is_string], begin


def repeated(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, which of its strings of SPAN bytes are there twice or more."""
    ordered, begin = suffix_order(pieces)
    raw = b"\0".join([*pieces, b""])
    word = np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))
    one, two = ordered[:-1], ordered[1:]
    alike = np.arange(len(one))
    for k in range(0, SPAN, 8):  # the common prefixes of neighbours, as far as they matter
        alike = alike[word[one[alike] + k] == word[two[alike] + k]]
    flag = np.zeros(len(raw), bool)
    flag[one[alike]] = flag[two[alike]] = True
    return [flag[b : b + len(p) - SPAN + 1] for b, p in zip(begin.tolist(), pieces, strict=True)]


def _runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """(ref, start, stop): bytes of ``rows`` (grp, n, ref, at, bytes) that a repeated string
    covers, of rows that are there once (n). Groups are whole in one task, which sorts as
    many together as fit in SORTED bytes."""
    bound_batches(rows.sparkSession)

    def settle(held: list[tuple[int, int, bytes, int, bytes]]) -> Iterator[pa.RecordBatch]:
        found = []
        for (_, n, ref, at, _), flag in zip(held, repeated([h[4] for h in held]), strict=True):
            found += [(ref, at + a, at + b - 1 + SPAN) for a, b in _runs(flag)] if n == 1 else []
        if found:
            ref, start, stop = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ref, pa.binary()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["ref", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("grp", "n", "ref", "at", "bytes")], strict=True):
                if size > SORTED and row[0] != held[-1][0]:
                    yield from settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from settle(held)
        release()

    dealt = rows.select("grp", "n", "ref", "at", "bytes").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "ref binary, start int, stop int")


# --- the job


def _shared(rows: DataFrame, weight, name: str) -> DataFrame:
    """``rows`` (grp, content, ..) of groups with two rows or more, with n, the weight of
    their content, and m, the different contents of their group."""
    contents = materialise(rows.groupBy("content").agg(F.sum(weight).alias("n"), F.min("grp").alias("grp")), f"{name}-contents")
    groups = contents.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("total > 1")
    total = contents.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wide = hot_keys(groups.select("grp", F.col("m").alias("n")), "grp", total)
    known = materialise(salted_join(contents, groups.select("grp", "m"), "grp", wide).select("content", "n", "m"), f"{name}-known")
    was = rows.select(*[c for c in rows.columns if c != "n"], weight.alias("was"))
    return materialise(salted_join(was, known, "content", hot_keys(known.select("content", "n"), "content", total)), name)


def _bytes_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (content, grp, n, m, ref, doc_id, at, strings, before) with their bytes. Each
    names one row's text, and a text's places follow its length."""
    listed = places.groupBy("ref", "doc_id").agg(F.collect_list(F.struct("content", "grp", "n", "m", "at", "strings", "before")).alias("places"))
    listed = listed.select(F.col("ref").alias("_ref"), F.col("doc_id").alias("_doc"), "places")
    rows = docs.join(listed, (F.col("ref") == F.col("_ref")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("ref", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for k, (ref, places) in enumerate(zip(batch.column("ref"), batch.column("places"), strict=True)):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                fields = places.values
                cut = [text[a : a + s - 1 + SPAN] for a, s in zip(fields.field("at").to_pylist(), fields.field("strings").to_pylist(), strict=True)]
                columns = [fields.field(c) for c in ("content", "grp", "n", "m", "at", "before")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([ref.as_py()] * len(cut), pa.binary()), pa.array(cut, pa.binary())], names=["content", "grp", "n", "m", "at", "before", "ref", "bytes"])
        release()

    made = rows.mapInArrow(run, "content binary, grp bigint, n bigint, m bigint, at int, before int, ref binary, bytes binary")
    return made.dropDuplicates(["content"])  # an id may be there twice with one text


def _halved(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (grp, ref, at, before, bytes, n) cut by their strings' distance to the anchor in
    parts of ``width``; a part's group is known by the bytes that its strings all have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grp, ref, at, before, raw, n in zip(*[batch.column(c).to_pylist() for c in ("grp", "ref", "at", "before", "bytes", "n")], strict=True):
                low = before - (len(raw) - SPAN)
                for part in range(low // width, before // width + 1):
                    far, near = min(before, (part + 1) * width - 1), max(low, part * width)
                    common = raw[before - part * width : before - (part + 1) * width + 1 + SPAN]
                    piece = raw[before - far : before - near + SPAN]
                    name = blake2b(f"{grp} {width} {part} ".encode() + common, digest_size=8).digest()
                    out.append((int.from_bytes(name, "little", signed=True), blake2b(piece, digest_size=16).digest(), ref, at + before - far, far, piece, n))
            if out:
                grp, content, ref, at, before, piece, n = zip(*out, strict=True)
                arrays = [pa.array(grp, pa.int64()), pa.array(content, pa.binary()), pa.array(ref, pa.binary()), pa.array(at, pa.int32()), pa.array(before, pa.int32()), pa.array(piece, pa.binary()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["grp", "content", "ref", "at", "before", "bytes", "n"])
        release()

    return rows.select("grp", "ref", "at", "before", "bytes", "n").mapInArrow(run, "grp bigint, content binary, ref binary, at int, before int, bytes binary, n bigint")


def repeated_bytes(docs: DataFrame, copied: DataFrame, copied_hot: DataFrame | None) -> DataFrame:
    """(ref, start, stop): bytes of the texts of ``docs`` (doc_id, ref, text) that repeated
    strings cover, in no order and overlapping; without those of ``copied`` (ref) texts."""
    parts = materialise(segments(docs.where(F.octet_length("text") >= SPAN)), "segments")
    shared = _shared(parts, F.lit(1), "shared")
    covered = lambda df, strings: df.select("ref", F.col("at").alias("start"), (F.col("at") + strings - 1 + SPAN).alias("stop"))
    twice = salted_join(shared.where("n > 1").select("ref", "at", "strings"), copied, "ref", copied_hot, "left_anti")
    found = [covered(twice, F.col("strings"))]
    apart = shared.where("m > 1").select("content", "grp", "n", "m", "ref", "doc_id", "at", "strings", "before").dropDuplicates(["content"])
    rows = materialise(_bytes_of(docs, apart), "pieces")
    width = WIDTH
    while True:
        found.append(_sorted_groups(rows.where((F.col("m") > 1) & (F.col("m") <= MOST_SEGMENTS))))
        large = rows.where(F.col("m") > MOST_SEGMENTS)
        if large.isEmpty():
            break
        width //= 2
        halves = materialise(_halved(large, width), "halves")
        shared = _shared(halves, F.col("n"), "shared")
        met = shared.where("was = 1 and n > 1")
        found.append(covered(met, F.octet_length("bytes") - SPAN + 1))
        rows = materialise(shared.where("m > 1").select("content", "grp", "n", "m", "at", "before", "ref", "bytes").dropDuplicates(["content"]), "pieces")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, stop in bytes, maximal and in order) and kept
    (binary, the other bytes) of every row of ``docs``.

    A byte is removed if a string of SPAN bytes that starts anywhere else as well covers it,
    in this text or another; what is removed elsewhere doesn't matter. Texts are UTF-8,
    null is empty, shorter ones stay. Whole texts of any length; rows that repeat are copies
    of each other, null ids stay as given, other columns are not read, an empty table gives an
    empty result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("ref", F.unhex(F.md5("text")))
    rows = materialise(texts.select("ref"), "digests")
    counts = rows.groupBy("ref").agg(F.count("*").alias("n"))
    copied = materialise(counts.where("n > 1"), "copied")
    total = rows.count()
    hot = hot_keys(copied, "ref", total)
    covered = repeated_bytes(texts, copied.select("ref"), hot)
    listed = covered.groupBy("ref").agg(F.collect_list(F.struct("start", "stop")).alias("covered"), F.lit(False).alias("copy"))
    # a copied text is repeated from end to end; its bytes may have been found besides
    known = listed.join(copied.select("ref"), "ref", "left_anti").unionByName(copied.select("ref", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("covered"), F.lit(True).alias("copy")))
    both = salted_join(texts, materialise(known, "covered"), "ref", hot, "left", by=("doc_id",))

    def make(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        cuts, kept = [], []
        for k, (places, copy) in enumerate(zip(batch.column("covered"), batch.column("copy").to_pylist(), strict=True)):
            text = data[offsets[k] : offsets[k + 1]]
            gone = np.zeros(len(text) + 1, np.int64)
            if copy and len(text) >= SPAN:
                gone[0] = 1
            elif not copy and places.is_valid:
                np.add.at(gone, np.asarray(places.values.field("start")), 1)
                np.add.at(gone, np.asarray(places.values.field("stop")), -1)
            mask = np.cumsum(gone)[:-1] > 0
            cuts.append([{"start": a, "stop": b} for a, b in _runs(mask)])
            kept.append(text[~mask].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.array(offsets[1:] - offsets[:-1]), pa.array(cuts, kind), pa.array(kept, pa.binary())

    fields = [("n_bytes", "bigint"), ("removed", "array<struct<start:bigint,stop:bigint>>"), ("kept", "binary")]
    return add_columns(both.select("doc_id", "text", "covered", "copy"), fields, make, without=("text", "covered", "copy"))
