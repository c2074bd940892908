"""Two tokenizers' tokens of the same texts, aligned by the bytes that they stand for.

Both tokenizers always cut a text at a single space between two other characters (neither
has a token that goes on past one), so a text is cut there into segments, and each distinct
segment is aligned once. The alignment is an Arrow pipeline: token lists flattened with
the index of their segment, byte lengths summed up within each segment, and the ends of both
sides hash-joined on (segment, end). An end that both have closes a group. Between two
neighbouring ends of either side lies exactly one pair of overlapping tokens: a link.

How many documents hold a pair of ids is counted batch by batch in ``Table.group_by``
and merged by Spark.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, bound_batches, hot_keys, materialise, release, salted_join, utf8
from .token_counts import plain_normaliser

#: Segments that a worker remembers, and their characters in all; beyond it the half that
#: was met most often stays.
MEMO_SEGMENTS, MEMO_CHARS = 300_000, 6 << 20
#: Links of a batch that are counted at once.
MOST_LINKS = 1 << 20
#: Id pairs that are broadcast with their counts (24 bytes each); beyond it links meet them
#: by a join. Partial counts that a task holds before it hands them on.
MOST_PAIRS, MOST_PARTIAL = 2_000_000, 500_000

#: Fixed value: how byte-level vocabularies of this kind split texts before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where both tokenizers cut: a space with something else than white space on either side.
CUT = re.compile(r"(?<=\S) (?=\S)")


class Segments:
    """Aligned segments, by a number for each distinct one that is remembered."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        names, self.encode_a = _byte_level(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size_a, size_b = len(names), self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        # segments are only independent if no piece goes on past a space
        self.cuts = plain_normaliser(b_path) and not any("▁" in p.lstrip("▁") for p in pieces)
        byte_of = _byte_letters()
        self.a_bytes = pa.array([bytes(byte_of.get(c, 0) for c in t) for t in names], pa.binary())
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.binary())
        self.decimal = pa.array([str(i) for i in range(max(size_a, size_b))])
        self.size_b = size_b
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars, self.used = 0, np.zeros(0, np.int64)
        self.names: list[str] = []
        self.good, self.sizes, self.links, self.offsets = np.zeros(0, bool), np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def cut(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the segments of all ``texts``, and how many each text has."""
        if len(self.number) > MEMO_SEGMENTS or self.chars > MEMO_CHARS:
            self.forget()
        number, at, counts = self.number, [], []
        for text in texts:
            parts = self.cut(text) if text else []
            at += [number.setdefault(p, len(number)) for p in parts]
            counts.append(len(parts))
        known = len(self.names)
        if len(number) > known:
            new = list(number)[known:] if known else list(number)
            self.chars += sum(map(len, new))
            self.align(new)
        at = np.array(at, np.int64)
        met = np.bincount(at, minlength=len(self.names))
        met[: len(self.used)] += self.used
        self.used = met
        return at, np.array(counts, np.int64)

    def forget(self) -> None:
        """Keep the half that was met most often, of those that were met again."""
        keep = np.flatnonzero(self.used > 1)
        keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: MEMO_SEGMENTS // 2]])
        held = list(self.number)
        if sum(len(held[i]) for i in keep.tolist()) > MEMO_CHARS // 2:
            return self.clear()
        self.number = {held[i]: k for k, i in enumerate(keep.tolist())}
        self.chars = sum(map(len, self.number))
        self.names = [self.names[i] for i in keep.tolist()]
        n = np.diff(self.offsets)[keep]
        self.links = self.links[np.repeat(self.offsets[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.offsets = np.concatenate([[0], np.cumsum(n)])
        self.good, self.sizes, self.used = self.good[keep], self.sizes[keep], self.used[keep] // 2

    def align(self, new: list[str]) -> None:
        """Tokens, groups and links of segments, each taken with the space before it."""
        a = self.encode_a([" " + s for s in new])
        b = self.b.encode(new, num_threads=1)
        raw, ends = utf8(pa.array([" " + s for s in new]))
        (a_ids, a_at, a_end, a_bytes, a_size), (b_ids, b_at, b_end, b_bytes, b_size) = (_ends(x, table, len(new)) for x, table in ((a, self.a_bytes), (b, self.b_bytes)))
        length = np.diff(ends)
        good = (a_size == length) & (b_size == length)
        if not good.all() or not np.array_equal(a_bytes, raw) or not np.array_equal(b_bytes, raw):
            joined = [[b"".join(table[i].as_py() for i in ids) for ids in x] for x, table in ((a, self.a_bytes), (b, self.b_bytes))]
            good = np.array([(" " + s).encode() == x == y for s, x, y in zip(new, *joined, strict=True)])
        keep_a, keep_b = good[a_at], good[b_at]
        segment = np.int64(1) << np.int64(32)
        one = pa.table({"end": a_at[keep_a] * segment + a_end[keep_a], "a": a_ids[keep_a]})
        two = pa.table({"end": b_at[keep_b] * segment + b_end[keep_b], "b": b_ids[keep_b]})
        both = one.join(two, "end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
        at = np.asarray(both["end"]) >> 32
        shared = np.asarray(pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"])))
        link_a, link_b = (np.asarray(pc.fill_null_backward(both[c])).astype(np.int64) for c in ("a", "b"))
        # the tokens before the first shared end are in the first group, and so on
        group = np.cumsum(shared) - shared
        lists = []
        for c in ("a", "b"):
            there = np.asarray(pc.is_valid(both[c]))
            counts = np.bincount(group[there], minlength=int(shared.sum()))
            text = self.decimal.take(both[c].combine_chunks().drop_null())
            lists.append(pc.binary_join(_lists(counts, text), ","))
        groups = np.bincount(at[shared], minlength=len(new))
        names = pc.binary_join(_lists(groups, pc.binary_join_element_wise(*lists, "|")), ";")
        self.names += names.to_pylist()
        sizes = np.stack([np.bincount(x, minlength=len(new)) for x in (a_at[keep_a], b_at[keep_b])] + [groups], 1)
        self.good, self.sizes = np.concatenate([self.good, good]), np.concatenate([self.sizes, sizes])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.bincount(at, minlength=len(new)))])
        self.links = np.concatenate([self.links, link_a * self.size_b + link_b])


def _byte_level(path: str) -> tuple[list[str], Callable[[list[str]], list[list[int]]]]:
    """The entries of a byte-level vocabulary by id, and its encoder.

    Where ids stand in the order of merges and texts are split by the common pattern, as
    here, the same merges by rank are the faster way to the same ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    whole.no_truncation()
    whole.no_padding()
    names = [whole.id_to_token(i) or "" for i in range(whole.get_vocab_size())]
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"] for t in told.get("added_tokens", [])}
    byte_of, model, split = _byte_letters(), told["model"], told.get("pre_tokenizer") or {}
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer")
    options = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    if not plain or any(options) or None in merged or merged != sorted(merged):
        return names, lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    ranked = tiktoken.Encoding("by-rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return names, lambda texts: [ranked.encode_ordinary(t) for t in texts]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _ends(ids: list[list[int]], table: pa.Array, number: int) -> tuple[np.ndarray, ...]:
    """Of all tokens: id, segment and end in it; their bytes in a row; bytes by segment."""
    listed = pa.array(ids, pa.list_(pa.int32()))
    flat, parent = pc.list_flatten(listed), np.asarray(pc.list_parent_indices(listed)).astype(np.int64)
    taken = table.take(flat)
    size = np.asarray(pc.binary_length(taken)).astype(np.int64)
    total = np.asarray(pc.cumulative_sum(pa.array(size)))
    of_segment = np.bincount(parent, size, number).astype(np.int64)
    before = np.cumsum(of_segment) - of_segment
    _, offsets, data = taken.buffers()
    data = np.frombuffer(data, np.uint8)[: int(total[-1])] if len(total) else np.zeros(0, np.uint8)
    return np.asarray(flat), parent, total - before[parent], data, of_segment


@lru_cache(maxsize=1)
def segments(a_path: str, b_path: str) -> Segments:
    return Segments(a_path, b_path)


def _document_links(doc: np.ndarray, unit: np.ndarray, of: Segments) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, pair, times) for each document's distinct pairs, by document, in stretches
    of whole documents of MOST_LINKS links or of one document."""
    many = np.diff(of.offsets)[unit]
    total = np.cumsum(many)
    i = 0
    while i < len(unit):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + MOST_LINKS, side="right"))
        last = doc[min(max(j, i + 1), len(unit)) - 1]
        j = int(np.searchsorted(doc, last, side="right" if j >= len(unit) or last == doc[i] else "left"))
        # a segment's links once, with the times that the document has it
        key, times = np.unique(doc[i:j] * len(of.names) + unit[i:j], return_counts=True)
        d, u = key // len(of.names), key % len(of.names)
        n = np.diff(of.offsets)[u]
        first = np.repeat(of.offsets[u] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        wide = pa.table({"doc": np.repeat(d, n), "pair": of.links[first], "times": np.repeat(times, n)})
        grouped = wide.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).sort_by([("doc", "ascending"), ("pair", "ascending")])
        yield tuple(np.asarray(grouped[c]).astype(np.int64) for c in ("doc", "pair", "times_sum"))
        i = j


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, and the document's distinct links as
    lists a, b (ids) and times, of every row of ``docs``.

    groups: ``a1,a2|b1;a3|b2,b3``, the ids of each group in order. Texts that are null,
    empty, or that the tokens of one side don't spell byte by byte, have no tokens: zeros,
    an empty string, empty lists. Row by row, whole texts of any length (memory follows the
    longest); rows repeat as given, null ids too, other columns are not read, an empty
    table gives an empty result.
    """

    def make(batch: pa.RecordBatch):
        of = segments(a_path, b_path)
        unit, counts = of.numbers(batch.column("text").to_pylist())
        n = len(counts)
        doc = np.repeat(np.arange(n), counts)
        bad = np.bincount(doc[~of.good[unit]], minlength=n) > 0
        starts = np.cumsum(counts) - counts
        names = of.names
        groups = ["" if wrong or not c else ";".join([names[u] for u in unit[s : s + c].tolist()]) for s, c, wrong in zip(starts.tolist(), counts.tolist(), bad.tolist(), strict=True)]
        keep = ~bad[doc]
        doc, unit = doc[keep], unit[keep]
        a, b, g = (np.bincount(doc, of.sizes[unit, k], n).astype(np.int64) for k in range(3))
        found = list(_document_links(doc, unit, of))
        d, pair, times = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        per = np.bincount(d, minlength=n)
        lists = [_lists(per, pa.array(x.astype(np.int32))) for x in (pair // of.size_b, pair % of.size_b, times)]
        return [pa.array(x) for x in (a, b, g, a + b - g)] + [pa.array(groups, pa.string()), *lists]

    fields = [("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("groups", "string"), ("a", "array<int>"), ("b", "array<int>"), ("times", "array<int>")]
    return add_columns(docs.select("doc_id", "text"), fields, make, without=("text",))


def _key(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (np.asarray(pc.list_flatten(batch.column(c))).astype(np.int64) for c in ("a", "b"))
    return a << 32 | b


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many rows of ``aligned`` a pair of ids is linked; a pair is
    a * 2**32 + b. Each task counts batch by batch, Spark adds up."""
    bound_batches(aligned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        for batch in batches:
            one = pa.table({"pair": _key(batch)}).group_by("pair", use_threads=False).aggregate([("pair", "count")])
            held.append(one.rename_columns(["pair", "n"]))
            if sum(t.num_rows for t in held) > MOST_PARTIAL:
                held = [merged()]
                if held[0].num_rows > MOST_PARTIAL // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged().to_batches()
        release()

    partial = aligned.select("a", "b").mapInArrow(run, "pair bigint, n bigint")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def _with_best(counts: DataFrame) -> DataFrame:
    """``counts`` with best: whether no pair of the same a has a higher count."""
    of_a = F.shiftright("pair", 32).alias("of")
    most = counts.groupBy(of_a).agg(F.max("n").alias("most"))
    return counts.withColumn("of", F.shiftright("pair", 32)).join(most, "of").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, others: tuple[str, ...]) -> DataFrame:
    """The columns ``others`` of ``aligned`` with n_best and count_sum of each row's links.

    ``counts`` (pair, n, best) is broadcast while it has at most MOST_PAIRS rows; the join
    beyond that deals the pairs that are in most documents to many tasks.
    """
    spark = aligned.sparkSession
    if counts.count() > MOST_PAIRS:
        return _score_by_join(aligned, counts, others)
    table = counts.toArrow().sort_by("pair").combine_chunks()
    shared = spark.sparkContext.broadcast(tuple(np.asarray(table[c]) for c in ("pair", "n", "best")))

    def make(batch: pa.RecordBatch):
        pairs, n, best = shared.value
        at = np.searchsorted(pairs, _key(batch))
        times = np.asarray(pc.list_flatten(batch.column("times"))).astype(np.int64)
        row = np.asarray(pc.list_parent_indices(batch.column("a"))).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
        sums = (np.concatenate([[0], np.cumsum(times * x[at])]) for x in (best, n))
        return [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]

    wide = aligned.select(*others, "a", "b", "times")
    return add_columns(wide, [("n_best", "bigint"), ("count_sum", "bigint")], make, without=("a", "b", "times"))


def _score_by_join(aligned: DataFrame, counts: DataFrame, others: tuple[str, ...]) -> DataFrame:
    """The same by a join. Rows that agree in all ``others`` have the same links."""
    name = F.sha2(F.to_json(F.struct(*others)), 256).alias("row_name")
    named = aligned.select(*others, name)
    links = aligned.select(name, F.arrays_zip("a", "b", "times").alias("l")).groupBy("row_name").agg(F.first("l").alias("l"))
    wide = links.select("row_name", F.explode("l").alias("l")).select("row_name", (F.shiftleft(F.col("l.a").cast("bigint"), 32) + F.col("l.b")).alias("pair"), F.col("l.times").alias("times"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = salted_join(wide, counts, "pair", hot_keys(counts.select("pair", "n"), "pair", total))
    sums = joined.groupBy("row_name").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rows = named.groupBy("row_name").agg(F.count("*").alias("n"))
    out = salted_join(named, sums, "row_name", hot_keys(rows, "row_name", named.count()), "left")
    return out.select(*others, F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"))


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A pair's count is the number of rows that hold it linked; n_best counts the links whose
    pair has the highest count of its a. groups_sha256 is empty for texts without tokens.
    Odd rows are treated as in ``align``.
    """
    made = align(docs, a_path, b_path)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    others = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    aligned = materialise(made.select(*[c for c in made.columns if c != "groups"], digest), "aligned")
    counts = materialise(_with_best(materialise(pair_counts(aligned), "pairs")), "pairs")
    return score_links(aligned, counts, others).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
