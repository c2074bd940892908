"""Periodic runs inside documents: seeds on diagonals, extended once.

A run is a maximal stretch of words whose smallest period q fits three times in it, and that
has LEAST_WORDS words or more. Words q apart are equal in it, so the text meets itself shifted
by q words (a diagonal, its lag is q) over ``length - q`` words: at least 16 for lags up to 16,
and at least 2q for longer ones. So k-grams of k = 16, 32, 64 .. words are indexed, each for the
lags from k / 2 to k (16 for all lags up to 16): every run holds such a k-gram twice, q apart.
As k >= q, no other place of that k-gram lies between the two, so neighbouring occurrences
in the same document are all the pairs that are needed: as many as words, not their square.
A pair starts an extension along its diagonal, unless the table of how far each lag is
covered already says that it is inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns, spans, utf8

#: The least number of words of a run, and how often its period fits in it.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: The smallest k: what the diagonals of the shortest runs have in common with themselves.
FIRST_GRAM = 16
#: Bytes of text whose words are indexed at once; a longer text is a stretch of its own.
CHUNK = 1 << 19


def _repeated(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` places a number of its gram, -1 where the gram is there once."""
    out = np.full(size, -1, np.int64)
    if len(at):
        _, name, often = np.unique(keys, return_inverse=True, return_counts=True)
        twice = often[name] > 1
        out[at[twice]] = name[twice]
    return out


def _grams(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, numbers of the k-grams) for k = 16, 32 .. as long as one is there twice.

    Grams are named exactly, by the names of their halves. A gram that is there once has no
    name, and neither has one that holds it.
    """
    size, k = len(words), 1
    name = _repeated(words, np.arange(size), size)
    while True:
        at = np.flatnonzero(name[: max(size - k, 0)] >= 0)
        at = at[name[at + k] >= 0]
        if not len(at):
            return
        name, k = _repeated(name[at] * (size + 1) + name[at + k], at, size), 2 * k
        if k >= FIRST_GRAM:
            yield k, name


def _matching(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, going by ``step``, equal those ``lag`` further right."""
    most = len(words) - lag - at if step > 0 else at + 1
    done, size = 0, 8
    while done < most:  # stretches that double, so that a short one is cheap and a long one fast
        size = min(2 * size, most - done)
        here = at + done * step
        one = words[here : here + size] if step > 0 else words[here - size + 1 : here + 1][::-1]
        two = words[here + lag : here + lag + size] if step > 0 else words[here + lag - size + 1 : here + lag + 1][::-1]
        wrong = np.flatnonzero(one != two)
        if len(wrong):
            return done + int(wrong[0])
        done += size
    return done


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words`` by start and period.

    ``words``: numbers of words; those of different documents differ, and a number that is
    there once stands between two documents.
    """
    found = []
    for k, name in _grams(words):
        at = np.flatnonzero(name >= 0)
        order = at[np.argsort(name[at], kind="stable")]
        first, second = order[:-1], order[1:]
        lag = second - first
        seed = (name[first] == name[second]) & (lag <= k) & ((lag > k // 2) | (k == FIRST_GRAM))
        first, lag = first[seed], lag[seed]
        if not len(first):
            continue
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        # seeds side by side on a diagonal are one stretch
        new = np.concatenate([[True], (np.diff(first) != 1) | (np.diff(lag) != 0)])
        heads = np.flatnonzero(new)
        ends = np.concatenate([heads[1:], [len(first)]])
        covered: dict[int, int] = {}  # by lag: where the furthest extension has come
        for start, stop, q in zip(first[heads].tolist(), (first[ends - 1] + k).tolist(), lag[heads].tolist(), strict=True):
            # the seeds of a run span its diagonal, so shorter stretches belong to none
            if start < covered.get(q, 0) or stop - start + q < max(LEAST_WORDS, LEAST_TIMES * q):
                continue
            low = start - (_matching(words, start - 1, q, -1) if start else 0)
            high = stop + _matching(words, stop, q, 1)
            covered[q] = high
            found.append((low, high - low + q, q))
    return sorted(found)


def _outside(runs: list[tuple[int, int, int]], words: list[bytes]) -> list[bytes]:
    """``words`` without those that stand in a run after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _batch(texts: pa.Array) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Of each text: its number of words, its runs, and what is left of it."""
    data, offsets = utf8(texts)
    counts, runs, left = [], [], []
    for i, j in spans(offsets, CHUNK):
        parts = [data[offsets[d] : offsets[d + 1]].tobytes().split() for d in range(i, j)]
        sizes = np.array([len(p) for p in parts])
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(w, len(known)) for p in parts for w in p), np.int64, sizes.sum())
        # one place between documents, and words of different documents apart
        doc, starts = np.repeat(np.arange(j - i), sizes), np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        line = -1 - np.arange(sizes.sum() + j - i)
        line[np.arange(len(doc)) + doc] = doc * max(len(known), 1) + number
        of: list[list[tuple[int, int, int]]] = [[] for _ in parts]
        for start, length, period in find_runs(line):
            d = int(np.searchsorted(starts, start, side="right")) - 1
            of[d].append((start - int(starts[d]), length, period))
        counts += sizes.tolist()
        runs += of
        left += [b" ".join(_outside(r, p)) for r, p in zip(of, parts, strict=True)]
    return counts, runs, left


def collapse(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with n_words, runs (array of start, length, period, by start and
    period; words count from 0) and collapsed: the words that stand in no run after its first
    period, with one space between them. The column text is left out.

    Words are runs without white space, compared as they are. A null, empty or wordless text
    has no word, no run and an empty collapsed text. Row by row, whole texts of any length
    (memory follows the longest text); repeated rows and null ids stay as given, an empty
    table gives an empty result, and columns of the three new names give way to them.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    fields = [("n_words", "bigint"), ("runs", "array<struct<start:bigint,length:bigint,period:bigint>>"), ("collapsed", "string")]

    def make(batch: pa.RecordBatch):
        counts, runs, left = _batch(batch.column("text"))
        named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in one] for one in runs]
        return pa.array(counts, pa.int64()), pa.array(named, kind), pa.array(left, pa.binary()).cast(pa.string())

    return add_columns(docs, fields, make, without=("text",))
