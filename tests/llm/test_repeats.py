"""Periodic runs: against a search by definition, and the query against its contract."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import queries, repeats


def by_definition(words):
    """All (start, length, period): every period at every place."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if j > i and len(run) >= max(24, 3 * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                found.append((i, len(run), q))
            i = max(j, i + 1)
    return sorted(found)


def made_words(rnd):
    out = []
    for _ in range(rnd.randint(1, 5)):
        kinds = rnd.randint(1, 3)
        if rnd.random() < 0.6:
            period = [rnd.randint(0, kinds) for _ in range(rnd.randint(1, 45))]
            if rnd.random() < 0.4:
                period = period * rnd.randint(1, 3) + [rnd.randint(0, 9)]
            out += (period * 5)[: rnd.randint(1, 5 * len(period))]
        else:
            out += [rnd.randint(0, 10 * kinds) for _ in range(rnd.randint(1, 20))]
    return out


def test_runs_are_those_of_the_definition():
    rnd = random.Random(5)
    for _ in range(600):
        words = made_words(rnd)
        assert repeats.find_runs(np.array(words)) == by_definition(words), words


def test_long_periods_and_nested_runs():
    base = [*range(700)]
    words = [-1, *base * 4, -2, *([5, 6] * 20 + [7]) * 3]
    assert repeats.find_runs(np.array(words)) == by_definition(words)
    one = np.zeros(200_000, np.int64)  # one word throughout: linear work
    assert repeats.find_runs(one) == [(0, 200_000, 1)]
    half = np.concatenate([one, np.arange(1, 100_000), one])
    assert repeats.find_runs(half) == [(0, 200_000, 1), (299_999, 200_000, 1)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_definition(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


@pytest.fixture
def odd_documents(spark, tmp_path):
    rnd = random.Random(8)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:25]
    rows = [(i, " ".join(f"w{x}" for x in made_words(rnd)), "k") for i in [*ids, *range(25)]]
    rows += [(None, "a " * 30, "k"), (None, None, "k"), (500, None, "k"), (501, "", "k"), (502, " \t\n ", "k"), (503, "Ω\x0bß " * 40, "k"), (503, "Ω\x0bß " * 40, "k")]
    rows += [(i, "long " + " ".join(f"x{j}" for j in range(2000)) + " again and" * 3000, "k") for i in (ids[0], 504)]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_query_follows_its_contract(spark, odd_documents):
    sf_dir, rows = odd_documents
    got = queries.op13_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    short = [r for r in rows if len(r[1] or "") < 20_000]
    want = sorted([(r[0], *expected(r[0], r[1])) for r in short], key=key)
    of = [tuple(r) for r in got.collect()]
    assert len(of) == len(rows)
    rest = list(of)
    for row in want:
        rest.remove(row)
    assert len(rest) == 2 and all(r[1] >= 1 for r in rest)
    assert {r[0]: r[4] for r in rest}[504] == 2


def test_collapsed_text_keeps_other_columns(spark, odd_documents):
    sf_dir, rows = odd_documents
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("more", F.lit(1))
    got = repeats.collapse(docs)
    assert got.columns == ["doc_id", "more", "n_words", "runs", "collapsed"] and got.count() == len(rows)
    assert repeats.collapse(docs.limit(0)).count() == 0
    row = got.where("doc_id = 503").first()
    assert row["collapsed"] == "Ω ß" and [tuple(r) for r in row["runs"]] == [(0, 80, 2)]
