"""Suffix-array dedup: the order of suffixes, and the query against a search by definition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from strandflow.llm import queries, suffix_dedup


def made(rnd, size, letters):
    return bytes(rnd.choice(letters) for _ in range(size))


def by_definition(texts, span=400):
    """(n_bytes, n_removed, n_spans, kept digest) of each text."""
    raw = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if counts[r[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_of_pieces():
    rnd = random.Random(1)
    for _ in range(60):
        letters = b"abcdz\0\xff"[: rnd.choice([1, 2, 3, 7])]
        base = [made(rnd, rnd.randint(400, 800), letters) for _ in range(3)]
        pieces = []
        for _ in range(rnd.randint(1, 8)):
            b = rnd.choice(base)
            i = rnd.randint(0, len(b) - 400)
            piece = bytearray(made(rnd, rnd.randint(0, 50), letters) + b[i : rnd.randint(i + 400, len(b))] + made(rnd, rnd.randint(0, 50), letters))
            if rnd.random() < 0.3:
                piece[rnd.randrange(len(piece))] = ord("x")
            pieces.append(bytes(piece))
        counts = Counter(p[i : i + 400] for p in pieces for i in range(len(p) - 399))
        want = [[counts[p[i : i + 400]] > 1 for i in range(len(p) - 399)] for p in pieces]
        assert [x.tolist() for x in suffix_dedup.repeated(pieces)] == want


def test_strings_stand_in_the_order_of_their_bytes():
    rnd = random.Random(2)
    pieces = [made(rnd, rnd.randint(400, 460), b"ab") for _ in range(20)]
    order, begin = suffix_dedup.suffix_order(pieces)
    raw = b"\0".join([*pieces, b""])
    strings = [raw[i : i + 400] for i in order.tolist()]
    assert strings == sorted(strings) and len(strings) == sum(len(p) - 399 for p in pieces)
    assert begin.tolist() == [sum(len(p) + 1 for p in pieces[:k]) for k in range(20)]


def odd_texts(rnd):
    words = [f"w{rnd.randint(0, 10**6)}é" for _ in range(600)]
    say = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 999)) for _ in range(n))
    passage, long_passage, page = say(60), say(300), say(200)
    texts = [say(20) + " " + passage + " " + say(20) for _ in range(40)]  # one passage in other surroundings
    texts += [passage[: rnd.randint(380, 420)] + str(k) for k in range(10)]
    texts += [say(10) + long_passage + say(10) + long_passage[500:1500], page, page, page, page + "!", "?" + page]
    texts += [page[:700] + "X" + page[701:], "a" * 399, "b" * 401, "c" * 400, "d" * 400 + "e" + "d" * 400, "ab" * 500, "z" * 5000]
    texts += [passage[:399], say(3000), None, "", "short", "short", "f" * 399, "f" * 399]
    return texts


@pytest.fixture
def table(spark, tmp_path):
    rows = list(enumerate(odd_texts(random.Random(6))))
    rows += [(None, "g" * 450), (None, "g" * 450), (None, None), (3, rows[0][1]), (900, rows[1][1]), (900, rows[1][1])]
    spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id bigint, text string, ref string, n int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("most", [1_024, 3, 1])
def test_query_is_as_defined(spark, table, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 12 if most == 3 else suffix_dedup.CHUNK)
    monkeypatch.setattr(suffix_dedup, "_POWERS", [])
    sf_dir, rows = table
    got = queries.op11_suffix_dedup(spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(i, *w) for (i, _), w in zip(rows, by_definition([t for _, t in rows]), strict=True)]
    assert in_order(tuple(r) for r in got.collect()) == in_order(want)


def test_spans_and_kept_bytes(spark):
    text = "x" + "".join(chr(97 + k * k % 23) + str(k) for k in range(300))
    docs = spark.createDataFrame([(1, text[:700] + "!", "a"), (2, "?" + text[:650], "b"), (3, "alone", "c")], "doc_id bigint, text string, kept string")
    rows = {r["doc_id"]: r for r in suffix_dedup.remove(docs).collect()}
    assert [tuple(x) for x in rows[1]["removed"]] == [(0, 650)] and bytes(rows[1]["kept"]).decode() == text[650:700] + "!"
    assert [tuple(x) for x in rows[2]["removed"]] == [(1, 651)] and bytes(rows[2]["kept"]) == b"?"
    assert rows[3]["removed"] == [] and bytes(rows[3]["kept"]) == b"alone"
    assert suffix_dedup.remove(docs.limit(0)).count() == 0
