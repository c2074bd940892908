"""Token alignment: against the libraries on whole texts and a search by definition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandflow.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    "Hello there, world!", "a  b   c", " leading", "trailing ", "  \n x \n\n y", "tab\tand\r\nlines \n z", "don't they're WE'LL 's", "naïve Ωμέγα straße 漢字 かな ", "no\xa0break a\xa0 b",
    "mark ▁ of the model", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00 nul\x00", "\x1c sep \x1d x", "é combining", "👩‍👩‍👧 emoji 🙂🙂", "12345 67.89 1,000", "　wide   em", "x", " ", "\n", "...!!!", "a\u0085b \u0085 c", "﻿bom", "אבג דהו",
    "word " * 3000, "longunbroken" * 2000, "퟿  \U0010ffff",
]


def libraries():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(one, two, text):
    """[(id, start, stop)] of both sides, or None without tokens."""
    if not text:
        return None
    letters = alignment._byte_letters()
    raw = (" " + text).encode()
    out = []
    for ids, name in ((one.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in one.id_to_token(i))), (two.encode(text), lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode())):
        parts = [name(i) for i in ids]
        if b"".join(parts) != raw:
            return None
        at, side = 0, []
        for i, p in zip(ids, parts, strict=True):
            side.append((i, at, at + len(p)))
            at += len(p)
        out.append(side)
    return out


def by_definition(rows):
    one, two = libraries()
    found, counts = [], Counter()
    for doc_id, text in rows:
        both = tokens(one, two, text)
        if both is None:
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = both
        links, low = [], 0
        for i, s, e in a:
            while b[low][2] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        counts.update(set(links))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, x, y = [], 0, 0
        for end in ends:
            p, q = [], []
            while x < len(a) and a[x][2] <= end:
                p.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= end:
                q.append(str(b[y][0]))
                y += 1
            groups.append(",".join(p) + "|" + ",".join(q))
        found.append((doc_id, len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(d, na, nb, g, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha) for d, na, nb, g, links, sha in found]


@pytest.fixture
def table(spark, tmp_path):
    rnd = random.Random(3)
    words = "the of and Straße naïve don't 42 1,000 a.\nThe x, y; ▁ ".split(" ")
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(60)]
    rows += [(None, "a null id"), (None, None), (500, None), (501, ""), (3, "again the same id"), (502, TEXTS[0]), (502, TEXTS[0])]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id bigint, text string, n_a int, a string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_query_is_as_the_libraries_have_it(spark, table):
    sf_dir, rows = table
    got = queries.op12_token_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert in_order(tuple(r) for r in got.collect()) == in_order(by_definition(rows))


def test_join_gives_the_same_as_the_broadcast(spark, table, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_PAIRS", 0)
    monkeypatch.setattr(alignment, "MOST_PARTIAL", 10)
    monkeypatch.setattr(alignment, "MOST_LINKS", 7)
    sf_dir, rows = table
    got = queries.op12_token_alignment(spark, sf_dir)
    assert in_order(tuple(r) for r in got.collect()) == in_order(by_definition(rows))


def test_a_worker_that_forgets_segments(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_SEGMENTS", 20)
    of, whole = alignment.Segments(A, B), alignment.Segments(A, B)
    rnd = random.Random(4)
    for _ in range(40):
        text = " ".join(str(rnd.choice([rnd.randint(0, 9), rnd.randint(0, 10**6)])) for _ in range(15))
        unit, _ = of.numbers([text])
        whole.clear()
        all_, _ = whole.numbers([text])
        assert [of.names[u] for u in unit] == [whole.names[u] for u in all_]
        assert [of.links[of.offsets[u] : of.offsets[u + 1]].tolist() for u in unit] == [whole.links[whole.offsets[u] : whole.offsets[u + 1]].tolist() for u in all_]
    assert len(of.names) < 60


def test_ids_are_the_librarys():
    one, _ = libraries()
    _, encode = alignment._byte_level(A)
    texts = [" " + t for t in TEXTS]
    assert encode(texts) == [one.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.digests(docs, A, B).count() == 0
