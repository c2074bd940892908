"""BPE encoding by dynamic programming over prefixes, and decoding.

An automaton of the vocabulary names, for each prefix of a word, the tokens that end it.
Exactly one of them can be the last token of the prefix's own encoding: the one that stays
apart from the last token of the prefix before it, under the order of the merges. The last
token of each prefix is stored, and following the back-pointers from the end gives the ids
that merging pair by pair would give, in time linear in the word.
"""

from __future__ import annotations

import hashlib
import json
import os.path
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import add_columns, kept_in_worker

#: Bytes of the stretches and, half as many, of the words whose ids a worker remembers, the characters
#: of those that it does (longer ones hardly come again), and pairs whose test it remembers.
MEMO_BYTES, MEMO_CHARS = 80 << 20, 64
MEMO_PAIRS = 150_000
#: Stands for the end of a word inside the automaton; no byte maps to it.
END = ""
INF = 1 << 60

#: Letters and numbers newer than the Unicode version of the tokenizer's
#: library, which takes them for other characters.
NEWER = "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"


def _as_library(pattern: str) -> str:
    """The pattern with its letters and numbers limited to those the library knows."""
    ends = [[f"\\U{int(x, 16):08X}" for x in r.split("-")] for r in NEWER.split()]
    newer = "".join("-".join(e) for e in ends)
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{newer}]]")
    return pattern



class _Memo(dict):
    """Look-up that computes what it lacks and starts again when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class _Parts(dict):
    """The same for the ids of stretches of text, bounded in bytes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.size = make, most, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            self.size += 180 + (1 if key.isascii() else 4) * len(key) + len(value)  # with what Python adds
            if self.size > self.most:
                self.clear()
                self.size = 0
            self[key] = value
        return value


def _byte_chars() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _check(spec: dict) -> None:
    """An error for a tokenizer file that asks for something else than ``Encoder`` does."""
    model = spec["model"]
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", ())]
    splits = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())]
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    right = {
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "normalizer": steps == ["NFC", "Replace", "Lowercase"],
        "pre_tokenizer": splits == ["Split", "ByteLevel"] and not spec["pre_tokenizer"]["pretokenizers"][1].get("add_prefix_space"),
        "decoder": spec.get("decoder") is None,
        "added_tokens": not any(t.get(k) for t in spec["added_tokens"] for k in flags),
    }
    wrong = [k for k, good in right.items() if not good]
    if wrong:
        raise ValueError(f"this tokenizer file is not of the kind that is encoded here: {', '.join(wrong)}")


class Encoder:
    """Ids and decoded text as the given tokenizer file defines them.

    The file must hold a BPE model whose words end in a suffix, with byte-level words,
    case folding, composed characters and the split pattern stated in it, and added tokens
    that stand for themselves wherever they are; any other file raises an error.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        _check(spec)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: What each added token begins with: texts without it hold none.
        self.mark = os.path.commonprefix(list(self.added))
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(_as_library(pattern), regex.V1)
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.chars = _byte_chars()
        # merges: rank of a pair; how each token was made
        self.rank, self.pair, self.left, self.right = {}, {}, {}, {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ia, ib, made = vocab[a], vocab[b], vocab[a + b]
            self.pair[ia, ib] = k
            self.rank[made], self.left[made], self.right[made] = k, ia, ib
        self.apart = _Memo(self._apart, MEMO_PAIRS)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            ends = bool(suffix) and token.endswith(suffix) and token != suffix
            body = token[: -len(suffix)] if ends else token
            self.automaton.add_word(body + END * ends, (len(body), i))
        self.automaton.make_automaton()
        self.memo = _Parts(self._chunk, MEMO_BYTES)
        self.memo_words = _Parts(self._word, MEMO_BYTES // 2)

    def _apart(self, pair: int) -> bool:
        """Whether two neighbouring tokens stay two when their text is merged as one.

        Going back in time, undo the later-made of the two neighbours. A merge across
        the border happens if its rank comes before the merges that used up its sides;
        of equal ranks the left one goes first.
        """
        a, b = pair >> 32, pair & 0xFFFFFFFF
        rank = self.rank
        used_a = used_b = INF
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < used_a and across <= used_b:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                used_a, a = ra, self.right[a]
            else:
                used_b, b = rb, self.left[b]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word of the split pattern."""
        chars = self.chars
        body = "".join([chars[b] for b in word.encode()])
        n = len(body)
        last, size = [-1] * (n + 1), [0] * (n + 1)  # of each prefix: its last token
        apart = self.apart
        for at, (length, token) in self.automaton.iter(body + END):  # by end, longest first
            p = at + 1
            if p >= n:
                if p == n:  # the last character without the end of the word
                    continue
                p = n
            if size[p]:
                continue
            before = p - length
            if not before or apart[last[before] << 32 | token]:
                last[p], size[p] = token, length
        out, p = [], n
        while p > 0:
            out.append(last[p])
            p -= size[p]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        return np.array(self.encode_word(word), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space."""
        words = self.words.findall(chunk)
        if len(words) == 1:
            return self._word(words[0])
        return b"".join([self.memo_words[word] for word in words])

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        # control separators are white space to str.split but not to the pattern
        if any(c in low for c in "\x1c\x1d\x1e\x1f"):
            return [self.memo_words[w] for w in self.words.findall(low)]
        return list(map(self.memo.__getitem__, low.split()))

    def parts(self, text: str) -> list[bytes]:
        """Ids of each part of the whole text, in order."""
        if not self.added or self.mark not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self._plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return [*out, *self._plain(text[at:])]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        return b"".join(self.parts(text))

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, the token strings with spaces between."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str) -> Encoder:
    """One per worker process and file, as long as the process has tasks that encode."""
    return kept_in_worker(f"bpe {path}", lambda: Encoder(path))


def _id_lists(raw: list[bytes]) -> pa.Array:
    sizes = np.cumsum([0] + [len(r) // 4 for r in raw])
    values = np.frombuffer(b"".join(raw), "<i4")
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int32()))


def _digests(enc: Encoder, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
    """Of each whole text its ids, and the SHA-256 of what they decode to."""
    ids, decoded = [], []
    for text in texts:
        ids.append(enc.encode(text or ""))
        decoded.append(hashlib.sha256(enc.decode(ids[-1]).encode()).hexdigest())
    return ids, decoded


def encode(docs: DataFrame, path: str, text: str = "text", without: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of each whole text; a null text is empty.

    With ``decoded``, also ``decoded_sha256``, the digest of the text that the ids decode
    to. Row-wise: rows may repeat, and no row meets another, so hot sources or copies
    don't matter; an empty table gives an empty result. Columns named like the new ones
    are replaced. What a worker remembers is bounded in bytes, whatever the texts are.
    """

    def make(batch: pa.RecordBatch):
        raw, digests = _digests(encoder(path), batch.column(text).to_pylist())
        return [_id_lists(raw), pa.array(digests, pa.string())][: 1 + decoded]

    fields = [("ids", "array<int>"), ("decoded_sha256", "string")][: 1 + decoded]
    return add_columns(docs, fields, make, without)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text that the ids stand for; null or empty ids give an
    empty text. Row-wise; a column ``decoded`` is replaced; an empty table stays empty."""

    def make(batch: pa.RecordBatch):
        enc = encoder(path)
        column = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        return [pa.array([enc.decode(np.array(x or [], "<u4").tobytes()) for x in column], pa.string())]

    return add_columns(rows, [("decoded", "string")], make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text of every row.

    The same encoder and decoder as ``encode``; the digests are taken where the ids are
    made, so that neither ids nor texts go back to the JVM. A null text is empty, null ids
    stay, rows repeat as given, other columns are not read, and an empty table gives an
    empty result.
    """

    def make(batch: pa.RecordBatch):
        ids, decoded = _digests(encoder(path), batch.column("text").to_pylist())
        n = [len(i) // 4 for i in ids]
        return pa.array(n, pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(decoded, pa.string())

    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return add_columns(docs.select("doc_id", "text"), fields, make, without=("text",))
