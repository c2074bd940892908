"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, tokens). Documents join
it on both digests; each distinct content that it lacks is encoded once, appended, and
joined back. Equal content costs one encoding, now and in later runs.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import add_columns, hot_keys, materialise, new_path, salted_join

#: Parts of texts that a worker remembers, and the characters of those that it does:
#: longer ones hardly come again, and with both the memory is bounded.
MEMO_WORDS, MEMO_CHARS = 100_000, 64
#: Missing digests that are broadcast to pick their texts; beyond it texts meet by shuffle.
MOST_BROADCAST = 50_000
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def _fields(raw: bytes) -> list[tuple[int, int | bytes]]:
    """The (number, value) pairs of a message in protocol buffers' wire format."""

    def varint(at: int) -> tuple[int, int]:
        value, shift = 0, 0
        while True:
            value |= (raw[at] & 127) << shift
            if raw[at] < 128:
                return value, at + 1
            at, shift = at + 1, shift + 7

    out: list[tuple[int, int | bytes]] = []
    at = 0
    while at < len(raw):
        tag, at = varint(at)
        value: int | bytes
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, at = raw[at : at + size], at + size
        out.append((tag >> 3, value))
    return out


def plain_normaliser(path: str) -> bool:
    """Whether the model takes texts as they are: it maps no characters, puts one space
    before the text, keeps all spaces, writes them as U+2581 and not after words."""
    parts = dict(_fields(open(path, "rb").read()))
    normaliser = {3: 1, 4: 1, 5: 1} | dict(_fields(parts.get(3, b"")))
    as_suffix = dict(_fields(parts.get(2, b""))).get(24, 0)
    return not normaliser.get(2) and normaliser[3] == 1 and normaliser[4] == 0 and normaliser[5] == 1 and not as_suffix


class Counter(dict):
    """Token counts of space-separated parts, of which up to ``MEMO_WORDS`` are remembered.

    No piece of the vocabulary goes on past a word into the next space or holds a line
    feed, and the model's normaliser leaves texts as they are, which ``__init__`` checks; so
    a text's count is the sum over its parts. With another model, texts are counted whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.lines: dict[str, int] = {}
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_parts = plain_normaliser(path) and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def __missing__(self, part: str) -> int:
        """``part`` follows one space (the model puts one before the text as well)."""
        first, *lines = part.split("\n")
        if lines:
            return self[first] + sum(self.line(x) for x in lines)
        return self.keep(part, len(self.model.encode(part + "\n")) - 1)

    def line(self, rest: str) -> int:
        """A line feed and what follows it up to the next space."""
        n = self.lines.get(rest)
        if n is None:
            n = len(self.model.encode("\n" + rest)) - 1
            if len(rest) <= MEMO_CHARS:
                if len(self.lines) >= MEMO_WORDS:
                    self.lines.clear()
                self.lines[rest] = n
        return n

    def keep(self, key: str, n: int) -> int:
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_parts:
            return len(self.model.encode(text))
        if "▁" in text:  # to the model the same as a space
            text = text.replace("▁", " ")
        if "  " not in text and text[0] != " " != text[-1]:
            return sum(map(self.__getitem__, text.split(" ")))
        total, held = 0, ""
        for part in text.split(" "):  # runs of spaces go with the word after them
            if part:
                total += self[held + part]
                held = ""
            else:
                held += " "
        return total + (self[held[1:]] if held else 0)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: the digest of its file and of the way of counting."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"no added tokens\0" + f.read()).hexdigest()


def _cached(docs: DataFrame, cache: str, version: str) -> DataFrame:
    spark = docs.sparkSession
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    # two runs may have appended the same content
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; a null or empty text has 0.

    ``cache``: folder of the cache; None starts an empty one in the shared folder. Content
    is normalised as the tokenizer does before anything else: null becomes empty. Digests
    are merged first and looked up alone. Up to MOST_BROADCAST missing digests are broadcast, and
    only their texts travel, once from each partition that has them; with more, every distinct
    text does. Whole texts of any length are counted. Rows repeat as
    given, null ids included, a hot digest's rows are dealt to many tasks, other columns are
    not read, and an empty table gives an empty result and adds nothing to the cache.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-cache")
    version = tokenizer_digest(path)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = materialise(texts.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")
    distinct = materialise(rows.groupBy("digest").agg(F.count("*").alias("n")), "distinct")
    misses = materialise(distinct.select("digest").join(_cached(docs, cache, version), "digest", "left_anti"), "misses")
    few = misses.count() <= MOST_BROADCAST
    wanted = texts.join(F.broadcast(misses), "digest", "left_semi") if few else texts
    wanted = wanted.groupBy("digest").agg(F.first("text").alias("text"))
    wanted = wanted if few else wanted.join(misses, "digest", "left_semi")

    def make(batch: pa.RecordBatch):
        count = counter(path).count
        return [pa.array(np.fromiter(map(count, batch.column("text").to_pylist()), np.int64, batch.num_rows))]

    counted = add_columns(wanted, [("n_tokens", "bigint")], make, without=("text",))
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    hot = hot_keys(distinct, "digest", rows.count())
    found = salted_join(rows, _cached(docs, cache, version), "digest", hot)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
