"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of zero to three bytes. A symbol seen after a
context costs its share of the context's count; one not seen there costs an escape
(method C) and then its share under the context one byte shorter, among the symbols the
longer context has not seen. The statistics are frozen after training, so that the exact
code length of a byte is one look-up and a whole text's is a sum over its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, held_out, in_training, keep_rows, place, release, utf8

#: About how many distinct texts per language are learned from, each of them whole.
SAMPLE_DOCS = 800
#: Languages that are learned: the commonest.
MOST_LANGS = 1_000
#: How often a context of two or three bytes must occur to be a node of its own, and the
#: code lengths (nodes x symbols x languages) that a model may have: beyond these only the
#: commonest contexts are nodes, so that many languages and scripts still fit in a worker.
LEAST_CONTEXT = 12
MOST_CELLS = 8_000_000
MOST_NODES = 100_000
CHUNK = 1 << 18


@dataclass
class PPM:
    """Frozen code lengths. ``symbol``: byte to symbol; ``node``: three symbols to the
    longest context that has a node; ``cost``: bits by node, symbol and language."""

    langs: list[str]
    symbol: np.ndarray
    node: np.ndarray
    cost: np.ndarray
    n: int
    space: int


def _step(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(symbol | context) from its counts and the shorter context's probabilities."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = np.where(counts > 0, 0.0, lower)
    left = rest.sum(1, keepdims=True)
    escape = np.where(left > 0, kinds, 0)
    p = counts / np.maximum(total + escape, 1) + escape / np.maximum(total + escape, 1) * rest / np.where(left > 0, left, 1)
    return np.where(total > 0, p, lower)


#: One case: capitals would only thin out the statistics.
_FOLD = np.arange(256)
_FOLD[65:91] += 32

#: Of each language, distinct grams (a context and the byte after it, one code) and how often.
Counts = dict[str, tuple[np.ndarray, np.ndarray]]


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The grams of four bytes in three spaces and a whole text, part by part, and how often."""
    data = b"   " + text
    codes, often = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(text), CHUNK):
        s = _FOLD[np.frombuffer(data[lo : min(lo + CHUNK, len(text)) + 3], np.uint8)]
        found, n = np.unique(((s[:-3] * 256 + s[1:-2]) * 256 + s[2:-1]) * 256 + s[3:], return_counts=True)
        codes, often = add_counts(np.concatenate([codes, found]), np.concatenate([often, n]))
    return codes, often


def add_counts(codes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes as one, their counts added up."""
    names, at = np.unique(codes, return_inverse=True)
    return names, np.bincount(at, often, len(names)).astype(np.int64)


def train(texts: dict[str, list[bytes]], least: int = LEAST_CONTEXT) -> PPM:
    """Grow the context trees of each language from its texts."""
    deep = {lang: gram_counts((b" " * 3).join(parts)) for lang, parts in texts.items()}
    flat = {lang: add_counts(codes & 0xFFFFFF, often) for lang, (codes, often) in deep.items()}
    return build(flat, deep, least)


def _common(counts: Counts, shift: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (codes without their last byte) that occur ``least`` times, and how often."""
    codes = np.concatenate([c >> 8 for c, _ in counts.values()] or [np.zeros(0, np.int64)])
    often = np.concatenate([n for _, n in counts.values()] or [np.zeros(0, np.int64)])
    names, n = add_counts(codes & shift, often)
    return names[n >= least], n[n >= least]


def build(flat: Counts, deep: Counts, least: int = LEAST_CONTEXT) -> PPM:
    """The frozen model of counted grams: ``flat`` has all grams of three bytes, ``deep``
    those of four, of which contexts under ``least`` may be left out."""
    langs = sorted(flat)
    seen = np.zeros(256, bool)
    for codes, _ in flat.values():
        seen[codes & 0xFF] = True
    seen[32] = True
    ids = np.zeros(256, np.int64)
    ids[seen] = np.arange(1, seen.sum() + 1)  # 0: a byte that no sample has
    n = int(seen.sum()) + 1
    symbol = ids[_FOLD]
    space = int(symbol[32])

    # the nodes: every one-byte context, then the commonest longer ones that fit
    (two, often2), (three, often3) = _common(flat, 0xFFFF, least), _common(deep, 0xFFFFFF, least)
    room = max(MOST_CELLS // (n * max(len(langs), 1)) - n, 0)
    if len(two) + len(three) > room:
        rank = np.sort(np.concatenate([often2, often3]))[::-1][room] if room else 1 << 60
        two, three = two[often2 > rank], three[often3 > rank]
    two = np.union1d(two, three & 0xFFFF)  # a node's shorter context is a node
    sym2 = ids[two >> 8] * n + ids[two & 0xFF]
    sym3 = (ids[three >> 16] * n + ids[three >> 8 & 0xFF]) * n + ids[three & 0xFF]
    row2 = np.full(n * n, -1, np.int32)
    row2[sym2] = n + np.arange(len(two))
    node = np.tile(np.where(row2 >= 0, row2, np.arange(n * n) % n).astype(np.int32), n)
    node[sym3] = n + len(two) + np.arange(len(three))

    def table(contexts: np.ndarray, codes: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Counts by context and symbol, of the grams whose context is listed."""
        at = np.searchsorted(contexts, codes >> 8)
        on = (at < len(contexts)) & (contexts[np.minimum(at, len(contexts) - 1)] == codes >> 8) if len(contexts) else np.zeros(len(codes), bool)
        return np.bincount(at[on] * n + ids[codes[on] & 0xFF], often[on], len(contexts) * n).reshape(len(contexts), n)

    cost = np.empty((n + len(two) + len(three), n, len(langs)), np.float32)
    bits = lambda p: -np.log2(np.maximum(p, 1e-12))
    for k, lang in enumerate(langs):
        codes, often = flat[lang]
        p0 = _step(np.bincount(ids[codes & 0xFF], often, n)[None].astype(float), np.full((1, n), 1 / n))
        c1 = np.bincount(ids[codes >> 8 & 0xFF] * n + ids[codes & 0xFF], often, n * n).reshape(n, n)
        p1 = _step(c1, np.repeat(p0, n, 0))
        p2 = _step(table(two, codes, often), p1[ids[two & 0xFF]])
        cost[:n, :, k], cost[n : n + len(two), :, k] = bits(p1), bits(p2)
        lower = np.searchsorted(two, three & 0xFFFF)
        for lo in range(0, len(three), 4096):  # the largest table, in parts
            part = slice(lo, lo + 4096)
            p3 = _step(table(three[part], *deep.get(lang, (np.zeros(0, np.int64),) * 2)), p2[lower[part]])
            cost[n + len(two) :, :, k][part] = bits(p3)
    return PPM(langs, symbol.astype(np.int32), node, cost.reshape(len(cost) * n, len(langs)), n, space)


def code_lengths(model: PPM, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row's whole text under each language; rows x languages."""
    rows, n = len(offsets) - 1, model.n
    out = np.zeros((rows, len(model.langs)))
    base, end = int(offsets[0]), int(offsets[-1])
    for lo in range(base, end, CHUNK):
        hi = min(lo + CHUNK, end)
        back = min(3, lo - base)
        s = model.symbol[data[lo - back : hi]]
        if back < 3:
            s = np.concatenate([np.full(3 - back, model.space, np.int32), s])
        before = [s[3 - d : len(s) - d].copy() for d in (1, 2, 3)]
        first, last = np.searchsorted(offsets, lo - 2, "left"), np.searchsorted(offsets, hi, "left")
        starts = offsets[first:last] - lo
        for d in (1, 2, 3):  # a text begins after spaces, not after the text before it
            for j in range(d):
                at = starts + j
                before[d - 1][at[(at >= 0) & (at < hi - lo)]] = model.space
        row = model.node[(before[2] * n + before[1]) * n + before[0]]
        bits = model.cost[row.astype(np.int64) * n + s[3:]]
        r0 = int(np.searchsorted(offsets, lo, "right")) - 1
        r1 = int(np.searchsorted(offsets, hi, "left"))
        cuts = np.maximum(offsets[r0:r1] - lo, 0)
        full = np.diff(np.append(cuts, hi - lo)) > 0
        sums = np.add.reduceat(bits, cuts[full], axis=0, dtype=np.float64)
        out[np.arange(r0, r1)[full]] += sums
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> PPM:
    """Train on about ``sample_docs`` distinct texts per language, whole ones of any length,
    those of the training fold with the smallest content hash.

    Copies of a text, under one id or many, count once. Grams are counted where the texts
    are; the driver gets counts only: grams of three bytes, and those of four whose context
    is among the MOST_NODES commonest. Rows with a null id, text or language and empty
    texts are never learned from; without any other row nothing is learned.
    """
    fold = docs.where(in_training() & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", "text")
    # about how many distinct texts, so that a language of many copies isn't left with none
    sizes = fold.groupBy(F.col("lang").alias("_lang")).agg(F.approx_count_distinct("text").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(MOST_LANGS)
    drawn = fold.join(F.broadcast(sizes), F.col("lang") == F.col("_lang")).where(place("text") * F.col("_n") <= sample_docs)
    chosen = drawn.groupBy("lang", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")).select("lang", "text")

    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes, often = gram_counts(text.encode() + b" " * 3)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(often)], names=["lang", "code", "n"])
        release()

    counted = chosen.mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).persist()
    context = F.shiftright("code", 8)
    common = counted.groupBy(context.alias("context")).agg(F.sum("n").alias("often")).where(F.col("often") >= LEAST_CONTEXT)
    common = common.orderBy(F.desc("often"), "context").limit(MOST_NODES).select("context")
    deep = counted.join(F.broadcast(common), context == F.col("context")).select("lang", "code", "n")
    flat = counted.groupBy("lang", F.col("code").bitwiseAND(F.lit(0xFFFFFF)).alias("code")).agg(F.sum("n").alias("n"))
    model = build(_collected(flat), _collected(deep))
    counted.unpersist()
    release()
    return model


def _collected(counts: DataFrame) -> Counts:
    """Counted grams by language; bounded by the languages times the grams there can be."""
    rows = counts.toArrow()
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    at, codes, often = (np.asarray(x) for x in (lang.indices, rows.column("code"), rows.column("n")))
    order = np.argsort(codes, kind="stable")
    at, codes, often = at[order], codes[order], often[order]
    return {name: (codes[at == k], often[at == k]) for k, name in enumerate(lang.dictionary.to_pylist())}


def _best(model: PPM, text: pa.Array, letter: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the language's place (one beyond the last for none), its share of the
    posterior, and the bits a byte takes."""
    has = np.asarray(letter.to_numpy(zero_copy_only=False), bool)
    if not model.langs:
        return np.zeros(len(has), int), np.zeros(len(has)), np.zeros(len(has))
    data, offsets = utf8(text)
    bits = code_lengths(model, data, offsets)
    best, least = bits.argmin(1), bits.min(1)
    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    size = np.maximum(np.diff(offsets), 1)
    return np.where(has, best, len(model.langs)), np.where(has, score, 0.0), np.where(has, least / size, 0.0)


#: Whether a text has a letter; null has none.
def _letter(text: str = "text"):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: PPM, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``.

    The language with the shortest code wins, ties by name; score is its share of
    the posterior under equal priors. A text that is null or has no letter, or any
    text when nothing was learned, is ``und`` with score 0. Texts of any length are coded
    whole, part by part. Rows repeat as given, an empty table gives an empty result.
    Only ``text`` is read. Columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte", "_letter")]
    docs = docs.select(*cols, _letter().alias("_letter"))

    def make(batch: pa.RecordBatch):
        model = shared.value
        best, score, size = _best(model, batch.column("text"), batch.column("_letter"))
        names = np.array([*model.langs, "und"], object)
        return pa.array(names[best], pa.string()), pa.array(score), pa.array(size)

    return add_columns(docs, [("lang_pred", "string"), ("score", "double"), ("bits_per_byte", "double")], make, without=(*without, "_letter"))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` and predict each of its rows: doc_id, held_out, lang_pred, score.

    Null and wordless texts are ``und``, with a null id not held out. Repeated rows come
    as often as given, other columns are not read, and an empty table gives an empty result.
    """
    model = fit(docs)
    found = predict(docs.select("doc_id", "text"), model, without=("text",))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a known language, all columns as they are, whatever their names.

    Goes: a null text, one without a letter, and one that no language codes in fewer bits
    than a uniform choice among the learned symbols would take. Rows repeat as given, and
    an empty table stays empty.
    """
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = float(np.log2(model.n))

    def mask(text: pa.Array, letter: pa.Array) -> np.ndarray:
        best, _, size = _best(shared.value, text, letter)
        return (best < len(shared.value.langs)) & (size < most)

    return keep_rows(docs, {"text": "text", "letter": _letter()}, mask)
