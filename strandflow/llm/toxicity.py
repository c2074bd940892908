"""Toxicity: a logistic classifier regularised by counterfactual swaps.

A text is the set of its words. Words that occur unevenly in toxic and other labelled texts
become features, and so do identity terms, always. For every labelled text that names a
group, the texts with the term swapped for others are made, and the squared change of the
score is penalised; so the model can't learn that naming a group is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, held_out, in_training, keep_rows, materialise, pieces, release, utf8

#: Distinct labelled texts in the training sample (whole ones of any length), features,
#: documents a feature needs.
SAMPLE_DOCS = 20_000
MOST_FEATURES = 2_000
LEAST_DOCS = 4
#: Chi-square that a feature needs; far above what the many words reach by chance.
LEAST_CHI2 = 24.0
COUNTERFACTUAL = 1.0
DECAY = 1e-4

#: Identity terms that are swapped for each other within their kind.
IDENTITY = {
    "gender": "woman women man men girl girls boy boys transgender nonbinary female male".split(),
    "faith": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic catholics".split(),
    "origin": "african africans american americans arab arabs asian asians black european europeans indian indians latino latinos mexican mexicans chinese white".split(),
    "orientation": "gay gays lesbian lesbians straight bisexual queer homosexual heterosexual".split(),
    "other": "blind deaf disabled elderly immigrant immigrants migrant migrants refugee refugees old young".split(),
    "de": "frau frauen mann männer muslime christen juden ausländer flüchtlinge schwule".split(),
    "fr": "femme femmes homme hommes musulmans chrétiens juifs étrangers réfugiés".split(),
    "es": "mujer mujeres hombre hombres musulmanes cristianos judíos extranjeros refugiados".split(),
}

#: Bytes that end a word become spaces; A-Z become a-z; other bytes of letters stay.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float


#: Bytes of a text that are taken apart at a time.
CHUNK = 1 << 18


def words_of(text: str | bytes | None) -> set[bytes]:
    """The distinct words of a whole text: runs of letters, A-Z lower-cased."""
    if text is None:
        return set()
    raw = (text.encode() if isinstance(text, str) else text).translate(_TABLE)
    out: set[bytes] = set()
    for piece in pieces(raw, CHUNK):
        out.update(piece.split())
    return out


def train(docs: list[tuple[frozenset[str], int]], features: list[str], counterfactual: float = COUNTERFACTUAL, decay: float = DECAY, rounds: int = 800) -> Model:
    """Fit on (features present, label) pairs.

    Loss: mean log loss + counterfactual * mean squared score change over the swaps
    + decay * squared weights, by gradient descent with momentum.
    """
    names = sorted({*features, *(t for kind in IDENTITY.values() for t in kind)})
    at = {w: k for k, w in enumerate(names)}
    kin = {t: [u for u in kind if u != t] for kind in IDENTITY.values() for t in kind}
    row, col, out, into = [], [], [], []
    for r, (present, _) in enumerate(docs):
        for w in present:
            if w in at:
                row.append(r)
                col.append(at[w])
            if w in kin:  # every swap of this text's term within its kind
                for u in kin[w]:
                    if u not in present:
                        out.append(at[w])
                        into.append(at[u])
    row, col, out, into = (np.array(x, np.int64) for x in (row, col, out, into))
    y = np.array([label for _, label in docs], float)
    n, m = max(len(y), 1), len(names)
    w, v, bias, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    step = 1 / (1 + 4 * counterfactual)  # small enough for the penalty's curvature
    for _ in range(rounds):
        z = np.bincount(row, w[col], len(y)) + bias if len(row) else np.full(len(y), bias)
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = (np.bincount(col, err[row], m) if len(row) else np.zeros(m)) / n + 2 * decay * w
        if len(out):
            change = (w[out] - w[into]) * (2 * counterfactual / len(out))
            g += np.bincount(out, change, m) - np.bincount(into, change, m)
        v = 0.9 * v - step * g
        vb = 0.9 * vb - 0.5 * err.sum() / n
        w, bias = w + v, bias + vb
    return Model({t.encode(): float(x) for t, x in zip(names, w, strict=True) if abs(x) > 1e-6}, float(bias))


def _words(docs: DataFrame) -> DataFrame:
    """(toxic, words) of (toxic, text): the distinct words of each whole text."""

    def run(batches):
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = [[w.decode("utf-8", "ignore") for w in words_of(text)]]
                yield pa.RecordBatch.from_arrays([pa.array([toxic], pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])
        release()

    return docs.select("toxic", "text").mapInArrow(run, "toxic int, words array<string>")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Train on at most ``sample_docs`` distinct labelled texts, whole ones of any length:
    those of the ids, and then of the texts, with the smallest hashes.

    Only rows of the training fold with a label of 0 or 1 and a text count; copies of a text
    count once, whether under one id or many, an id labelled twice or a text with both
    labels takes the larger. Without labelled rows, or with one label only, that label is
    the model.
    """
    named = labels.where(in_training() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.xxhash64("text").alias("key"))
    keys = texts.groupBy("key").agg(F.max("toxic").alias("label")).orderBy("key").limit(sample_docs)
    rows = texts.drop("toxic").join(F.broadcast(keys.withColumnRenamed("key", "_key")), F.col("key") == F.col("_key"))
    rows = rows.groupBy("key", "label").agg(F.first("text").alias("text")).select(F.col("label").alias("toxic"), "text")
    words = materialise(_words(rows), "labelled-words")
    total = words.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = total["n"], total["t"]
    if not n or not t or t == n:
        return Model({}, 20.0 if n and t == n else -20.0)
    seen = words.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= LEAST_DOCS)
    rate = t / n
    chi2 = (F.col("t") - F.col("n") * rate) ** 2 / (F.col("n") * rate * (1 - rate)) * (n / F.greatest(n - F.col("n"), F.lit(1)))
    best = seen.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "word").limit(MOST_FEATURES)
    features = [r["word"] for r in best.select("word").collect()]
    wanted = sorted({*features, *(w for kind in IDENTITY.values() for w in kind)})
    found = words.select("toxic", F.filter("words", lambda w: w.isin(wanted)).alias("present"))
    sample = [(frozenset(r["present"]), r["toxic"]) for r in found.toLocalIterator()]
    return train(sorted(sample, key=lambda x: (x[1], sorted(x[0]))), features)


def scores(model: Model, text: pa.Array) -> np.ndarray:
    """The probability of label 1 of each whole text; a null or empty one has no words."""
    weights, known = model.weights, frozenset(model.weights)
    data, offsets = utf8(text)
    z = np.full(len(offsets) - 1, model.bias)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        raw = data[a:b].tobytes().translate(_TABLE)
        if len(raw) <= CHUNK:
            found = known.intersection(raw.split())
        else:
            found = set().union(*(known.intersection(piece.split()) for piece in pieces(raw, CHUNK)))
        z[i] += sum([weights[w] for w in found])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def predict(docs: DataFrame, model: Model, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Only ``text`` is read, all of it. A null or empty text has the score of no words.
    Row-wise: repeated rows and hot sources don't matter, and an empty table gives an empty
    result. Columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch):
        score = scores(shared.value, batch.column("text"))
        return pa.array(score), pa.array((score >= 0.5).astype(np.int32))

    return add_columns(docs, [("score", "double"), ("predicted", "int")], make, without)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and score every row: doc_id, held_out, score, predicted.

    Null and empty texts are scored like one without words; rows repeat as given, a null id
    is not held out, other columns are not read, and empty tables give an empty result.
    """
    scored = predict(docs.select("doc_id", "text"), fit(docs, labels), without=("text",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are, whatever
    their names; null and empty texts stay, and rows repeat as given."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return keep_rows(docs, {"text": "text"}, lambda text: scores(shared.value, text) < 0.5)
