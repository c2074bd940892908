import random

import pytest
from pyspark.sql import functions as F

#: Rows that every operator has to bear: nulls, empty and wordless texts, repeats, ties.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang): four made languages, near and exact copies, odd rows."""
    rng = random.Random(5)
    alphabets = {"aa": "abcdeé", "bb": "fghijß", "cc": "klmnoñ", "dd": "pqrstù"}
    rows = []
    for i in range(200):
        lang = sorted(alphabets)[i % 4]
        rows.append((i, " ".join(words(rng, rng.randint(30, 120), alphabets[lang])), lang))
    for i in range(200, 240):  # near copies: a few words changed
        text = rows[i - 200][1].split(" ")
        text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text), rows[i - 200][2]))
    rows += [(i, rows[i - 240][1], rows[i - 240][2]) for i in range(240, 260)]
    rows += [(300, None, "aa"), (301, "", None), (302, " \n\t ", "bb"), (303, "123 456 !!", None), (304, "A", "cc"), (305, "abc " * 30000, "aa")]
    rows += [rows[3], rows[3], (None, "no id here at all", "aa"), (None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in corpus]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named like those that operators add."""
    names = ["lang_pred", "score", "predicted", "ids", "decoded", "kept", "cls", "sig", "digest", "n_tokens", "quality", "labels", "_letter", "rule"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
