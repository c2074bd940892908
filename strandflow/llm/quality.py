"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Each rule votes good, bad or abstains on a document. The votes of all documents are
counted by pattern, of which there are at most 3 ** rules; expectation-maximisation over
these counts estimates the share of good documents and each rule's accuracy, and a
document's posterior probability of being good decides. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

ROUNDS = 50
#: Accuracies stay in this range: a rule is better than chance, and never certain.
ACCURACY = (0.55, 0.98)
LEAST_WORDS = 50
#: Distinct repeated windows up to which each word looks them up.
FEW_TWINS = 24
MOST_REPEATED = 50

_SPACE = " \t\n\x0b\f\r"

#: Very frequent words of four languages.
COMMON = "the of and to in is that it was for der die und das nicht mit von ist ein den le la les et des un une que est dans el los las de y en por con una".split()


def _words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text without nulls."""
    core = F.btrim(text, F.lit(_SPACE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first included."""

    def count(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def covered(t: Column) -> Column:
        twins = lambda s: F.array_distinct(F.filter(s, lambda h, j: F.get(s, j + 1) == h))

        def by_lookup(d: Column) -> Column:
            return F.array_compact(F.transform(t, lambda h, i: F.when(F.array_contains(d, h), i)))

        def by_order() -> Column:
            ordered = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            same = lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(_let(ordered, same), lambda x: x["i"]))

        # a few repeated windows are looked up one by one; many are found by sorting
        places = lambda d: F.when(F.size(d) <= FEW_TWINS, by_lookup(d)).otherwise(by_order())
        return count(_let(_let(F.sort_array(t), twins), places))

    def of(w: Column) -> Column:
        n = F.size(w)
        windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
        return _let(windows, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), covered(t)).otherwise(0))

    return _let(words, of)


def measures(docs: DataFrame) -> DataFrame:
    """The counts that the rules use, one row per row of ``docs``; a null text is empty."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.size(F.array_intersect(w, F.lit(COMMON))).alias("common"), repeated_words(w).alias("repeat"))
    of_lines = lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    out = text.select(
        "doc_id",
        _let(_words(F.col("text")), of_words).alias("word"),
        _let(lines, of_lines).alias("line"),
        (F.size(F.split("text", "[#*$%&|<>]", -1)) - 1).cast("bigint").alias("n_symbols"),
        ((F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))).alias("all_capitals"),
    )
    named = {"n_words": "word.n", "word_chars": "word.chars", "n_common": "word.common", "n_repeat_words": "word.repeat", "n_lines": "line.n", "n_dup_lines": "line.dup"}
    return out.select("doc_id", "n_symbols", "all_capitals", *[F.col(c).cast("bigint").alias(n) for n, c in named.items()])


def rules() -> dict[str, tuple[Column, Column]]:
    """Of each rule: when it votes good, and when bad; else it abstains."""
    n, c = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": ((n >= 80) & (n <= 100_000), n < LEAST_WORDS),
        "symbols": (F.col("n_symbols") * 50 <= n, F.col("n_symbols") * 4 >= n),
        "lines": ((F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 2), F.col("n_dup_lines") * 3 >= F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": (F.col("n_repeat_words") * 10 <= n, F.col("n_repeat_words") * 3 >= F.greatest(n, F.lit(1))),
        "word_length": ((c >= n * 3) & (c <= n * 9), (c < n * 2) | (c > n * 14)),
        "capitals": (F.lit(False), F.col("all_capitals")),
        "common": (F.col("n_common") >= 3, F.col("n_common") == 0),
    }


def estimate(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """EM over vote patterns (1 good, -1 bad, 0 abstain) and their counts.

    Returns the share of good documents and each rule's accuracy where it votes.
    """
    if not counts:
        return 0.5, []
    m = len(next(iter(counts)))
    share, accuracy, total = 0.7, [0.75] * m, sum(counts.values())
    for _ in range(rounds):
        good, right, votes = 0.0, [1.0] * m, [1.0 / 0.75] * m  # one pseudo-vote
        for pattern, count in counts.items():
            p = posterior(pattern, share, accuracy)
            good += p * count
            for j, v in enumerate(pattern):
                if v:
                    votes[j] += count
                    right[j] += count * (p if v > 0 else 1 - p)
        share = min(max(good / total, 0.01), 0.99)
        accuracy = [min(max(r / v, ACCURACY[0]), ACCURACY[1]) for r, v in zip(right, votes, strict=True)]
    return share, accuracy


def posterior(pattern: tuple[int, ...], share: float, accuracy: list[float]) -> float:
    """P(good | votes), the rules independent given the truth."""
    z = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, accuracy, strict=True))
    return 1 / (1 + math.exp(-z))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, quality (the posterior) and kept of every row.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. kept:
    not base_failed and a posterior of at least one half. A null or empty text has no words
    and fails. Row-wise but for the counts of vote patterns, over all rows; rows repeat
    as given, and other columns are not read. An empty table gives an empty result.
    """
    n, votes = F.col("n_words"), rules()
    code = F.lit(0)
    for j, (good, bad) in enumerate(votes.values()):
        code = code + F.when(bad, 0).when(good, 2).otherwise(1) * 3**j
    failed = (n < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > n * MOST_REPEATED)
    rows = materialise(measures(docs), "measures").select("*", failed.alias("base_failed"), code.alias("votes"))
    m = len(votes)
    pattern = lambda x: tuple(x // 3**j % 3 - 1 for j in range(m))
    counts = {pattern(r["votes"]): r["count"] for r in rows.groupBy("votes").count().collect()}  # at most 3 ** m
    share, accuracy = estimate(counts)
    by_code = F.lit([round(posterior(pattern(x), share, accuracy), 9) if accuracy else 0.5 for x in range(3**m)])
    out = rows.withColumn("quality", F.get(by_code, F.col("votes")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
