"""URL filter: host and path rules, else logistic regression on hashed n-grams.

The model is trained on the driver from a small labelled URL table, which is a parameter;
the default one is built by rule from stated word lists. Host and path have n-grams of
their own, hashed into one bounded weight vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, hot_keys, salted_join

#: The rules (host/path-prefix) and their verdicts.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

#: Words, host endings and paths that the default labelled table is built from.
#: The first list marks a host or path wherever it stands, the second as a whole token only.
BLOCK_PARTS = "casino escort gambling hentai jackpot lottery milf poker porn viagra xvideos xxx".split()
BLOCK_TOKENS = "adult ads banner bet bets bonus cheap click coupon escorts free girls hot loan loans nude pharma pills promo sex slots spam track tracker win".split()
BLOCK_WORDS = [*BLOCK_PARTS, *BLOCK_TOKENS]
ALLOW_WORDS = (
    "academy airport alphabet animal archive area art atlas author autumn baker bank basket battery beach better bicycle bird board boat book books "
    "bridge brother build cabin camera canal candle castle center chemistry child church citizen city climate clinic cloud coast coffee college color community "
    "concert cook corner cotton council country courier craft culture daily dance data design digital dinner doctor docs drama earth economy editor engine estate europe "
    "evening event factory family farm fashion field film finance fish flower food football forest forum fruit future gallery garden gazette global gold green guide "
    "guitar harbor health heart herald history home honey horse hospital house idea industry island journal kitchen labor lake language law learn letter library "
    "light local machine magazine map marine market math medical memory metal mirror modern money morning mountain museum music nature network news north note "
    "ocean office open opera orange outdoor paper park people phone photo physics planet plant police post press project public radio "
    "rail recipe report research review river road roads school science season shop society sport spring station stone story street student studio summer "
    "teacher theater tower travel tree valley video village water weather wiki window winter wood work world"
).split()
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
PREFIXES = ["", "www.", "m.", "blog."]
#: What stands around a block word inside a neutral one.
FRONTS = ["es", "mid", "sus", "un", "up", "down", "time", "sound", "al", "s", "ca", "de", "dar", "ph", "ro", "out", "bro"]
BACKS = ["s", "ed", "er", "ing", "y", "el", "land", "ston", "ham", "burg", "field", "house", "ter", "chester", "ors", "ology", "ic", "on", "a"]
ENDINGS = [".com", ".net", ".org", ".de", ".co.uk", ".mysite.com", ".pages.dev", ".homepage.org"]
PATHS = ["", "/", "/about", "/contact/", "/index.html", "/news/2024/05/31/story", "/post/7/", "/a/b", "/img/logo.png", "/products/12", "/page-3.html", "/docs/v2/guide"]

PATH_WORDS = (
    "about account admin api archive article assets blog browse careers cart category comments company contact content courses data docs download events faq feed files forum "
    "help home images index info item jobs language latest login media members menu page pages photos policy post posts privacy product products profile program project projects protocol "
    "search section service services share sitemap static stories support tag tags team terms topic upload user users videos view wiki"
).split()

#: Other paths that each host of the table is with.
TURNS = 3

#: Rules that fit in each worker; longer lists are joined (``match_rules``).
MOST_RULES = 10_000
BITS = 18
SIZES = (3, 4, 5, 6, 7)
THRESHOLD = 0.5
#: Weight of the rows with label 1 in training.
PRIOR = 0.5


def made_words(number: int) -> list[str]:
    """Words of two to four syllables, by rule: neutral ones in a great variety, so that
    what marks a neutral host is that no block word is in it."""
    n = len(SYLLABLES)
    at = lambda k, step: SYLLABLES[(k * step + k // n * (step + 2) + step) % n]
    return ["".join(at(k, step) for step in (1, 7, 11, 17)[: 2 + k % 3]) for k in range(number)]


def labelled_urls(block: Sequence[str] = BLOCK_WORDS, allow: Sequence[str] = ALLOW_WORDS, paths: Sequence[str] = PATHS, made: int = 200) -> list[tuple[str, str, int]]:
    """(host, path, label) rows: 1 if the host or the path is marked by a block word, else 0.

    A marked host has a block word as a token among neutral ones, or one of BLOCK_PARTS run
    together with one or inside a made word. Neutral hosts are of neutral words and of made words that hold a word of
    BLOCK_TOKENS inside (as *essex* holds *sex*), so that such a word is told by where it
    ends. Each has every prefix and endings in turn. Paths are the given neutral ones,
    folders and pages of neutral words, and folders of block words; hosts take one of the first
    and some of the others in turn. So prefixes, endings and neutral paths are as often with hosts
    of either label.
    """
    plain = made_words(made)
    neutral = [*allow, *plain]
    n = len(SYLLABLES)
    around = [*((f, "") for f in FRONTS), *(("", b) for b in BACKS), *((FRONTS[j * 5 % len(FRONTS)], BACKS[j * 7 % len(BACKS)]) for j in range(20))]
    within = lambda words: [x for x in dict.fromkeys(f"{front}{word}{back}" for word in words for front, back in around) if x not in block]
    inside, marked = within([w for w in block if w not in BLOCK_PARTS]), within([w for w in block if w in BLOCK_PARTS])

    def hosts(words: Sequence[str], label: int, mates: int) -> list[tuple[str, int]]:
        def forms(word: str) -> tuple[str, ...]:
            joined = ("{1}{0}", "{0}{1}") if word not in block or word in BLOCK_PARTS else ("{1}-{0}-{1}", "{0}{2}")
            return ("{0}-{1}", "{1}-{0}", *joined)

        bodies = list(words) + [forms(word)[j % 4].format(word, neutral[(k * mates + j) * 7 % len(neutral)], 5 * j + k % 7) for k, word in enumerate(words) for j in range(mates)]
        return [(f"{p}{body}{ENDINGS[(i + k) % len(ENDINGS)]}", label) for k, body in enumerate(bodies) for i, p in enumerate(PREFIXES)]

    shapes = ("/{0}/{1}", "/{0}-{1}.html", "/{2}/{1}/{0}", "/{0}")
    spread = lambda words, label: [(shapes[k % 4].format(w, 37 * k % 1000, SYLLABLES[k % n]), label) for k, w in enumerate(words)]
    where = [*spread([*allow, *plain[::3], *inside, *PATH_WORDS, *PATH_WORDS[1:]], 0), *spread([w for w in block for _ in shapes], 1)]
    rows = []
    for found in (hosts(block, 1, 24) + hosts(marked[::2], 1, 1), hosts(neutral, 0, 4) + hosts(inside, 0, 1)):
        for k, (host, a) in enumerate(found):
            body, turn = divmod(k, len(PREFIXES))
            rows.append((host, paths[(body + 3 * turn) % len(paths)], a))
            rows += [(host, path, a | b) for path, b in (where[(k * TURNS + j) % len(where)] for j in range(TURNS))]
    return rows


def _grams(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct n-grams of each text between two marks."""
    raw = [b"\x02" + t.encode() + b"\x03" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum([len(r) for r in raw])
    row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    rows, buckets = [], []
    for size in SIZES:
        m = len(data) - size + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for k in range(size):
            h = h * np.uint64(1099511628211) + data[k : m + k]
        inside = np.arange(m) + size <= ends[row[:m]]
        h = (h + np.uint64(size * 2 + salt)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append(row[:m][inside])
        buckets.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return (np.zeros(0, np.int64),) * 2
    found = np.unique(np.concatenate(rows).astype(np.int64) << BITS | np.concatenate(buckets))
    return found >> BITS, found & ((1 << BITS) - 1)


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams of each host and path, and the factor of each row's sum:
    1, so that a long path doesn't thin out what the host says."""
    (r1, b1), (r2, b2) = _grams(hosts, 0), _grams(paths, 1)
    return np.concatenate([r1, r2]), np.concatenate([b1, b2]), np.ones(len(hosts))


def _descend(texts: list[str], salt: int, y: np.ndarray, offset: float | None, rounds: int, rate: float, decay: float, centre: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, whose bias may be given as ``offset`` and whose
    weights are then zero or more, on the n-grams of ``texts``, by gradient descent with steps scaled for each weight.

    Loss: mean log loss, with a share of PRIOR for label 1, + decay * squared weights +
    centre * the mean squared sum of the texts with label 0.
    """
    row, bucket = _grams(texts, salt)
    used, at = np.unique(bucket, return_inverse=True)
    share = np.where(y > 0, PRIOR / max(y.sum(), 1), (1 - PRIOR) / max((1 - y).sum(), 1))
    w, mean, spread, bias = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), offset or 0.0
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[at], len(texts))
        score = 1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))
        err = (score - y) * share
        g = np.bincount(at, (err + 2 * centre * z * (1 - y) / len(texts))[row], len(used)) + 2 * decay * w
        mean, spread = 0.9 * mean + 0.1 * g, 0.99 * spread + 0.01 * g * g
        w = w - rate * (1 - k / (rounds + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
        if offset is not None:
            w = np.maximum(w, 0)
        else:  # a Newton step: what all rows share should stand in the bias
            bias -= 0.5 * err.sum() / max((score * (1 - score) * share).sum(), 1e-3)
    out = np.zeros(1 << BITS)
    out[used] = w
    return out, bias


def train(rows: Iterable[tuple[str, str, int]], rounds: int = 150, rate: float = 0.05, decay: float = 1e-4, centre: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) by two logistic regressions, hosts first.

    A host's label is the least of its urls', and so is a path's: what a marked path adds isn't
    the host's. The bias comes from the hosts. Paths are trained with the bias of an average
    neutral host, weights of zero or more, and the sums of neutral ones held at zero: what no
    marked path has weighs nothing, a neutral path moves no verdict, and a marked one blocks.
    """
    least: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for host, path, label in rows:
        for of, text in zip(least, (host, path), strict=True):
            of[text] = min(label, of.get(text, 1))
    (hosts, y), (paths, marked) = ((sorted(of), np.array([of[t] for t in sorted(of)], float)) for of in least)
    w, bias = _descend(hosts, 0, y, None, rounds, rate, decay, 0.0)
    row, bucket = _grams(hosts, 0)
    usual = float((np.bincount(row, w[bucket], len(hosts)) + bias)[y == 0].mean()) if (y == 0).any() else bias
    of_paths, _ = _descend(paths, 1, marked, usual, rounds, rate, decay, centre)
    return np.append(w + of_paths, bias)


def parts(url: str = "url"):
    """Columns host and path of a URL; both empty if it is null or has no ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path")


def best_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> str | None:
    """The longest rule (host with subdomains, path prefix) that fits; of equals the one with the longer host."""
    best, labels = None, host.split(".")
    for k in range(len(labels)):  # from the whole host to its last label
        suffix = ".".join(labels[k:])
        for prefix, rule in rules.get(suffix, ()):
            if path.startswith(prefix) and (best is None or len(rule) > len(best)):
                best = rule
    return best


def by_host(rules: Iterable[str]) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for rule in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule))
    return out


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) of ``urls`` with the rule that fits, for rule lists of any size.

    ``rules``: (rule, verdict). Joins the host's suffixes, each with the path cut to the
    lengths that rules have, so that only what fits meets; hot keys are dealt to many tasks.
    """
    listed = rules.select("rule", "verdict", F.regexp_extract("rule", "^[^/]*", 0).alias("_suffix"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("_prefix"))
    lengths = sorted(r[0] for r in listed.select(F.length("_prefix")).distinct().collect())  # as many as rules have lengths
    labels = F.split("host", r"\.")
    wide = urls.select("host", "path").distinct().select("host", "path", labels.alias("_labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("_k"))
    wide = wide.select("host", "path", F.array_join(F.slice("_labels", F.col("_k"), F.size("_labels")), ".").alias("_suffix"), F.explode(F.lit(lengths).cast("array<int>")).alias("_n"))
    wide = wide.where(F.length("path") >= F.col("_n")).select("host", "path", F.struct("_suffix", F.left("path", F.col("_n")).alias("_prefix")).alias("_key"))
    listed = listed.select("rule", "verdict", F.struct("_suffix", "_prefix").alias("_key"))
    counts = wide.groupBy("_key").agg(F.count("*").alias("n"))
    fits = salted_join(wide, listed, "_key", hot_keys(counts, "_key", wide.count()))
    best = F.max(F.struct(F.length("rule"), F.length("_key._suffix"), "rule", "verdict")).alias("m")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "m.rule", "m.verdict")


def judge(pages: DataFrame, rules: dict[str, str] | None = None, model: np.ndarray | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's) of every row.

    A rule's verdict holds; without one, the model's at ``THRESHOLD``. A null url or one
    without ``://`` has an empty host and path and is judged as such; long urls are judged
    whole. Row-wise, so repeated rows and hot hosts don't matter. Other columns are not
    read, and an empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    model = train(labelled_urls()) if model is None else model
    spark = pages.sparkSession
    short = len(rules) <= MOST_RULES
    shared = spark.sparkContext.broadcast((model.astype(np.float32), by_host(rules) if short else {}, rules if short else {}))

    def make(batch: pa.RecordBatch):
        w, hosts_of, verdicts = shared.value
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        row, bucket, scale = _features(hosts, paths)
        z = np.bincount(row, w[:-1][bucket], len(hosts)) * scale + w[-1]
        score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        rule = [best_rule(h, p, hosts_of) for h, p in zip(hosts, paths, strict=True)]
        verdict = [verdicts[r] if r else "block" if s >= THRESHOLD else "allow" for r, s in zip(rule, score, strict=True)]
        return pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(score)

    out = add_columns(pages.select("page_id", *parts()), [("rule", "string"), ("verdict", "string"), ("score", "double")], make)
    if short:
        return out
    listed = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    matched = match_rules(out, listed).select(F.struct("host", "path").alias("_url"), "rule", F.col("verdict").alias("_verdict"))
    keyed = out.drop("rule").withColumn("_url", F.struct("host", "path"))
    hot = hot_keys(keyed.groupBy("_url").agg(F.count("*").alias("n")), "_url", keyed.count())
    joined = salted_join(keyed, matched, "_url", hot, "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_verdict", "verdict").alias("verdict"), "score")
