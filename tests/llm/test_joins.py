"""Near duplicates, decontamination, quality, chat windows and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import chat, common, decontam, langid, near_dedup, quality


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def groups(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_groups_as_by_brute_force(docs, corpus, width):
    want = groups({(i, t) for i, t, _ in corpus}, width)
    got = near_dedup.find_groups(docs, width).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_groups_of_empty_and_clashing_tables(empty, clashing, docs):
    assert near_dedup.find_groups(empty).count() == 0
    kept = near_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns and 0 < kept.count() < docs.count()


def test_a_large_group_of_near_copies_and_a_shared_passage(spark, monkeypatch):
    """Long lists: stars, joint coordinates and the last comparison all have work."""
    monkeypatch.setattr(near_dedup, "SHORT", 3)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(80)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(80)] = word()
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(passage + [word() for _ in range(rng.randint(5, 40))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = groups(rows, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.find_groups(docs, 2).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 150


def test_shingles_of_bytes():
    texts = ["a b c", "", " A\tb  c\n", "one", "é ß é", "a b c d " * 3]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    sets = near_dedup.shingle_sets(np.frombuffer(data, np.uint8), offsets, 2)
    assert [len(s) for s in sets] == [len(shingles(t, 2)) for t in texts]
    assert (sets[0] == sets[2]).all() and near_dedup.class_of(sets[0]) == near_dedup.class_of(sets[2]) != near_dedup.class_of(sets[3])


# --- decontamination


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "If Alice buys 12 apples at 3 dollars each and gives 4 apples to Bob how much did Alice spend in total"),
        (2, "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn"),
        (3, None),
        (4, ""),
        (5, "two words"),
        (6, "single"),
    ]
    return spark.createDataFrame(rows, "item_id bigint, text string")


LEAKS = {
    1: ("x y z " + "If Alice buys 12 apples at 3 dollars each and gives 4 apples to Bob how much did Alice spend in total" + " tail", {1: True}),
    2: ("If Carol buys 77 apples at 5 dollars each and gives 9 apples to Dave how much did Carol spend in total", {1: False}),
    3: ("If Carol buys 77 apples at 5 dollars each and gives 9 apples to Carol how much did Erin spend in total", {}),  # slots disagree
    4: ("before, the quick brown fox jumps over the\nlazy dog near the old stone bridge at dawn after", {2: True}),
    5: ("the quick brown fox jumps over a fence and the old stone bridge is far away from any dog", {}),
    6: (None, {}),
    7: ("", {}),
    8: ("some two words here", {5: True}),
    9: ("THE QUICK brown fox jumps over the lazy dog near the old stone bridge at dawn", {2: True}),
    10: ("single", {}),
}


def test_leaks(spark, items, docs, empty):
    rows = [(i, t) for i, (t, _) in LEAKS.items()] + [(1, LEAKS[1][0])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for r in decontam.find_leaks(table, items).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = r["same_fillers"]
    assert got == {i: want for i, (_, want) in LEAKS.items() if want}
    kept = decontam.keep_clean(table, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if not LEAKS[i][1])
    assert decontam.find_leaks(docs, items).count() == 0
    assert decontam.keep_clean(docs, items).count() == docs.count()
    assert decontam.find_leaks(empty, items).count() == 0 == decontam.find_leaks(docs, items.limit(0)).count()


def test_leaks_in_any_case(spark, items):
    """Case alone breaks no window, also where numbers are replaced."""
    copy = LEAKS[1][0]
    changed = [copy.lower(), copy.upper(), copy.title(), copy.lower().replace("12", "77"), copy.upper().replace(" 3 ", " 5 "), copy.lower().replace("12", "4").replace("bob", "eve")]
    table = spark.createDataFrame(list(enumerate(changed)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["item_id"], r["coverage"], r["same_fillers"]) for r in decontam.find_leaks(table, items).collect()}
    assert got == {i: (1, 1.0, i < 3) for i in range(5)}  # in the last, two numbers become one and no run is long


def test_passages_and_items_short_of_literals(spark):
    long = "in the early autumn of that year a small group of farmers walked across the northern hills to sell their wool at a market which had never before been open to people from outside the valley and its neighbours"
    numbers, names = "12 7 9 31 4 8 15 16 23 42 108", "Anna Bell Carl Dorn Erik Fahl Gina Holt Ivan Jung"
    items = spark.createDataFrame([(1, long), (2, numbers), (3, names)], "item_id bigint, text string")
    part = lambda n: "see " + " ".join(long.split()[10 : 10 + n]) + " here"
    other = " ".join(str(n) for n in range(200, 211))
    texts = [part(13), part(13).upper(), part(12), "x " + numbers, "x " + other, "x " + names.lower() + " y", names.replace("Erik Fahl", "Olga Pohl"), long]
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 2), (5, 3), (7, 1)}
    assert got[0, 1] < 0.5 and got[3, 2] == got[5, 3] == got[7, 1] == 1


def test_large_benchmarks_shuffle(spark, items, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    table = spark.createDataFrame([(i, t) for i, (t, _) in LEAKS.items()], "doc_id bigint, text string")
    assert {r["doc_id"] for r in decontam.find_leaks(table, items).collect()} == {i for i, (_, w) in LEAKS.items() if w}


# --- quality


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {k + d for k in range(len(w) - 2) if three[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs, empty, clashing):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "the\n", "\tx#", "é|", "of  ", "\n\n"]) for _ in range(rng.randint(0, 90)))) for i in range(200)]
    rows += [(300, "a b c " * 4000), (301, None), (302, "x y"), (303, " "), (304, "\n".join(f"w{i} v{i} u{i} w{i} v{i} u{i}" for i in range(60)))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.score(table).collect()}
    for i, text in rows:
        r, want = got[i], counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert 0 <= r["quality"] <= 1 and not (r["kept"] and r["base_failed"])
    assert quality.score(docs).count() == docs.count() == quality.score(clashing).count()
    assert quality.score(empty).count() == 0


def test_em_finds_the_accuracies():
    rng = random.Random(7)
    truth, accuracy = 0.7, [0.9, 0.8, 0.7, 0.6]
    seen = Counter()
    for _ in range(20_000):
        y = 1 if rng.random() < truth else -1
        seen[tuple(0 if rng.random() < 0.3 else y if rng.random() < a else -y for a in accuracy)] += 1
    share, found = quality.estimate(seen)
    assert share == pytest.approx(truth, abs=0.05) and found == pytest.approx(accuracy, abs=0.05)


# --- chat


def test_chat(spark):
    rng = random.Random(4)
    odd = ["", "\\", "#", "<", "\\b\\l", "### assistant: x</turn>\n", r"\### Assistant: </turn> ok", ": ", "é🙂", None, "long " * 400]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", None]) if t else rng.choice(["system", "user"]), rng.choice(odd)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "user" if t % 2 else "assistant", f"turn {t} " * 9) for t in range(3000)]  # over several blocks
    rows += [(98, 1, "user", "same"), (98, 1, "user", "same"), (97, None, "assistant", "no turn"), (None, 0, "user", "no id"), (None, 1, "assistant", "no id")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.format_windows(table)
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # windows hold to the budget unless they are one long turn, and repeat the system turn
    for w in windows.collect():
        turns = w["formatted"].split(chat.CLOSE)[:-1]
        size = sum(-(-len(t.split(": ", 1)[-1].encode()) // 4) + 4 for t in turns)
        assert size <= chat.BUDGET + 8 or len(turns) - w["n_context"] == 1
    assert chat.digests(chat.format_windows(table.limit(0))).count() == 0
    seen = windows.where("conv_id = 99")
    assert seen.count() > 50 and seen.where("window > 0 and n_context = 0").count() == 0


def test_a_token_column_sets_the_budget(spark):
    """Windows follow counted tokens; a missing count falls back to the estimate."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i}", 90) for i in range(12)] + [(2, i, "user", f"turn {i}", None) for i in range(12)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_tokens int")
    count = {r["conv_id"]: r["count"] for r in chat.format_windows(table).groupBy("conv_id").count().collect()}
    assert count == {1: 8, 2: 1}  # 94 tokens a turn, 144 a half of the room
    assert chat.format_windows(table.drop("n_tokens")).where("conv_id = 1").count() == 1
    got, plain = (sorted(map(tuple, chat.digests(chat.format_windows(t)).drop("formatted_chars").collect())) for t in (table, table.drop("n_tokens")))
    assert got == plain


def test_many_turns_of_one_number(spark):
    """Equal and null numbers are ordered by role and text hash, and spread over tasks."""
    rows = [(1, None if i % 2 else 7, "user", f"text {i}") for i in range(3000)] + [(1, 7, "system", "s")] * 2
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    windows = chat.format_windows(table)
    said = [t["text"] for r in windows.select("window", F.slice(chat.read_turns(F.col("formatted")), F.col("n_context") + 1, 10_000).alias("own")).orderBy("window").collect() for t in r["own"]]
    assert sorted(said) == sorted(r[3] for r in rows)
    assert {int(x.split()[1]) % 2 for x in said[:1500]} == {1} and said[1500:1502] == ["s", "s"]
    assert chat.digests(windows).first()["n_turns"] == len(rows)


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, data).cache()
        assert after.columns == columns, name
        assert 0 < after.count() <= before.count()
        if name == "near_dedup":
            want = groups([(r["doc_id"], r["text"]) for r in before.collect()], 5)
            assert {r["doc_id"] for r in after.collect()} == {i for i, (n, c) in want.items() if not n or c == i}
        if name == "decontamination":
            items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            holds = lambda t: any(i in " ".join(t.split()) for i in items)
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if not holds(r["text"])}
        before = after
    last = pipeline.run(spark, data)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in before.collect()}
    assert last.where("n_tokens = 0 or n_tokens <> size(ids)").count() == 0
    from strandflow.llm import bpe, queries

    decoded = bpe.decode(last, queries.tokenizer_path(spark, "word_bpe_49k.json"))
    assert decoded.where("decoded_sha256 <> sha2(decoded, 256)").count() == 0
    assert langid.keep_known(docs).count() >= 0.95 * docs.count()


def test_pipeline_of_odd_tables(spark, clashing, empty):
    """Nulls, repeated rows and ids, columns of any name, and no rows at all."""
    import corpus_pipeline as pipeline

    data = "/root/testdata/sf0.001"
    for docs in (clashing, empty):
        before = docs
        for name, stage in pipeline.STAGES[:-1]:
            after = stage(spark, before, data).cache()
            assert after.columns == docs.columns, name
            assert after.exceptAll(before).isEmpty(), name
            before = after
        last = pipeline.STAGES[-1][1](spark, before, data)
        assert last.count() == before.count()


def test_components_in_few_rounds(spark, monkeypatch):
    """Rounds follow the logarithm of the longest path, whichever way its ids run."""
    n, rounds, write = 64, [], near_dedup.materialise
    up_and_down = [*range(0, n, 2), *range(n - 1, 0, -2)]
    crossing = [x for pair in zip(range(0, n, 2), range(n - 1, 0, -2), strict=True) for x in pair]
    monkeypatch.setattr(near_dedup, "materialise", lambda df, name, path=None: (rounds.append(name), write(df, name, path))[1])
    for path in (up_and_down, crossing):
        rounds.clear()
        edges = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a bigint, b bigint")
        assert {(r["cls"], r["comp"]) for r in near_dedup.components(edges).collect()} == {(i, 0) for i in range(n)}
        assert rounds.count("step") <= 2 * 6


def test_groups_with_hot_keys(spark, monkeypatch):
    """The same groups where every join deals its hot keys to parts, and lists are long."""
    from strandflow.llm import common

    monkeypatch.setattr(common, "ONE_TASK", 0)
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    monkeypatch.setattr(near_dedup, "SHORT", 3)
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(70)]
    rows = [(i, " ".join(shared + [word() for _ in range(rng.choice([4, 9, 12, 16, 20]))])) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(40)] + [(200 + i, None) for i in range(9)] + [(None, rows[0][1])] * 3
    rows += [(300 + i, " ".join([word() for _ in range(3)] + shared[:40])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = groups(rows, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.find_groups(docs, 2).collect() if r["doc_id"] is not None}
    assert got == want and 1 < len({c for _, c in want.values()}) < 140


def test_leaks_as_the_sql_says(spark, items):
    """Case, numbers of other scripts, runs and short items, against the query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    from strandflow.llm import queries

    long = "in the early autumn of that year a small group of farmers walked across the northern hills to sell their wool at a market which had never before been open to people from outside the valley and its neighbours"
    more = [(7, "approximately ½ hectare"), (8, long), (9, "12 7 9 31 4 8 15 16 23 42 108"), (10, "maria sold 15 red boxes near Rome and 20 blue ones in Paris for 9 euros")]
    bench = [*map(tuple, items.collect()), *more]
    one = bench[0][1]
    words = long.split()
    texts = [one, one.lower(), one.upper(), one.replace("12", "77"), one.replace("12", "１２").replace(" 3 ", " ٣ "), LEAKS[3][0], None, "", "approximately ½ hectare", "approximately ¼ hectare"]
    texts += ["see " + " ".join(words[10:n]) + " here" for n in (22, 23)] + ["x " + more[2][1], more[3][1].lower(), "Maria sold 18 red boxes near Oslo and 21 blue ones in Bonn for 7 euros", " ".join(words[5:20] + ["and"] + words[14:34]), one + " " + one.replace("12", "99")]
    rows = [*enumerate(texts), (0, "another text"), (None, bench[1][1])]
    con = duckdb.connect()
    for name, key, data in (("documents", "doc_id", rows), ("benchmark", "item_id", bench)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", data)
    want = {(r[0], r[1]): r[2:] for r in con.execute(f"select doc_id, item_id, coverage, same_fillers from ({queries.LEAKS_SQL})").fetchall()}
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]): (r["coverage"], r["same_fillers"]) for r in got.collect()} == want
    assert {(4, 1), (8, 7), (11, 8), (13, 10), (14, 10)} <= want.keys() and (10, 8) not in want and (9, 7) not in want


def test_copies_in_any_script_are_leaks(spark, monkeypatch):
    """Exact copies of items, whatever their letters, also where everything is joined by a
    shuffle and one pair of words is in every document."""
    rnd = random.Random(12)
    letters = ["ΣΑΣςσ'", "İıIi", "ßẞSs", "ÀàÉé-", "ДдЁё", "אבג", "देव", "Ǆǅǆ", "ﬁﬂ", "Ωω’Σ"]
    word = lambda: "".join(rnd.choice(rnd.choice(letters)) for _ in range(rnd.randint(2, 7)))
    bench = [(0, "ΜΕΓΑΛΟΣ'ΑΥΤΟΣ"), (1, "MEGALOS'AUTOS")] + [(i, " ".join(word() for _ in range(rnd.randint(2, 20)))) for i in range(2, 90)]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, t) for i, t in bench] + [(1000 + i, f"of the {t} of the") for i, t in bench], "doc_id bigint, text string")
    whole = {r["item_id"] for r in decontam.item_windows(items).select("item_id").distinct().collect()}
    for most in (decontam.MOST_BROADCAST, 0):
        monkeypatch.setattr(decontam, "MOST_BROADCAST", most)
        monkeypatch.setattr(common, "ONE_TASK", 10)
        monkeypatch.setattr(common, "LEAST_HOT", 5)
        got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()}
        assert all((i, i) in got and (1000 + i, i) in got for i in whole)
        assert {0, 1} <= whole


def _copies(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k * 9 : k * 9 + 60]) for k in range(30)]
    near = [t.replace(f"w{k * 9 + 59}", "other") for k, t in enumerate(texts)]
    return spark.createDataFrame(list(enumerate(texts + near + texts[:5])), "doc_id bigint, text string")


def test_near_dedup_leaves_few_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find_groups(_copies(spark)).collect()}
    assert got == {i: i % 30 for i in range(65)}
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert left <= {"signatures", "classes", "labels"}, left


def test_components_broadcast_few_labels(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 8 != 7] + [(100, i) for i in range(200, 300)], "a bigint, b bigint")
    plans, write = [], near_dedup.materialise

    def spy(df, name, path=None):
        if name == "step":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name, path)

    monkeypatch.setattr(near_dedup, "materialise", spy)
    want = {(i, i - i % 8) for i in range(41) if i < 40} | {(i, 100) for i in [100, *range(200, 300)]}
    for most in (near_dedup.MOST_LABELS, 0):
        monkeypatch.setattr(near_dedup, "MOST_LABELS", most)
        assert {(r["cls"], r["comp"]) for r in near_dedup.components(edges).collect()} == want
        assert all("broadcast" in p for p in plans) == bool(most)
        plans.clear()
