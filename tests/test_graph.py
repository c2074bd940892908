"""The small hand-made graph, cutting, counting, and the sampler on them."""

import math
import random
from collections import Counter

import pandas as pd
import pytest

from strandflow.jobs import reconstruct
from strandflow.operators import align, chains, graph, intervals, layers, overlay, sampler, scoring

READS = {"GCT": 1, "GAT": 4, "CTT": 1, "ATT": 3, "TTA": 2, "TAT": 1, "TAC": 4, "ATA": 1, "ACA": 3}
STARTS = {"GCT": 0, "GAT": 0, "CTT": 1, "ATT": 1, "TTA": 2, "TAT": 3, "TAC": 3, "ATA": 4, "ACA": 4}
EDGES = {
    (0, "GC", "CT"): 1, (0, "GA", "AT"): 4, (1, "CT", "TT"): 1, (1, "AT", "TT"): 3, (2, "TT", "TA"): 2,
    (3, "TA", "AT"): 1, (3, "TA", "AC"): 4, (4, "AT", "TA"): 1, (4, "AC", "CA"): 3,
}


@pytest.fixture(scope="module")
def reads(spark):
    rows = [(1, STARTS[r], r) for r, n in READS.items() for _ in range(n)]
    return spark.createDataFrame(rows, "sample_id bigint, start int, read string")


def edge_rows(df):
    return {(r["position"], r["src"], r["dst"]): r["weight"] for r in df.collect()}


def test_alignment(spark, reads):
    reference = spark.createDataFrame([(1, "GATTACA")], "sample_id bigint, seq string")
    got = {r["read"]: r for r in align.align(reads, reference).collect()}
    assert {k: r["start"] for k, r in got.items()} == STARTS
    assert all(r["orientation"] == 0 for r in got.values())
    assert {k for k, r in got.items() if r["full"]} == {"GAT", "ATT", "TTA", "TAC", "ACA"}
    assert got["GCT"]["score"] == 6


def test_alignment_leaves_out_what_has_no_place(spark):
    reads = spark.createDataFrame([(1, ""), (1, None), (1, "GATTACAGATTACA")], "sample_id bigint, read string")
    reference = spark.createDataFrame([(1, "GATTACA")], "sample_id bigint, seq string")
    assert align.align(reads, reference).count() == 0


def by_definition(read, base):
    """(score, orientation, start) of the best place."""
    turn = str.maketrans("ACGT", "TGCA")
    ways = [read, read.translate(turn), read[::-1], read.translate(turn)[::-1]]
    score, o, at = max((sum(5 if a == b else -4 for a, b in zip(w, base[i:], strict=False)), -o, i) for o, w in enumerate(ways) for i in range(len(base) - len(read) + 1))
    return score, -o, at


@pytest.mark.parametrize("mismatches", [0, 1, 2, 4])
def test_blocks_change_nothing(spark, mismatches):
    """Also for reads with more mismatches than blocks allow for, for shorter ones, for ties,
    for reads of one to several words, and for other letters."""
    rng = random.Random(mismatches)
    base = "".join(rng.choice("ACGT") for _ in range(150)) + "ACACACACACACACACACAC"
    reads = {"".join(rng.choice("ACGT") for _ in range(rng.randint(1, 9))) for _ in range(40)} | {"ACAC", "GTGTGT", "ACNCA", base, "N", "acgt"}
    for size in (9, 31, 32, 33, 64, 65, 96, 130):
        for wrong in (0, 1, 2, 5):
            at = rng.randrange(len(base) - size)
            read = list(base[at : at + size])
            for k in rng.sample(range(size), wrong):
                read[k] = rng.choice("ACGT")
            read = "".join(read)
            reads.add(rng.choice([read, read[::-1], read.translate(str.maketrans("ACGT", "TGCA"))]))
    table = spark.createDataFrame([(1, r) for r in reads], "sample_id bigint, read string")
    reference = spark.createDataFrame([(1, base)], "sample_id bigint, seq string")
    rows = {r["read"]: tuple(r) for r in align.align(table, reference).collect()}
    assert rows == {r["read"]: tuple(r) for r in align.align_seeded(table, reference, mismatches).select("sample_id", "read", "oriented", "start", "orientation", "score", "full").collect()}
    assert {r: (x[5], x[4], x[3]) for r, x in rows.items()} == {r: by_definition(r, base) for r in reads}


def test_other_letters_in_the_reference(spark):
    reads = spark.createDataFrame([(1, "GATN"), (1, "TTAC")], "sample_id bigint, read string")
    reference = spark.createDataFrame([(1, "GATNTTACA")], "sample_id bigint, seq string")
    assert {r["read"]: (r["start"], r["full"]) for r in align.align(reads, reference).collect()} == {"GATN": (0, True), "TTAC": (4, True)}


def test_reads_are_dealt_to_many_tasks(spark):
    from pyspark.sql import functions as F

    reads = spark.range(400).select(F.lit(1).cast("bigint").alias("sample_id"), F.translate(F.conv("id", 10, 4), "0123", "ACGT").alias("read"))
    reference = spark.createDataFrame([(1, "GATTACACCGTGA")], "sample_id bigint, seq string")
    assert align.align(reads, reference).groupBy(F.spark_partition_id()).count().count() > 1


def test_graph(reads):
    edges, vertices, lengths = graph.edges(reads, 2), graph.vertices(reads, 2), graph.origin_length(reads)
    assert edge_rows(edges) == EDGES
    assert vertices.count() == 10
    assert lengths.first()["origin_length"] == 7
    assert graph.layer_error(edges).first()["error"] == pytest.approx(1.224744871391589)
    shares = edge_rows(graph.normalise(edges))
    assert shares[0, "GC", "CT"] == 0.2 and shares[4, "AC", "CA"] == 0.75 and shares[2, "TT", "TA"] == 1
    cut = graph.cut_tails(vertices, edges, lengths, 2)
    assert edge_rows(cut) == EDGES
    assert graph.count_paths(cut, lengths, 2).first()["paths"] == 4


def test_both_ways_of_cutting_agree(spark):
    rng = random.Random(4)
    rows = []
    for sample in range(6):
        base = "".join(rng.choice("ACGT") for _ in range(14))
        for _ in range(18):
            at = rng.randrange(0, 9)
            read = list(base[at : at + 6])
            if rng.random() < 0.4:
                read[rng.randrange(len(read))] = rng.choice("ACGT")
            rows.append((sample, at, "".join(read)))
    reads = spark.createDataFrame(rows, "sample_id bigint, start int, read string")
    parts = graph.vertices(reads, 3), graph.edges(reads, 3), graph.origin_length(reads)
    one, two = graph.cut_tails(*parts, 3), graph.cut_tails_in_rounds(*parts, 3)
    key = ["sample_id", "position", "src", "dst", "weight"]
    assert sorted(map(tuple, one.select(*key).collect())) == sorted(map(tuple, two.select(*key).collect()))
    # cutting keeps every path and is idempotent
    before, after = (graph.count_paths(e, parts[2], 3).collect() for e in (parts[1], one))
    assert {r[0]: r[1] for r in before if r[1]} == {r[0]: r[1] for r in after if r[1]}


def test_handles_take_few_rounds(spark, monkeypatch):
    """24 edges off a path take five rounds, and a bubble of that length is one handle."""
    rounds = []
    kept = intervals.written
    monkeypatch.setattr(intervals, "written", lambda df, name: rounds.append(name) or kept(df, name))
    path, other = "A" * 30, "A" * 3 + "C" * 21 + "A" * 6
    rows = {(1, at, q[at : at + 2], q[at + 1 : at + 3], 1) for q in (path, other) for at in range(28)}
    edges = spark.createDataFrame(sorted(rows), "sample_id bigint, position int, src string, dst string, weight long")
    paths = spark.createDataFrame([(1, 0, path)], "sample_id bigint, path_id int, seq string")
    for longest, found in ((22, []), (23, [(1, 24)]), (24, [(1, 24)])):
        rounds.clear()
        got = intervals.handles(edges, paths, 2, longest).collect()
        assert [(r["start"], r["stop"]) for r in got] == found and rounds.count("off") <= 5
    assert got[0]["seq"] == other[1:26]


@pytest.mark.parametrize("longest", [3, 5])
def test_handles_against_all_walks(spark, reads, longest):
    """Every stretch of the graph off the path that rejoins it or runs to an end."""
    edges = graph.edges(reads, 2)
    seqs = ["GATTACA", "GCTTATA"]
    paths = spark.createDataFrame([(1, i, q, 0.5) for i, q in enumerate(seqs)], "sample_id bigint, path_id bigint, seq string, weight double")
    got = sorted(map(tuple, intervals.handles(edges, paths, 2, longest).select("path_id", "start", "stop", "seq").collect()))

    walks = [(p, s) for p, s, _ in EDGES] + [(5, "TA"), (5, "CA")]
    all_walks, last = [], 5
    for _ in range(longest):
        walks = [(p, w + d[-1]) for p, w in walks for q, s, d in EDGES if q == p + len(w) - 2 and s == w[-2:]]
        all_walks += walks
    want = set()
    for i, q in enumerate(seqs):
        for p, w in all_walks:
            on = [q[p + j : p + j + 2] == w[j : j + 2] for j in range(len(w) - 1)]
            stop = p + len(w) - 2
            inner = not any(on[1:-1])
            rejoins = on[0] and on[-1] and stop - p > 1
            if inner and (rejoins or on[0] and not on[-1] and stop == last or not on[0] and on[-1] and p == 0):
                want.add((i, p, stop, w))
    assert got == sorted(want)
    assert any(p == 0 and w[:2] != seqs[i][:2] for i, p, _, w in want) or longest < 2
    edges_of_one = graph.normalise(edges).toPandas()
    chain = sampler.Chain(edges_of_one, sampler.Settings(k=2, longest_handle=longest), 0, 1)
    assert got == sorted((i, *h) for i, q in enumerate(seqs) for h in chain.find_handles(q))


def test_path_shares_sum_to_one(reads):
    got = graph.path_shares(graph.edges(reads, 2)).groupBy("position").agg({"count_left": "sum", "count_right": "sum"}).collect()
    assert all(r[1] == pytest.approx(1) and r[2] == pytest.approx(1) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_sampler_keeps_its_books(spark, reads, seed):
    edges = graph.normalise(graph.edges(reads, 2))
    settings = sampler.Settings(k=2, iterations=300, longest_handle=4, seed=seed)
    state = sampler.Chain(edges.toPandas(), settings, 0, 1)
    trace, best, best_logl = state.run()
    assert sum(state.paths.values()) == pytest.approx(1)
    assert trace[-1][4] == pytest.approx(state.log_likelihood(), abs=1e-6)
    assert best_logl == pytest.approx(max(t[4] for t in trace))
    assert sum(best.values()) == pytest.approx(1)
    paths = spark.createDataFrame([(1, i, q, w) for i, (q, w) in enumerate(best.items())], "sample_id bigint, path_id bigint, seq string, weight double")
    recomputed = overlay.log_likelihood(edges, paths, 2, settings.rate).first()["log_likelihood"]
    assert recomputed == pytest.approx(best_logl, abs=1e-6)


@pytest.mark.parametrize(("stop", "least", "most"), [("iter", 30, 30), ("any", 1, 30), ("both", 30, 10**9), ("time", 1, 10**9)])
def test_when_chains_end(spark, reads, stop, least, most):
    edges = graph.normalise(graph.edges(reads, 2)).toPandas()
    for mode in ("tuned", "metropolis"):
        settings = sampler.Settings(k=2, iterations=30, longest_handle=4, seconds=0.05, stop=stop, mode=mode, temperature=2.0)
        trace, _, _ = sampler.Chain(edges, settings, 0, 1).run()
        assert least <= trace[-1][0] <= most


def test_reconstruction_beats_the_reference(spark):
    a = "ACGTTGCAACGGTATCCGATTGACCTAGGA"
    b = a[:9] + "C" + a[10:20] + "G" + a[21:]
    truth = spark.createDataFrame([(1, a, 0.6), (1, b, 0.4)], "sample_id bigint, seq string, weight double")
    rows = [(1, i, s[i : i + 10], n) for s, n in ((a, 6), (b, 4)) for i in range(21)]
    reads = spark.createDataFrame(rows, "sample_id bigint, start int, read string, n bigint")
    reference = truth.where(truth.seq == a).select("sample_id", "seq")
    found = reconstruct.reconstruct(reads, reference, sampler.Settings(k=6, iterations=400, longest_handle=12), 2)
    mine = scoring.earth_movers(truth, found).first()["distance"]
    alone = scoring.earth_movers(truth, spark.createDataFrame([(1, a, 1.0)], "sample_id bigint, seq string, weight double")).first()["distance"]
    assert mine < alone


def test_a_clone_is_spelled_from_its_reads(spark):
    """A single path is what the reads say, not the reference; error tails don't matter."""
    clone, reference = "ACGTACGGTTCAGGCATCCA", "ACGTACGGTACAGGCATCCA"
    rows = [(1, i, clone[i : i + 9], 5) for i in range(12)] + [(1, 4, clone[4:12] + "A", 1)]
    reads = spark.createDataFrame(rows, "sample_id bigint, start int, read string, n bigint")
    given = spark.createDataFrame([(1, reference), (2, reference)], "sample_id bigint, seq string")
    for known in (given, None):
        assert [tuple(r) for r in reconstruct.reconstruct(reads, known, sampler.Settings(k=6)).collect()] == [(1, clone, 1.0)]
    assert reconstruct.reconstruct(reads, given.where("sample_id = 2"), sampler.Settings(k=6)).count() == 0


def test_tails_are_cut_in_logarithmic_rounds(spark, monkeypatch):
    """A tail of 5,000 vertices on either side of a path, in at most 30 rounds."""
    rounds = []
    write = layers.written
    monkeypatch.setattr(layers, "written", lambda df, name: rounds.append(1) or write(df, name))
    size = 6_000
    rows = [(1, p, "p", "p", 3) for p in range(size)] + [(1, p, "p" if p == 500 else "t", "t", 1) for p in range(500, 5_500)] + [(1, p, "u", "p" if p == 5_499 else "u", 1) for p in range(499, 5_500)]
    edges = spark.createDataFrame(rows, "sample_id bigint, position int, src string, dst string, weight bigint")
    vertices = edges.select("sample_id", "position", edges["src"].alias("kmer")).union(edges.selectExpr("sample_id", "position + 1", "dst")).distinct()
    lengths = spark.createDataFrame([(1, size + 2)], "sample_id bigint, origin_length bigint")
    kept = graph.cut_tails(vertices, edges, lengths, 2)
    assert kept.count() == size and kept.where("src <> 'p' or dst <> 'p'").count() == 0
    assert len(rounds) <= 30


def bubbles(number, size):
    """A path of ``size`` layers, of which ``number`` two-way bubbles take two each."""
    out = []
    for p in range(size):
        at = p // 2 < number
        out += [(p, "a", "a")] + ([(p, "a", "b")] if at and p % 2 == 0 else []) + ([(p, "b", "a")] if at and p % 2 else [])
    return out


def test_numbers_of_paths_of_any_size(spark):
    sizes = {1: (150, 300), 2: (3, 40), 3: (1_000, 2_000), 4: (0, 5)}
    rows = [(s, *e, 1) for s, (n, size) in sizes.items() for e in bubbles(n, size)] + [(5, 0, "a", "b", 1), (5, 2, "a", "b", 1)]
    edges = spark.createDataFrame(rows, "sample_id bigint, position int, src string, dst string, weight bigint")
    lengths = spark.createDataFrame([(s, size + 2) for s, (_, size) in sizes.items()] + [(5, 5)], "sample_id bigint, origin_length bigint")
    got = {r["sample_id"]: (r["paths"], r["digits"]) for r in graph.count_paths(edges, lengths, 2).collect()}
    assert {s: d for s, (_, d) in got.items()} == {1: str(2**150), 2: "8", 3: str(2**1000), 4: "1", 5: "0"}
    assert got[1][0] is None and got[2][0] == 8
    assert {r["sample_id"]: r["kind"] for r in graph.path_kinds(edges, lengths, 2).collect()} == {1: "many", 2: "many", 3: "many", 4: "one", 5: "none"}


def test_numbers_longer_than_strings_may_be(spark):
    pairs = [{"prime": p, "r": pow(2, 20_000, p)} for p in sorted(graph._primes(700))]
    import pandas as pd

    digits = graph._rebuild.func(pd.Series([pairs]))[0]
    assert len(digits) == 6_021 and digits.endswith(str(2**20_000 % 10**18))


def shares_by_layer(edges):
    """Layer by layer, as defined."""
    out = {}
    for way, near, far, step in ((0, 1, 2, 1), (1, 2, 1, -1)):
        at, before = {}, {}
        for e in edges:
            p, q = (e[0], e[0] + 1) if step > 0 else (e[0] + 1, e[0])
            at.setdefault(p, set()).add(e[near])
            at.setdefault(q, set()).add(e[far])
            before.setdefault((q, e[far]), []).append((p, e[near]))
        share = {}
        for p in sorted(at, reverse=step < 0):
            sums = {v: sum(share[u] for u in before[p, v]) if (p, v) in before else 1.0 for v in at[p]}
            share |= {(p, v): x / sum(sums.values()) for v, x in sums.items()}
        for v, x in share.items():
            out.setdefault(v, [0.0, 0.0])[way] = x
    return out


def test_shares_are_those_of_layer_after_layer(spark):
    rng = random.Random(9)
    samples = {}
    for s in range(5):
        size = rng.choice([1, 2, 7, 40])
        samples[s] = sorted({(rng.randrange(size), rng.choice("abc"), rng.choice("abc")) for _ in range(4 * size)})
    samples[9] = bubbles(700, 1_500)
    rows = [(s, *e, 1) for s, edges in samples.items() for e in edges]
    edges = spark.createDataFrame(rows, "sample_id bigint, position int, src string, dst string, weight bigint")
    got = {}
    for r in graph.path_shares(edges).collect():
        got.setdefault(r["sample_id"], {})[r["position"], r["kmer"]] = [r["count_left"], r["count_right"]]
    for s, of in samples.items():
        want = shares_by_layer(of)
        assert got[s].keys() == want.keys()
        assert all(got[s][v] == pytest.approx(want[v], abs=1e-9) for v in want)


def test_what_is_left_of_handles_does_not_overlap(reads):
    state = sampler.Chain(graph.normalise(graph.edges(reads, 2)).toPandas(), sampler.Settings(k=2, longest_handle=4), 0, 1)
    handles = [(0, 3, "a"), (2, 5, "b"), (4, 8, "c"), (9, 12, "d"), (12, 14, "e")]
    for _ in range(50):
        left = state.independent(handles, [0, 1, 2, 3, 4])
        assert left and all(a == b or handles[a][1] < handles[b][0] or handles[b][1] < handles[a][0] for a in left for b in left)
    assert state.independent(handles, [0, 3]) == [0, 3]


def test_transport():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random(5)
    assert scoring.transport_cost(x, x, 1.0 - np.eye(5)) == pytest.approx(0)
    assert scoring.transport_cost(np.array([0.4, 0.6]), np.array([0.5, 0.5]), np.array([[0, 3.0], [1, 0]])) == pytest.approx(0.1)
    assert math.isnan(scoring.transport_cost(np.array([1.0]), np.array([0.5]), np.zeros((1, 1))))
    # against all ways to pair equal shares
    from itertools import permutations

    cost = rng.random((5, 5))
    least = min(sum(cost[i, p[i]] for i in range(5)) for p in permutations(range(5))) / 5
    assert scoring.transport_cost(np.full(5, 0.2), np.full(5, 0.2), cost) == pytest.approx(least)


def test_near_pairs_meet_in_blocks(spark):
    """20,000 sequences of one sample: every near pair is found, few others are tried."""
    rng = random.Random(21)
    truth = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(10_000)]
    found, near = [], set()
    for k in range(10_000):
        seq = list(truth[k] if k % 2 else "".join(rng.choice("ACGT") for _ in range(90)))
        for at in rng.sample(range(90), rng.choice([0, 1, 8, 9, 20])):
            seq[at] = "ACGT"["ACGT".index(seq[at]) - 1]
        found.append("".join(seq))
        if k % 2 and sum(a != b for a, b in zip(found[k], truth[k], strict=True)) < 9:
            near.add((truth[k], found[k]))
    t, f = (spark.createDataFrame([(1, x, 1.0) for x in side], "sample_id bigint, seq string, weight double") for side in (truth, found))
    assert {(r["t"], r["f"]) for r in scoring.near_pairs(t, f, 9).collect()} == near
    assert scoring.candidates(t, f, 9).count() < 30_000


@pytest.mark.parametrize("size", [1, 5, 9, 20])
def test_near_pairs_of_short_and_uneven_sequences(spark, size):
    rng = random.Random(size)
    truth = [(s, "".join(rng.choice("AC") for _ in range(rng.randint(1, size)))) for s in (1, 2) for _ in range(12)]
    found = [(s, "".join(rng.choice("AC") for _ in range(size + rng.randint(0, 3)))) for s in (1, 2) for _ in range(12)]
    t, f = (spark.createDataFrame([(s, x, 1.0) for s, x in side], "sample_id bigint, seq string, weight double") for side in (truth, found))
    want = {(s, a, b) for s, a in truth for r, b in found if r == s and sum(x != y for x, y in zip(a, b, strict=False)) < 4}
    assert {tuple(r) for r in scoring.near_pairs(t, f, 4).collect()} == want


def test_independent_handles_are_the_greedy_choice(spark):
    import hashlib

    rng = random.Random(2)
    rows = [(path, k, at, at + rng.randrange(6)) for path in range(6) for k in range(rng.choice([0, 1, 40])) for at in [rng.randrange(60)]]
    want = set()
    for path in range(6):
        taken = []
        order = sorted((hashlib.md5(f"7|{path}|{k}".encode()).hexdigest(), k, a, b) for p, k, a, b in rows if p == path)
        for _, k, a, b in order:
            if all(b < c or d < a for c, d in taken):
                taken.append((a, b))
                want.add((path, k))
    table = spark.createDataFrame(rows, "path_id bigint, handle_id bigint, start bigint, stop bigint")
    got = [tuple(r) for r in intervals.independent(table, seed=7).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert intervals.independent(table.limit(0)).count() == 0


def test_every_step_has_its_likelihood_anew(reads):
    state = sampler.Chain(graph.normalise(graph.edges(reads, 2)).toPandas(), sampler.Settings(k=2, longest_handle=4, iterations=250), 0, 1)
    trace, _, _ = state.run()
    assert trace[-1][5] == state.log_likelihood() and all(t[4] == pytest.approx(t[5], abs=1e-9) for t in trace)
    assert len({t[5] for t in trace}) > 5 and any(t[4] != t[5] for t in trace)


def test_a_chain_spells_out_once_what_the_graph_fixes(reads):
    state = sampler.Chain(graph.normalise(graph.edges(reads, 2)).toPandas(), sampler.Settings(k=2, longest_handle=4, iterations=250), 0, 1)
    spelled, calls = sampler.Chain.steps, []
    state.steps = lambda seq: calls.append(seq) or spelled(state, seq)
    state.run()
    p = next(iter(state.paths))
    for h, (old, new) in zip(state.find_handles(p), state.replacements(p), strict=True):
        q = state.splice(p, h)
        one, other, weight, share = state.apart(p, q)
        at = [(i, p[i : i + 3], q[i : i + 3]) for i in range(len(p) - 2)]
        named = {n: e for e, n in state.number.items()}
        assert [named[e] for e in one] == [(i, a) for i, a, b in at if a != b] and [named[e] for e in other] == [(i, b) for i, a, b in at if a != b]
        assert weight == pytest.approx(sum(state.weight[e] for e in one + other))
        assert share == any(a == b and state.weight[state.number[i, a]] > 0 for i, a, b in at)
        assert [named[e] for e in old] == [(i, p[i : i + 3]) for i in range(h[0], h[1])] and [named[e] for e in new] == [(i, q[i : i + 3]) for i in range(h[0], h[1])]
    calls.clear()
    for q in state.paths:
        state.difference(p, q), state.apart(p, q)
    again = len(calls)
    for q in state.paths:
        assert state.difference(p, q) == state.apart(p, q)[2]
    assert len(calls) == again


def test_runs_over_blocks(spark):
    """Runs that end, begin or go on at multiples of 64, below zero and of nulls, against
    sets; and values meet in blocks before they are shuffled."""
    rng = random.Random(1)
    at = {k: {rng.randint(-300, 300) for _ in range(rng.choice((1, 5, 200, 900)))} for k in range(20)}
    at[99] = {*range(-200, 500), 502, *range(576, 704)}
    at[None], at[-1] = {3, 4, 6}, {None}
    rows = [(k, v) for k, vs in at.items() for v in vs] * 2
    found = intervals.runs(spark.createDataFrame(rows, "k bigint, at int"), ["k"], "at")
    want = [(-1, None, None, 1)]
    for k, vs in at.items():
        vs = vs - {None}
        for a in (v for v in vs if v - 1 not in vs):
            b = next(b for b in range(a, 1000) if b + 1 not in vs)
            want.append((k, a, b, b - a + 1))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "partial_bit_or" in found._jdf.queryExecution().executedPlan().toString()


def test_dead_ends_cost_no_primes(spark, monkeypatch):
    """Paths past many dead ends are counted without a cut, modulo as few primes as they need."""
    kept, needed = graph.written, []

    def seen(df, name):
        out = kept(df, name)
        if name == "needed":
            needed.extend(r["number"] for r in out.collect())
        return out

    monkeypatch.setattr(graph, "written", seen)
    line = [(1, p, f"a{p}", f"a{p + 1}") for p in range(20)]
    tails = [(1, p, f"a{p}", f"t{p}-{i}") for p in range(19) for i in range(15)]
    edges = spark.createDataFrame(line + tails + [(1, 5, "a5", "b"), (1, 6, "b", "a7"), (2, 0, "x", "y")], "sample_id bigint, position int, src string, dst string")
    lengths = spark.createDataFrame([(1, 22), (2, 22)], "sample_id bigint, origin_length int")
    got = {r["sample_id"]: r["digits"] for r in graph.count_paths(edges, lengths, 2).collect()}
    assert got == {1: "2", 2: "0"} and needed and set(needed) == {1}


def layered(rng: random.Random, length: int, paths: int) -> pd.DataFrame:
    """Normalised edges of the 3-mers of ``paths`` sequences that differ here and there."""
    first = [rng.choice("ACGT") for _ in range(length)]
    seqs = ["".join(rng.choice("ACGT") if i and rng.random() < 0.2 else c for c in first) for i in range(paths)]
    found = Counter((p, q[p : p + 3], q[p + 1 : p + 4]) for q in seqs for p in range(length - 3))
    rows = [(p, s, d, n / paths) for (p, s, d), n in sorted(found.items())]
    return pd.DataFrame(rows, columns=["position", "src", "dst", "weight"])


@pytest.mark.parametrize("changes", [{}, {"mode": "metropolis", "temperature": 3.0}, {"longest_handle": 3, "retries": 2}, {"least": 0.2, "rate": 6.0}])
def test_chains_in_step_are_chains_alone(changes):
    rng = random.Random(len(changes))
    settings = sampler.Settings(**{"k": 3, "iterations": 150, "longest_handle": 8, **changes})
    graphs = [layered(rng, length, paths) for length, paths in ((30, 5), (12, 2), (20, 1), (41, 6), (8, 4))]
    members = [(g, 10 + g, c) for g in range(len(graphs)) for c in range(3)]
    state = chains.Chains([chains.Graph(*(x[c].tolist() for c in x.columns), 3, settings.longest_handle) for x in graphs], members, settings)
    state.TRACE, state.MOST = 50, 20  # traces in parts, and handles forgotten on the way
    rows = sorted((*map(int, r[:2]), chains.MOVES[r[2]], bool(r[3]), *r[4:]) for part in state.run() for r in zip(*part, strict=True))
    mixtures = list(state.mixtures())
    moves = set()
    for b, (g, sample, c) in enumerate(members):
        alone = sampler.Chain(graphs[g], settings, c, sample)
        trace, best, logl = alone.run()
        mine = [r[1:] for r in rows if r[0] == b]
        assert [r[:3] for r in mine] == [t[:3] for t in trace]
        assert all(r[3:] == pytest.approx(t[3:], abs=1e-9) for r, t in zip(mine, trace))
        for kind, paths, end in (("last", alone.paths, trace[-1][4]), ("best", best, logl)):
            found = [r[2:] for r in mixtures if r[:2] == (b, kind)]
            assert [(q, w) for q, w, _ in found] == sorted(paths.items()) and all(x == pytest.approx(end) for _, _, x in found)
        moves |= {(t[1], t[2]) for t in trace}
    assert {m for m, _ in moves} >= {"Start", "Fail", "New", "Move", "Delete", "Transfer"} and len(moves) > 8


def test_tasks_take_samples_chains_in_step(spark):
    rng = random.Random(4)
    graphs = {s: layered(rng, 10 + s, 1 + s % 4) for s in range(9)}
    edges = spark.createDataFrame(pd.concat([x.assign(sample_id=s) for s, x in graphs.items()])[["sample_id", "position", "src", "dst", "weight"]])
    settings = sampler.Settings(k=3, iterations=20, longest_handle=6)
    plan = sampler.mixtures(edges, 3, settings)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    for many in (1, 12):  # one by one in a task, and together
        found = sampler.mixtures(edges, many, settings).collect()
        want = []
        for s, x in graphs.items():
            for c in range(many):
                alone = sampler.Chain(x, settings, c, s)
                trace, best, logl = alone.run()
                want += [(s, c, "last", q, w, trace[-1][4]) for q, w in alone.paths.items()] + [(s, c, "best", q, w, logl) for q, w in best.items()]
        assert [r[:5] for r in sorted(map(tuple, found))] == [r[:5] for r in sorted(want)]
        assert [r[5] for r in sorted(map(tuple, found))] == pytest.approx([r[5] for r in sorted(want)])
    assert sampler.mixtures(edges, 0, settings).count() == 0 and sampler.mixtures(edges.limit(0), 3, settings).count() == 0


def test_the_best_of_chains_is_found_in_one_run(spark):
    rng = random.Random(8)
    edges = spark.createDataFrame(pd.concat([layered(rng, 20, 4).assign(sample_id=s) for s in range(3)])[["sample_id", "position", "src", "dst", "weight"]])
    best = sampler.best_of_chains(sampler.mixtures(edges, 4, sampler.Settings(k=3, iterations=40, longest_handle=6)))
    assert best._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = [(1, c, kind, q, w, logl) for c, logl, q, w in ((0, -3.0, "A", 1.0), (1, -2.0, "C", 0.5), (1, -2.0, "G", 0.5), (2, -2.0, "T", 1.0)) for kind in ("last", "best")]
    found = spark.createDataFrame([*rows, (1, 3, "last", "AA", 1.0, 9.0), (2, 5, "best", "CC", 1.0, -7.0)], "sample_id bigint, chain_id bigint, kind string, seq string, weight double, logl double")
    assert sorted(map(tuple, sampler.best_of_chains(found).collect())) == [(1, "C", 0.5), (1, "G", 0.5), (2, "CC", 1.0)]


def test_traces_of_many_chains(spark):
    """Chains of one sample in two blocks, and by the clock each alone, are those of ``Chain``."""
    graph_of_one = layered(random.Random(3), 24, 4)
    edges = spark.createDataFrame(graph_of_one.assign(sample_id=5)[["sample_id", "position", "src", "dst", "weight"]])
    settings = sampler.Settings(k=3, iterations=25, longest_handle=6)
    plan = sampler.traces(edges, 70, settings)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    for many, stop in ((70, "iter"), (3, "any")):
        timed = sampler.Settings(k=3, iterations=25, longest_handle=6, stop=stop, seconds=600.0)
        found = sorted(map(tuple, sampler.traces(edges, many, timed).collect()))
        want = sorted((5, c, *t) for c in range(many) for t in sampler.Chain(graph_of_one, settings, c, 5).run()[0])
        assert [r[:5] for r in found] == [r[:5] for r in want]
        assert all(r[5:] == pytest.approx(w[5:], abs=1e-9) for r, w in zip(found, want))
    assert sampler.traces(edges, 0, settings).count() == 0
