"""Metropolis-Hastings over mixtures of paths, chains of (sample, chain).

A chain is sequential and its state is small (the sample's graph and a few paths), so chains run
side by side: Spark deals samples to tasks, and a task takes its chains through their steps together
(``chains.Chains``). ``Chain`` is one chain alone, which takes the same steps.
"""

from __future__ import annotations

import itertools
import math
import time
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import MOVES, Chains, Graph
from .lineage import spread


@dataclass(frozen=True)
class Settings:
    k: int = 7
    rate: float = 3.0
    least: float = 0.001
    longest_handle: int = 24
    iterations: int = 1000
    #: Time limit, and what ends a chain: "iter", "time", "both" (the later) or "any".
    seconds: float = 0.0
    stop: str = "iter"
    seed: int = 42
    #: Divides the jump density; 1 leaves it as it is.
    temperature: float = 1.0
    #: "tuned" subtracts the shifted, scaled jump density; "metropolis" adds it unscaled.
    mode: str = "tuned"
    #: Shifts and scales of the jump densities of New and Delete.
    shift_new: float = -25.95
    scale_new: float = 30.0
    shift_delete: float = 87.64
    scale_delete: float = 80.0
    retries: int = 50


def _soft(x: float) -> float:
    return 1 + math.sqrt(x) if x >= 0 else max(1 - math.sqrt(-x), 1e-9)


class Chain:
    """A mixture of source-to-sink paths and the coverage that its weights give edges.

    Edges are numbered, those of the graph first, so that sums over a path run over numbers. What
    depends on the graph alone (a path's edges, its handles, where two paths differ) is
    remembered, each kind up to MOST entries; what depends on the state, until it changes.
    """

    MOST = 1000

    def __init__(self, edges: pd.DataFrame, settings: Settings, chain: int, sample: int):
        self.s, self.k = settings, settings.k
        self.rng = np.random.Generator(np.random.PCG64([settings.seed, sample, chain]))
        self.number: dict[tuple[int, str], int] = {}
        weight = {(p, s + d[-1]): w for p, s, d, w in edges[["position", "src", "dst", "weight"]].itertuples(index=False)}
        for e in weight:
            self.number[e] = len(self.number)
        self.weight = list(weight.values())  # an edge that the graph lacks weighs nothing
        self.known = len(self.weight)
        self.out: dict[tuple[int, str], list[str]] = {}
        self.into: dict[tuple[int, str], list[str]] = {}
        for p, s, d in sorted(edges[["position", "src", "dst"]].itertuples(index=False)):
            self.out.setdefault((p, s), []).append(d)
            self.into.setdefault((p + 1, d), []).append(s)
        self.last = int(edges["position"].max()) + 1
        self.error = [-w for w in self.weight]  # coverage - weight
        self.paths: dict[str, float] = {}
        self.handles: dict[str, list[tuple[int, int, str]]] = {}
        self.replaced: dict[str, list[tuple[list[int], list[int]]]] = {}
        self.spelled: dict[str, list[int]] = {}
        self.parts: dict[tuple[str, str], tuple[list[int], list[int], float, bool]] = {}
        self.odds: dict[int, tuple[list[str], list[float], dict[str, float]]] = {}
        self.totals: dict[str, float] = {}
        self.commit({self.first_path(): 1.0})
        self.logl = self.log_likelihood()

    def first_path(self) -> str:
        """A walk from the least source, each step by the edges' weights."""
        seq = min(v for p, v in self.out if p == 0)
        for p in range(self.last):
            nxt = self.out[p, seq[p : p + self.k]]
            w = np.array([self.weight[self.number[p, seq[p:] + d[-1]]] for d in nxt])
            seq += nxt[self.rng.choice(len(nxt), p=w / w.sum())][-1]
        return seq

    def edge(self, position: int, kmers: str) -> int:
        """The number of an edge, spelled as its two k-mers together."""
        found = self.number.get((position, kmers))
        if found is None:
            found = self.number[position, kmers] = len(self.number)
            self.weight.append(0.0)
            self.error.append(0.0)
        return found

    def steps(self, seq: str) -> list[int]:
        found = self.spelled.get(seq)
        if found is None:
            if len(self.spelled) > self.MOST:
                self.spelled.clear()
            found = self.spelled[seq] = [self.edge(i, seq[i : i + self.k + 1]) for i in range(len(seq) - self.k)]
        return found

    def apart(self, p: str, q: str) -> tuple[list[int], list[int], float, bool]:
        """Where two paths differ: the edges of either, their weights' sum, and whether the
        paths share an edge that weighs something."""
        found = self.parts.get((p, q))
        if found is None:
            if len(self.parts) > self.MOST:
                self.parts.clear()
            both, w = list(zip(self.steps(p), self.steps(q), strict=True)), self.weight
            one, other = [a for a, b in both if a != b], [b for a, b in both if a != b]
            found = self.parts[p, q] = one, other, sum([w[a] + w[b] for a, b in zip(one, other)]), any(a == b and w[a] > 0 for a, b in both)
        return found

    def commit(self, changes: dict[str, float]) -> None:
        self.totals.clear()
        error = self.error
        for seq, change in changes.items():
            for e in self.steps(seq):
                error[e] += change
            left = self.paths.get(seq, 0.0) + change
            if left <= 1e-12:
                self.paths.pop(seq, None)
            else:
                self.paths[seq] = left

    def log_poisson(self, n: int) -> float:
        return n * math.log(self.s.rate) - self.s.rate - math.lgamma(n + 1)

    def log_likelihood(self) -> float:
        error = self.error[: self.known]
        return -math.sumprod(error, error) + self.log_poisson(len(self.paths))

    def delta(self, source: str, target: str, amount: float) -> float:
        total, error = 0.0, self.error
        one, other, _, _ = self.apart(source, target)
        for a, b in zip(one, other):
            total += amount * (2 * error[a] - amount) - amount * (2 * error[b] + amount)
        return total

    def excess(self, seq: str) -> float:
        if seq not in self.totals:  # until the next change
            self.totals[seq] = sum(map(self.error.__getitem__, self.steps(seq)))
        return min(self.paths[seq], self.totals[seq] / self.last)

    def find_handles(self, seq: str) -> list[tuple[int, int, str]]:
        """(start, stop, piece) of sub-walks off the path that come back, or run to an end."""
        if seq in self.handles:
            return self.handles[seq]
        k, most, found = self.k, self.s.longest_handle, []
        on = lambda p, v: seq[p : p + k] == v
        for i in range(self.last + 1):
            here, nxt = seq[i : i + k], self.out.get((i, seq[i : i + k]), ())
            # where the path is all there is, no walk leaves it
            todo = [(i, here)] if len(nxt) != 1 or not on(i + 1, nxt[0]) else []
            while todo:
                p, piece = todo.pop()
                v = piece[-k:]
                if p > i and (on(p, v) or p == self.last):
                    if p - i > 1 or not on(p, v):
                        found.append((i, p, piece))
                elif p - i < most:
                    todo += [(p + 1, piece + d[-1]) for d in self.out.get((p, v), ())]
            if 0 < i <= most:
                back = [(i, here)]
                while back:
                    p, piece = back.pop()
                    if p == 0:
                        found.append((0, i, piece))
                        continue
                    back += [(p - 1, s[0] + piece) for s in self.into.get((p, piece[:k]), ()) if not on(p - 1, s)]
        found = sorted({h for h in found if seq[h[0] : h[1] + k] != h[2]})
        if len(self.handles) > self.MOST:
            self.handles.clear()
        self.handles[seq] = found
        return found

    def replacements(self, seq: str) -> list[tuple[list[int], list[int]]]:
        """Of each handle of a path the edges that it would replace, and its own."""
        found = self.replaced.get(seq)
        if found is None:
            if len(self.replaced) > self.MOST:
                self.replaced.clear()
            on, k = self.steps(seq), self.k
            found = self.replaced[seq] = [(on[a:b], [self.edge(i, piece[i - a : i - a + k + 1]) for i in range(a, b)]) for a, b, piece in self.find_handles(seq)]
        return found

    def splice(self, seq: str, handle: tuple[int, int, str]) -> str:
        return seq[: handle[0]] + handle[2] + seq[handle[1] + self.k :]

    def pick(self, options: list, scores: list[float]) -> tuple[int, float]:
        total = sum(scores)
        p = [x / total for x in scores]
        return (at := self.at(p)), math.log(p[at])

    def at(self, p: list[float]) -> int:
        """A place drawn by probabilities."""
        upto = list(accumulate(p))
        return bisect_right([x / upto[-1] for x in upto], self.rng.random())

    def source(self, options: list[str]) -> tuple[str, float]:
        at, logp = self.pick(options, [_soft(self.excess(q)) for q in options])
        return options[at], logp

    def log_source(self, seq: str) -> float:
        return math.log(_soft(self.excess(seq)) / sum(_soft(self.excess(q)) for q in self.paths))

    def difference(self, p: str, q: str) -> float:
        return self.apart(p, q)[2]

    def draw(self, source: str, target: str, floor: bool) -> tuple[float, float]:
        """An amount around the shift that would even out errors; log density over its peak."""
        w, least = self.paths[source], self.s.least
        error = self.error
        one, other, _, _ = self.apart(source, target)
        gap = [(min(w, error[a]) - error[b]) / 2 for a, b in zip(one, other)]
        mean = (w + 3 * sum(gap) / self.last) / 5
        mean = least if mean < 0 else mean
        std = max(mean - least, w - mean - least, least) if floor else max(mean, w - mean - least, least)
        value = self.rng.normal(mean, std)
        low = least if floor else 0.0
        return max(low, min(value, w - least)), -0.5 * ((value - mean) / std) ** 2

    def mix(self, n: int) -> dict[str, float]:
        r = self.s.rate
        if n <= 1:
            return {"New": 0.5, "Move": 0.5}
        new, move, delete = 1 / max(6.0, r + n), 1 / max(6.0, r + r / n), n / r / (r + n)
        return {"New": new, "Move": move, "Delete": delete, "Transfer": max(1 - new - move - delete, 0.0)}

    def propose(self) -> tuple[str, dict[str, float], float, float] | None:
        """(move, changes, likelihood delta, log jump density), or None where it fails."""
        n = len(self.paths)
        if n not in self.odds:
            mix = self.mix(n)
            self.odds[n] = [m.lower() for m in mix], [x / sum(mix.values()) for x in mix.values()], mix
        names, p, mix = self.odds[n]
        return getattr(self, f"propose_{names[self.at(p)]}")(n, mix)

    def propose_new(self, n: int, mix: dict[str, float]):
        able = [q for q, w in self.paths.items() if w >= 2 * self.s.least]
        if not able:
            return None
        src, logp = self.source(able)
        handles = self.find_handles(src)
        if not handles:
            return None
        size = [h[1] - h[0] + 1 for h in handles]
        many = sum(any(a != b and a[0] <= b[1] and b[0] <= a[1] for b in handles) for a in handles)
        xi = max((len(handles) - many // 2) / 2 * len(handles) / sum(x - 1 for x in size), 1 / max(min(size) - 2, 1))
        odds = [min(1 / xi / (x - 1), 1 - 1e-9) for x in size]
        taken = [j for j, o in enumerate(odds) if self.rng.random() < o]
        chosen = self.independent(handles, taken)
        target = src
        for j in chosen:
            target = self.splice(target, handles[j])
        if target == src or target in self.paths:
            return None
        amount, peak = self.draw(src, target, True)
        forward = math.log(mix["New"]) + logp + peak
        for j, o in enumerate(odds):
            near = any(c != j and handles[j][0] <= handles[c][1] and handles[c][0] <= handles[j][1] for c in chosen)
            forward += math.log(o) if j in chosen else math.log(1 - o * (0.5 if near else 1))
        pd_ = max(self.difference(src, target), 1e-9)
        others = sum(max(self.difference(q, src), 1e-9) ** -0.5 for q in self.paths if q != src)
        mean_error = sum(map(self.error.__getitem__, self.steps(target))) / self.last
        backward = math.log(self.mix(n + 1).get("Delete", 1e-9)) + math.log(_soft(min(amount, mean_error))) - math.log(sum(_soft(self.excess(q)) for q in self.paths)) - 0.5 * math.log(pd_) - math.log(others + pd_**-0.5)
        jump = self.scaled(backward - forward, self.s.shift_new, self.s.scale_new)
        return "New", {src: -amount, target: amount}, self.delta(src, target, amount) + self.log_poisson(n + 1) - self.log_poisson(n), jump

    def independent(self, handles: list[tuple[int, int, str]], taken: list[int]) -> list[int]:
        """Of the handles ``taken`` those left when random ones are deleted, overlapping or
        not, until no two that are left overlap."""
        overlap = {j: {c for c in taken if c != j and handles[c][0] <= handles[j][1] and handles[j][0] <= handles[c][1]} for j in taken}
        left, conflicts = list(taken), sum(map(len, overlap.values()))
        while conflicts:
            j = left.pop(int(self.rng.integers(len(left))))
            for c in overlap[j]:
                overlap[c].discard(j)
            conflicts -= 2 * len(overlap.pop(j))
        return left

    def propose_move(self, n: int, mix: dict[str, float]):
        src, _ = self.source(list(self.paths))
        handles = self.find_handles(src)
        if not handles:
            return None
        w, error, sides = self.paths[src], self.error, self.replacements(src)

        def score(old: list[int], new: list[int]) -> float:
            m = sum([min(w, error[a]) - error[b] for a, b in zip(old, new)])
            return _soft(m / len(old) / 2) / len(old)

        scores = [score(old, new) for old, new in sides]
        at, _ = self.pick(handles, scores)
        h = handles[at]
        target = self.splice(src, h)
        if target in self.paths:
            return None
        edges = h[1] - h[0]
        b = sum([min(w, error[new]) / edges - error[old] for old, new in zip(*sides[at])]) / (2 * (edges + 1))
        return "Move", {src: -w, target: w}, self.delta(src, target, w), math.log(_soft(b) / 2 / edges) - math.log(scores[at])

    def targets(self, src: str, share: bool) -> tuple[list[str], list[float]]:
        found = [(q, _soft(-self.excess(q)) / max(self.difference(src, q), 1e-9)) for q in self.paths if q != src]
        if share:
            found = [(q, x) for q, x in found if self.apart(src, q)[3]]
        return [q for q, _ in found], [x for _, x in found]

    def propose_delete(self, n: int, mix: dict[str, float]):
        src, logp = self.source(list(self.paths))
        names, scores = self.targets(src, True)
        if not names:
            return None
        at, logt = self.pick(names, scores)
        target, w = names[at], self.paths[src]
        handles = self.find_handles(target)
        size = [h[1] - h[0] + 1 for h in handles]
        backward = math.log(self.mix(n - 1)["New"]) + self.log_source(target)
        if handles:
            xi = max(len(handles) / 2 * len(handles) / sum(x - 1 for x in size), 1 / max(min(size) - 2, 1))
            for h, x in zip(handles, size, strict=True):
                o = min(1 / xi / (x - 1), 1 - 1e-9)
                backward += math.log(o) if src[h[0] : h[1] + self.k] == h[2] else math.log(1 - o)
        jump = self.scaled(backward - math.log(mix["Delete"]) - logp - logt, self.s.shift_delete, self.s.scale_delete)
        return "Delete", {src: -w, target: w}, self.delta(src, target, w) + self.log_poisson(n - 1) - self.log_poisson(n), jump

    def propose_transfer(self, n: int, mix: dict[str, float]):
        src, logp = self.source(list(self.paths))
        names, scores = self.targets(src, False)
        if not names or self.paths[src] <= self.s.least:
            return None
        at, logt = self.pick(names, scores)
        target = names[at]
        amount, peak = self.draw(src, target, False)
        back, others = self.targets(target, False)
        logb = math.log(others[back.index(src)] / sum(others))
        jump = self.log_source(target) + logb - logp - logt - peak
        return "Transfer", {src: -amount, target: amount}, self.delta(src, target, amount), jump

    def scaled(self, jump: float, shift: float, scale: float) -> float:
        return jump if self.s.mode == "metropolis" else (jump + shift) / scale

    def ended(self, done: int, began: float) -> bool:
        enough, late = done >= self.s.iterations, time.monotonic() - began >= self.s.seconds
        return {"iter": enough, "time": late, "both": enough and late, "any": enough or late}[self.s.stop]

    def run(self) -> tuple[list[tuple], dict[str, float], float]:
        """The trace (iter, move, accept, delta, running and recomputed logl, jump density), and
        the best state."""
        trace = [(0, "Start", True, 0.0, self.logl, self.logl, 0.0)]
        best, best_logl, running, anew = dict(self.paths), self.logl, self.logl, self.logl
        sign = 1.0 if self.s.mode == "metropolis" else -1.0
        i, began = 0, time.monotonic()
        while not self.ended(i, began):
            i += 1
            found = next((p for p in (self.propose() for _ in range(self.s.retries)) if p), None)
            if not found:
                trace.append((i, "Fail", False, 0.0, running, anew, 0.0))
                continue
            move, changes, delta, jump = found
            accept = math.log(max(self.rng.random(), 1e-300)) < delta + sign * jump / self.s.temperature
            if accept:
                self.commit(changes)
                running += delta
                anew = self.log_likelihood()  # changes with the state alone
                if running > best_logl:
                    best, best_logl = dict(self.paths), running
            trace.append((i, move, bool(accept), delta, running, anew, float(jump)))
        return trace, best, best_logl


#: Chains in step in a task, at most: so many, and so many edges of paths in all.
TOGETHER, EDGES_TOGETHER = 1024, 1 << 17
#: Fewer chains than these are quicker one by one.
FEW = 14
#: Chains of a sample that stay together; further ones may run in other tasks.
BLOCK = 64


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows of one sample and block after another, from batches sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        keys = rows[["sample_id", "block"]].to_numpy()
        if held and (held[-1][["sample_id", "block"]].to_numpy()[-1] != keys[0]).any():
            yield pd.concat(held)
            held = []
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(rows)]
        for start, stop in itertools.pairwise(cuts):
            held.append(rows.iloc[start:stop])
            if stop < len(rows):
                yield pd.concat(held)
                held = []
    if held:
        yield pd.concat(held)


def _together(batches: Iterator[pa.RecordBatch], chains: int, settings: Settings) -> Iterator[list[tuple[pd.DataFrame, int, range]]]:
    """Samples (edges, sample_id, numbers of chains) that run in step."""
    held, many, longest = [], 0, 0
    for rows in _samples(batches):
        first = int(rows["block"].iloc[0]) * BLOCK
        numbers = range(first, min(first + BLOCK, chains))
        length = int(rows["position"].max()) + 1
        if held and (many + len(numbers) > TOGETHER or (many + len(numbers)) * max(longest, length) > EDGES_TOGETHER):
            yield held
            held, many, longest = [], 0, 0
        held.append((rows, int(rows["sample_id"].iloc[0]), numbers))
        many, longest = many + len(numbers), max(longest, length)
    if many:
        yield held


def _run(edges: DataFrame, chains: int, settings: Settings, schema: str, of_chain, of_chains) -> DataFrame:
    """Rows (sample_id, chain_id, ..) of all chains: ``of_chain`` gives those of a ``Chain``, and
    ``of_chains`` those of many in step. A chain that ends by the clock has it to itself."""
    by_clock = settings.stop != "iter"
    together = 1 if by_clock else BLOCK
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(chains - 1, 0) // together)))
    dealt = spread(edges.select("sample_id", "position", "src", "dst", "weight", blocks.alias("block")), "sample_id", "block")

    def rows(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) if not isinstance(x, pa.Array) else x for x in columns], names=names)

    def alone(found: pd.DataFrame, sample: int, numbers: Iterable[int]) -> Iterator[pa.RecordBatch]:
        for chain in numbers:
            columns = list(zip(*of_chain(state := Chain(found, settings, chain, sample), *state.run()), strict=True))
            yield rows([[sample] * len(columns[0]), [chain] * len(columns[0]), *map(list, columns)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if by_clock:
            for found in _samples(batches):
                yield from alone(found, int(found["sample_id"].iloc[0]), [int(found["block"].iloc[0])] if chains > 0 else [])
            return
        for held in _together(batches, chains, settings):
            if sum(len(numbers) for _, _, numbers in held) < FEW:
                for found, sample, numbers in held:
                    yield from alone(found, sample, numbers)
                continue
            graphs = [Graph(*(found[c].tolist() for c in ("position", "src", "dst", "weight")), settings.k, settings.longest_handle) for found, _, _ in held]
            state = Chains(graphs, [(g, sample, chain) for g, (_, sample, numbers) in enumerate(held) for chain in numbers], settings)
            for chain, *columns in of_chains(state):
                yield rows([state.sample[chain], state.chain[chain], *columns])

    names = [f.split()[0] for f in schema.split(", ")]
    return dealt.sortWithinPartitions("sample_id", "block").mapInArrow(work, schema)


def mixtures(edges: DataFrame, chains: int = 4, settings: Settings = Settings()) -> DataFrame:
    """(sample_id, chain_id, kind, seq, weight, logl): each chain's last and best mixture.

    ``edges``: normalised edges of graphs without dead ends.
    """

    def of_chain(state: Chain, trace, best, best_logl) -> list[tuple]:
        return [("last", q, w, trace[-1][4]) for q, w in sorted(state.paths.items())] + [("best", q, w, best_logl) for q, w in sorted(best.items())]

    def of_chains(state: Chains) -> Iterator[tuple]:
        for _ in state.run():
            pass
        chain, *columns = zip(*state.mixtures())
        yield np.array(chain), *map(list, columns)

    return _run(edges, chains, settings, "sample_id bigint, chain_id bigint, kind string, seq string, weight double, logl double", of_chain, of_chains)


def traces(edges: DataFrame, chains: int = 4, settings: Settings = Settings()) -> DataFrame:
    """(sample_id, chain_id, iter, move, accept, delta, logl_acc, logl, jump): each chain's steps."""

    def of_chain(state: Chain, trace, best, best_logl) -> list[tuple]:
        return trace

    def of_chains(state: Chains) -> Iterator[tuple]:
        for chain, step, move, *columns in state.run():
            yield chain, step, pa.array(MOVES).take(pa.array(move)), *columns

    return _run(edges, chains, settings, "sample_id bigint, chain_id bigint, iter bigint, move string, accept boolean, delta double, logl_acc double, logl double, jump double", of_chain, of_chains)


def best_of_chains(found: DataFrame) -> DataFrame:
    """(sample_id, seq, weight): of each sample the best mixture over all chains."""
    # one pass: a join of the best with themselves would run the chains twice
    rank = F.struct("logl", (-F.col("chain_id")).alias("c"))
    best = found.where("kind = 'best'").withColumn("top", F.max(rank).over(Window.partitionBy("sample_id")))
    return best.where(F.col("top.c") == -F.col("chain_id")).select("sample_id", "seq", "weight")
