"""Many chains of the sampler in step: each round, every chain makes one proposal.

What a round does to all chains is array work over them together, so a step costs a chain a
share of some hundred array operations instead of as many operations of its own. Each chain
draws from its own generator in the order of ``sampler.Chain``, and amounts are summed as exactly as
there, so a chain takes the same steps alone, as a ``Chain``, and beside any others. Other sums may
differ in their last bit, which matters only to a draw that falls within it.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

NEW, MOVE, DELETE, TRANSFER, FAIL, START = range(6)
MOVES = ["New", "Move", "Delete", "Transfer", "Fail", "Start"]


def total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, with the rounding of every addition added back at the end, as ``sum`` does:
    pairs are added in a tree."""
    x, lost = np.ascontiguousarray(x.T), 0.0
    while (m := len(x)) > 1:
        half = m // 2
        a, b = x[:half], x[half : 2 * half]
        s = a + b
        t = s - a
        lost = lost + ((a - (s - t)) + (b - t)).sum(0)
        x = np.concatenate((s, x[2 * half :])) if m % 2 else s
    return x[0] + lost


def soft(x: np.ndarray) -> np.ndarray:
    r = np.sqrt(np.abs(x))
    return np.where(x >= 0, 1 + r, np.maximum(1 - r, 1e-9))


def drawn(scores: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row a place drawn by its scores, and the logarithm of its share."""
    p = scores / scores.sum(1)[:, None]
    upto = np.cumsum(p, 1)
    at = (upto / upto[:, -1:] <= u[:, None]).sum(1)
    return at, np.log(p[np.arange(len(at)), at])


class Graph:
    """A sample's edges by number, and the ways off its paths. Paths are rows of edges."""

    def __init__(self, position, src, dst, weight, k: int, longest: int):
        self.k, self.longest = k, longest
        self.weight = list(map(float, weight))
        self.ends = list(zip(src, dst, strict=True))
        self.out: dict[tuple[int, str], list[tuple[str, int]]] = {}
        self.into: dict[tuple[int, str], list[tuple[str, int]]] = {}
        for p, s, d, e in sorted(zip(map(int, position), src, dst, range(len(self.ends)), strict=True)):
            self.out.setdefault((p, s), []).append((d, e))
            self.into.setdefault((p + 1, d), []).append((s, e))
        self.last = int(max(position)) + 1
        self.forks = [len(self.out[p, s]) > 1 for p, s in zip(map(int, position), src)]
        self.joins = [len(self.into[p + 1, d]) > 1 for p, d in zip(map(int, position), dst)]
        self.shares: dict[tuple[int, str], list[float]] = {}
        self.forget()

    def forget(self) -> None:
        self.parts: dict[tuple[int, bytes], list[tuple[int, int, str, int]]] = {}
        self.paths: dict[bytes, int] = {}

    def first_path(self, rng: np.random.Generator) -> list[int]:
        """A walk from the least source, each step by the edges' weights."""
        at, row = min(v for p, v in self.out if p == 0), []
        for p, u in enumerate(rng.random(self.last).tolist()):
            nxt = self.out[p, at]
            upto = self.shares.get((p, at))
            if upto is None:
                w = np.array([self.weight[e] for _, e in nxt])
                sums = (w / w.sum()).cumsum()
                upto = self.shares[p, at] = (sums / sums[-1]).tolist()
            at, e = nxt[bisect_right(upto, u)]
            row.append(e)
        return row

    def spell(self, row) -> str:
        return self.ends[row[0]][0] + "".join([self.ends[e][1][-1] for e in row])

    def handles(self, row: list[int], data: bytes, number) -> list[int]:
        """The handles of a path, by start, stop and piece, each named by ``number(start, stop,
        edges)``. Those that leave a vertex follow from the path's edges near it, which are
        found in ``data``, the path as bytes."""
        found, on, wide = [], None, len(data) // len(row)
        for i in [i for i, e in enumerate(row) if self.forks[e]]:
            key = i, data[i * wide : (i + self.longest) * wide]
            if (part := self.parts.get(key)) is None:
                on = on or [self.ends[e][0] for e in row] + [self.ends[row[-1]][1]]
                part = self.parts[key] = [(i, p, piece, number(i, p, way)) for p, piece, way in self.leaving(i, on)]
            found += part
        for i in [i for i, e in enumerate(row[: self.longest], 1) if self.joins[e]]:
            key = -i, data[: i * wide]
            if (part := self.parts.get(key)) is None:
                on = on or [self.ends[e][0] for e in row] + [self.ends[row[-1]][1]]
                part = self.parts[key] = [(0, i, piece, number(0, i, way)) for piece, way in self.coming(i, on)]
            found += part
        found.sort()
        return [h[3] for h in found]

    def leaving(self, i: int, on: list[str]) -> Iterator[tuple[int, str, tuple[int, ...]]]:
        """Walks off the path from its vertex i until they come back or reach the end."""
        todo = [(i, on[i], on[i], ())]
        while todo:
            p, v, piece, way = todo.pop()
            if p > i and (v == on[p] or p == self.last):
                if p - i > 1 or v != on[p]:
                    yield p, piece, way
            elif p - i < self.longest:
                todo += [(p + 1, d, piece + d[-1], (*way, e)) for d, e in self.out.get((p, v), ())]

    def coming(self, i: int, on: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Walks off the path from position 0 to its vertex i."""
        back = [(i, on[i], on[i], ())]
        while back:
            p, v, piece, way = back.pop()
            if p == 0:
                yield piece, way
            else:
                back += [(p - 1, s, s[0] + piece, (e, *way)) for s, e in self.into.get((p, v), ()) if s != on[p - 1]]


class Chains:
    """States of chains, each over one of ``graphs``: ``members`` are (graph, sample, chain).

    Paths of a chain are in slots, in the order in which they came. Edges have numbers over
    all chains; each chain has one more, of no weight, for places behind a path's end.
    """

    #: Paths whose handles are remembered, for all chains together; then all are forgotten.
    MOST = 100_000
    #: Steps of the trace that are handed out together.
    TRACE = 100_000

    def __init__(self, graphs: list[Graph], members: list[tuple[int, int, int]], settings):
        self.s, self.graphs = settings, graphs
        self.sample = np.array([s for _, s, _ in members])
        self.chain = np.array([c for _, _, c in members])
        self.graph = [g for g, _, _ in members]
        self.rng = [np.random.Generator(np.random.PCG64([settings.seed, s, c])) for _, s, c in members]
        self.random = [g.random for g in self.rng]
        self.normal = [g.standard_normal for g in self.rng]
        self.raw = [g.bit_generator.random_raw for g in self.rng]
        many, wide = len(members), max(len(g.weight) for g in graphs) + 1
        self.wide = wide
        self.long, self.slots = max(g.last for g in graphs), 6
        self.last = np.array([graphs[g].last for g in self.graph])
        self.base = np.arange(many) * wide
        self.none = self.base + wide - 1
        weights = np.zeros((len(graphs), wide))
        for g, graph in enumerate(graphs):
            weights[g, : len(graph.weight)] = graph.weight
        self.weight = weights[self.graph].ravel()
        self.error = -self.weight  # coverage - weight
        self.by_chain = self.error.reshape(many, wide)
        self.known = [len(g.weight) for g in graphs]
        self.path = np.repeat(self.none, self.slots * self.long).reshape(many, self.slots, self.long)
        self.share = np.zeros((many, self.slots))  # the path's weight in the mixture
        self.id = np.full((many, self.slots), -1)
        self.apart = np.zeros((many, self.slots, self.slots))  # weights of the edges where two paths differ
        self.meet = np.zeros((many, self.slots, self.slots), bool)  # whether they share an edge
        self.excess = np.zeros((many, self.slots))
        self.count = np.ones(many, int)
        for b, (g, rng) in enumerate(zip(self.graph, self.rng)):
            self.path[b, 0, : self.last[b]] = np.array(graphs[g].first_path(rng)) + self.base[b]
        self.share[:, 0] = 1.0
        self.add(self.path[:, 0], np.ones(many), np.arange(many))
        self.measure(np.arange(many))
        self.tables()
        self.running = np.array([-math.sumprod(e := self.by_chain[b, : self.known[g]].tolist(), e) + self.poisson[1] for b, g in enumerate(self.graph)])
        self.anew, self.best_logl = self.running.copy(), self.running.copy()
        self.best = self.path.copy(), self.share.copy(), self.count.copy()
        self.forget()

    # -- what depends on numbers of paths alone

    def tables(self) -> None:
        """For each number of paths: the log prior, and the odds of the moves."""
        r, numbers = self.s.rate, range(self.slots + 3)
        self.poisson = np.array([n * math.log(r) - r - math.lgamma(n + 1) for n in numbers])
        mix = [self.mix(n) for n in numbers]
        self.log_mix = np.log(np.maximum(np.array(mix), 1e-9))
        upto = np.cumsum(np.array(mix) / np.array([sum(m) for m in mix])[:, None], 1)
        self.moves = upto / upto[:, -1:]

    def mix(self, n: int) -> list[float]:
        r = self.s.rate
        if n <= 1:
            return [0.5, 0.5, 0.0, 0.0]
        new, move, delete = 1 / max(6.0, r + n), 1 / max(6.0, r + r / n), n / r / (r + n)
        return [new, move, delete, max(1 - new - move - delete, 0.0)]

    # -- handles, remembered by path

    def forget(self) -> None:
        for g in self.graphs:
            g.forget()
        self.id[:] = -1
        self.n_handles = self.n_paths = self.n_listed = 0
        self.start, self.stop = np.zeros(1024, int), np.zeros(1024, int)
        self.way = np.full((1024, 1), self.wide - 1)  # a handle's edges, counted in its chain
        self.first, self.many = np.zeros(1024, int), np.zeros(1024, int)  # of a path's list
        self.listed = np.zeros(8192, int)
        #: Of each handle in a list: its odds in New, their log, the log of the rest and of the
        #: rest at half the odds; in Delete the two logs.
        self.odds = np.zeros((8192, 6))

    def handle(self, start: int, stop: int, edges: tuple[int, ...]) -> int:
        at = self.n_handles
        if at == len(self.start):
            self.start, self.stop = (np.concatenate((x, x)) for x in (self.start, self.stop))
            self.way = np.concatenate((self.way, np.full_like(self.way, self.wide - 1)))
        if len(edges) > self.way.shape[1]:
            more = np.full((len(self.way), len(edges)), self.wide - 1)
            more[:, : self.way.shape[1]] = self.way
            self.way = more
        self.start[at], self.stop[at] = start, stop
        self.way[at, : len(edges)] = edges
        self.n_handles += 1
        return at

    def find(self, b: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The numbers of paths whose handles are then listed."""
        found = self.id[b, slot]
        lacking, new = np.flatnonzero(found < 0), []
        rows = (self.path[b[lacking], slot[lacking]] - self.base[b[lacking]][:, None]).astype(np.int32)
        for i, row, chain in zip(lacking.tolist(), rows, b[lacking].tolist()):
            g = self.graphs[self.graph[chain]]
            row = row[: g.last]
            key = row.tobytes()
            if key not in g.paths:
                g.paths[key] = self.n_paths + len(new)
                new.append(g.handles(row.tolist(), key, self.handle))
            found[i] = g.paths[key]
        if new:
            self.enter(new)
        self.id[b, slot] = found
        return found

    def enter(self, lists: list[list[int]]) -> None:
        """Lists of handles, each of one more path."""
        n = np.array([len(x) for x in lists])
        h = np.array([x for handles in lists for x in handles], int)
        at, lo = self.n_paths, self.n_listed
        while at + len(n) > len(self.first):
            self.first, self.many = (np.concatenate((x, x)) for x in (self.first, self.many))
        while lo + len(h) > len(self.listed):
            self.listed, self.odds = (np.concatenate((x, x)) for x in (self.listed, self.odds))
        self.first[at : at + len(n)], self.many[at : at + len(n)] = lo + np.cumsum(n) - n, n
        self.n_paths, self.n_listed = at + len(n), lo + len(h)
        if not len(h):
            return
        n = n[n > 0]
        of, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        start, stop = self.start[h], self.stop[h]
        size, apart = stop - start, of * (self.long + 1)
        # how many of a path's handles begin up to the end of one, and end before it begins
        met = np.searchsorted(apart + start, apart + stop, "right") - np.searchsorted(np.sort(apart + stop), apart + start, "left")
        least = 1 / np.maximum(np.minimum.reduceat(size, first) - 1, 1)
        sizes, overlapping = np.add.reduceat(size, first), np.add.reduceat((met > 1).astype(int), first)
        odds, back = (np.minimum(1 / np.maximum(x / 2 * n / sizes, least)[of] / size, 1 - 1e-9) for x in (n - overlapping // 2, n))
        self.listed[lo : lo + len(h)] = h
        self.odds[lo : lo + len(h)] = np.stack((odds, np.log(odds), np.log(1 - odds), np.log(1 - odds * 0.5), np.log(back), np.log(1 - back)), 1)

    def lists(self, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each path its handles side by side: which places are filled, where in the lists,
        and the handles' numbers."""
        n = self.many[paths]
        filled = np.arange(max(int(n.max(initial=0)), 1)) < n[:, None]
        at = np.where(filled, self.first[paths][:, None] + np.arange(filled.shape[1]), 0)
        return filled, at, self.listed[at]

    # -- the state

    def add(self, path: np.ndarray, amount: np.ndarray, b: np.ndarray) -> None:
        self.error[path] += amount[:, None]
        self.error[self.none[b]] = 0.0

    def measure(self, b: np.ndarray) -> None:
        """What depends on coverage, after it changed."""
        row, slot = np.nonzero(np.arange(self.slots) < self.count[b][:, None])
        b = b[row]
        self.excess[b, slot] = np.minimum(self.share[b, slot], self.error[self.path[b, slot]].sum(1) / self.last[b])

    def remove(self, b: np.ndarray, slot: np.ndarray) -> None:
        at = np.arange(self.slots)
        order = np.minimum(at + (at >= slot[:, None]), self.slots - 1)
        for at in range(int(slot.min(initial=self.slots)), int(self.count[b].max(initial=1)) - 1):
            up = b[slot <= at]
            self.path[up, at] = self.path[up, at + 1]
        for x in (self.share, self.id):
            x[b] = x[b[:, None], order]
        for x in (self.apart, self.meet):
            x[b] = x[b[:, None, None], order[:, :, None], order[:, None, :]]
        self.count[b] -= 1
        end = self.count[b]
        self.path[b, end], self.share[b, end], self.id[b, end] = self.none[b][:, None], 0.0, -1

    def append(self, b: np.ndarray, path: np.ndarray, amount: np.ndarray) -> None:
        slot = self.count[b]
        if int(slot.max(initial=0)) >= self.slots:
            self.widen()
        self.path[b, slot], self.share[b, slot], self.id[b, slot] = path, amount, -1
        self.count[b] += 1
        row, other = np.nonzero(np.arange(self.slots) <= slot[:, None])
        b, slot, path, w = b[row], slot[row], path[row], self.weight[path][row]
        others = self.path[b, other]
        differ = others != path
        weights = np.where(differ, self.weight[others] + w, 0.0).sum(1)
        meet = (~differ & (w > 0)).any(1)
        self.apart[b, slot, other], self.meet[b, slot, other] = weights, meet
        self.apart[b, other, slot], self.meet[b, other, slot] = weights, meet

    def widen(self) -> None:
        more = 2
        self.path = np.concatenate((self.path, np.broadcast_to(self.none[:, None, None], (len(self.none), more, self.long))), 1)
        best = np.concatenate((self.best[0], np.broadcast_to(self.none[:, None, None], (len(self.none), more, self.long))), 1)
        side = lambda x: np.pad(x, ((0, 0), (0, more)))
        self.share, self.excess = side(self.share), side(self.excess)
        self.best = best, side(self.best[1]), self.best[2]
        self.id = np.pad(self.id, ((0, 0), (0, more)), constant_values=-1)
        self.apart, self.meet = (np.pad(x, ((0, 0), (0, more), (0, more))) for x in (self.apart, self.meet))
        self.slots += more
        self.tables()

    # -- proposals

    def uniform(self, b: np.ndarray) -> np.ndarray:
        draw = self.raw  # as Generator.random makes of them
        return (np.array([draw[i]() for i in b.tolist()], np.uint64) >> np.uint64(11)) * 2.0**-53

    def sources(self, b: np.ndarray) -> np.ndarray:
        """The log of the sum of the scores by which a path is taken."""
        on = np.arange(self.slots) < self.count[b][:, None]
        return np.log(np.where(on, soft(self.excess[b]), 0.0).sum(1))

    def targets(self, b: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Scores of the other paths as places for weight of the one in ``slot``."""
        at = np.arange(self.slots)
        on = (at < self.count[b][:, None]) & (at != slot[:, None])
        return np.where(on, soft(-self.excess[b]) / np.maximum(self.apart[b, slot], 1e-9), 0.0)

    def amounts(self, b, source, path, target, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An amount around the shift that would even out errors; log density over its peak."""
        w, least = self.share[b, source], self.s.least
        differ = path != target
        row, n = np.nonzero(differ)[0], differ.sum(1)
        gap = np.zeros((len(b), int(n.max())))
        gap[row, np.arange(len(row)) - (np.cumsum(n) - n)[row]] = (np.minimum(w[row], self.error[path[differ]]) - self.error[target[differ]]) / 2
        mean = (w + 3 * total(gap) / self.last[b]) / 5
        mean = np.where(mean < 0, least, mean)
        std = np.maximum(np.maximum(np.where(floor, mean - least, mean), w - mean - least), least)
        draw = self.normal
        value = mean + std * np.array([draw[i]() for i in b.tolist()])
        return np.maximum(np.where(floor, least, 0.0), np.minimum(value, w - least)), -0.5 * ((value - mean) / std) ** 2

    def splice(self, b: np.ndarray, path: np.ndarray, row: np.ndarray, handles: np.ndarray) -> np.ndarray:
        """``path`` with ``handles`` put into its rows ``row``."""
        made, start = path.copy(), self.start[handles]
        size = self.stop[handles] - start
        at = np.arange(int(size.max(initial=0)))
        i, j = np.nonzero(at < size[:, None])
        made[row[i], start[i] + j] = self.way[handles[i], j] + self.base[b[row[i]]]
        return made

    def sides(self, b: np.ndarray, path: np.ndarray, handles: np.ndarray):
        """Of each handle the path's edges and its own, filled up with the edge of no weight."""
        start = self.start[handles]
        size = self.stop[handles] - start
        at = np.arange(self.way.shape[1])
        place = np.minimum(start[..., None] + at, self.long - 1) + (np.arange(len(b)) * self.long)[:, None, None]
        old = np.where(at < size[..., None], path.ravel()[place], self.none[b][:, None, None])
        return old, self.way[handles] + self.base[b][:, None, None], size

    def there(self, b: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Whether a path is one of the chain's own."""
        return (self.path[b] == target[:, None]).all(-1).any(-1)

    def propose_new(self, b, source, logp):
        """(rows that have a proposal, target paths, amounts, log jump densities)."""
        filled, at, handles = self.lists(self.find(b, source))
        odds = np.where(filled, self.odds[at, 0], -1.0)
        u = np.full(odds.shape, 2.0)
        for i, n in enumerate(filled.sum(1).tolist()):
            if n:
                u[i, :n] = self.random[b[i]](n)
        chosen = u < odds
        start, stop = self.start[handles], self.stop[handles]
        # by start, one that begins before an earlier one is over overlaps it
        until = np.maximum.accumulate(np.where(chosen, stop, -1), 1)
        for i in np.flatnonzero((chosen[:, 1:] & (start[:, 1:] <= until[:, :-1])).any(1)).tolist():
            taken = np.flatnonzero(chosen[i])
            chosen[i] = False
            chosen[i, self.independent(b[i], start[i].tolist(), stop[i].tolist(), taken.tolist())] = True
        row, h = np.nonzero(chosen)
        path = self.path[b, source]
        target = self.splice(b, path, row, handles[row, h])
        ok = np.flatnonzero(chosen.any(1) & ~self.there(b, target))
        if not len(ok):
            return ok, target[ok], np.zeros(0), np.zeros(0)
        near = np.zeros(chosen.shape, int)
        np.add.at(near, row, (start[row] <= stop[row, h][:, None]) & (start[row, h][:, None] <= stop[row]))
        logs = np.where(chosen, self.odds[at, 1], np.where(near > 0, self.odds[at, 3], self.odds[at, 2]))
        ways = np.where(filled, logs, 0.0).sum(1)[ok]
        b, source, path, target = b[ok], source[ok], path[ok], target[ok]
        amount, peak = self.amounts(b, source, path, target, np.ones(len(b), bool))
        n = self.count[b]
        forward = self.log_mix[n, NEW] + logp[ok] + peak + ways
        apart = np.maximum(np.where(path != target, self.weight[path] + self.weight[target], 0.0).sum(1), 1e-9)
        on = (np.arange(self.slots) < n[:, None]) & (np.arange(self.slots) != source[:, None])
        others = np.where(on, np.maximum(self.apart[b, source], 1e-9) ** -0.5, 0.0).sum(1)
        mean = self.error[target].sum(1) / self.last[b]
        backward = self.log_mix[n + 1, DELETE] + np.log(soft(np.minimum(amount, mean))) - self.sources(b)
        backward += -0.5 * np.log(apart) - np.log(others + apart**-0.5)
        # a single path has no odds of Delete in its mix, two have
        return ok, target, amount, self.scaled(backward - forward, self.s.shift_new, self.s.scale_new)

    def independent(self, b: int, start: list[int], stop: list[int], taken: list[int]) -> list[int]:
        """As ``Chain.independent``."""
        overlap = {j: {c for c in taken if c != j and start[c] <= stop[j] and start[j] <= stop[c]} for j in taken}
        left, conflicts = list(taken), sum(map(len, overlap.values()))
        while conflicts:
            j = left.pop(int(self.rng[b].integers(len(left))))
            for c in overlap[j]:
                overlap[c].discard(j)
            conflicts -= 2 * len(overlap.pop(j))
        return left

    def propose_move(self, b, source, logp):
        paths = self.find(b, source)
        able = np.flatnonzero(self.many[paths] > 0)
        b, source, path = b[able], source[able], self.path[b[able], source[able]]
        if not len(able):
            return able, path, np.zeros(0), np.zeros(0)
        filled, _, handles = self.lists(paths[able])
        old, new, size = self.sides(b, path, handles)
        w, mine = self.share[b, source], self.error[new]
        theirs = self.error[old]
        m = (np.minimum(w[:, None, None], theirs) - mine).sum(-1)
        scores = np.where(filled, soft(m / size / 2) / size, 0.0)
        at, _ = drawn(scores, self.uniform(b))
        row = np.arange(len(b))
        target = self.splice(b, path, row, handles[row, at])
        ok = np.flatnonzero(~self.there(b, target))
        edges = size[row, at]
        shift = np.minimum(w[:, None], mine[row, at]) / edges[:, None] - theirs[row, at]
        jump = np.log(soft(shift.sum(1) / (2 * (edges + 1))) / 2 / edges) - np.log(scores[row, at])
        return able[ok], target[ok], w[ok], jump[ok]

    def propose_delete(self, b, source, target, logp, logt):
        n = self.count[b]
        filled, at, handles = self.lists(self.find(b, target))
        old, new, _ = self.sides(b, self.path[b, source], handles)
        ways = np.where(filled, np.where((old == new).all(-1), self.odds[at, 4], self.odds[at, 5]), 0.0).sum(1)
        backward = self.log_mix[n - 1, NEW] + np.log(soft(self.excess[b, target])) - self.sources(b) + ways
        return self.scaled(backward - self.log_mix[n, DELETE] - logp - logt, self.s.shift_delete, self.s.scale_delete)

    def scaled(self, jump: np.ndarray, shift: float, scale: float) -> np.ndarray:
        return jump if self.s.mode == "metropolis" else (jump + shift) / scale

    def propose(self, live: np.ndarray):
        """Of ``live`` chains those that have a proposal: (chains, moves, paths given from, paths given to
        or -1 where new, edges of the latter, amounts, log jump densities)."""
        code = (self.moves[self.count[live]] <= self.uniform(live)[:, None]).sum(1)
        at = np.arange(self.slots)
        on = at < self.count[live][:, None]
        on &= (code != NEW)[:, None] | (self.share[live] >= 2 * self.s.least)
        able = on.any(1)
        b, code = live[able], code[able]
        scores = np.where(on[able], soft(self.excess[b]), 0.0)
        source, logp = drawn(scores, self.uniform(b)) if len(b) else (b, np.zeros(0))
        found = []
        for move, propose in ((NEW, self.propose_new), (MOVE, self.propose_move)):
            i = np.flatnonzero(code == move)
            if len(i):
                ok, target, amount, jump = propose(b[i], source[i], logp[i])
                i = i[ok]
                found.append((b[i], code[i], source[i], np.full(len(i), -1), target, amount, jump))
        i = np.flatnonzero((code == DELETE) | ((code == TRANSFER) & (self.share[b, source] > self.s.least)))
        scores = self.targets(b[i], source[i])
        scores = np.where((code[i] == DELETE)[:, None] & ~self.meet[b[i], source[i]], 0.0, scores)
        have = scores.any(1)
        i, scores = i[have], scores[have]
        if len(i):
            b, code, source, logp = b[i], code[i], source[i], logp[i]
            target, logt = drawn(scores, self.uniform(b))
            amount, jump = self.share[b, source], np.zeros(len(b))
            d, t = np.flatnonzero(code == DELETE), np.flatnonzero(code == TRANSFER)
            if len(d):
                jump[d] = self.propose_delete(b[d], source[d], target[d], logp[d], logt[d])
            if len(t):
                c, s, g = b[t], source[t], target[t]
                amount[t], peak = self.amounts(c, s, self.path[c, s], self.path[c, g], np.zeros(len(t), bool))
                back = self.targets(c, g)
                logb = np.log(back[np.arange(len(t)), s] / back.sum(1))
                jump[t] = np.log(soft(self.excess[c, g])) - self.sources(c) + logb - logp[t] - logt[t] - peak
            found.append((b, code, source, target, self.path[b, target], amount, jump))
        return [np.concatenate(x) for x in zip(*found)] if found else None

    def decide(self, b, code, source, slot, target, amount, jump):
        """(accepted, likelihood deltas) of proposals; those accepted are done."""
        path = self.path[b, source]
        differ = path != target
        row = np.nonzero(differ)[0]
        a = amount[row]
        steps = a * (2 * self.error[path[differ]] - a) - a * (2 * self.error[target[differ]] + a)
        delta, n = np.bincount(row, steps, len(b)), self.count[b]  # one after the other
        after = n + (code == NEW) - (code == DELETE)
        delta = np.where(after != n, delta + self.poisson[after] - self.poisson[n], delta)
        sign = 1.0 if self.s.mode == "metropolis" else -1.0
        accept = np.log(np.maximum(self.uniform(b), 1e-300)) < delta + sign * jump / self.s.temperature
        if accept.any():
            self.commit(b[accept], source[accept], slot[accept], path[accept], target[accept], amount[accept])
            b, gain = b[accept], delta[accept]
            self.running[b] += gain
            errors = self.by_chain[b]
            self.anew[b] = -np.einsum("ij,ij->i", errors, errors) + self.poisson[self.count[b]]
            better = b[self.running[b] > self.best_logl[b]]
            self.best_logl[better] = self.running[better]
            for kept, now in zip(self.best, (self.path, self.share, self.count)):
                kept[better] = now[better]
        return accept, delta

    def commit(self, b, source, slot, path, target, amount) -> None:
        self.add(path, -amount, b)
        self.add(target, amount, b)
        left = self.share[b, source] + -amount
        self.share[b, source] = left
        old = slot >= 0
        self.share[b[old], slot[old]] += amount[old]
        gone = left <= 1e-12
        self.remove(b[gone], source[gone])
        new = ~old & (amount > 1e-12)
        self.append(b[new], target[new], amount[new])
        self.measure(b)

    def run(self) -> Iterator[tuple[np.ndarray, ...]]:
        """All steps of all chains; the trace (chain, iter, move, accept, delta, running and
        recomputed logl, jump density) in parts."""
        every = np.arange(len(self.sample))
        zero, no = np.zeros(len(every)), np.zeros(len(every), bool)
        parts = [(every, np.zeros(len(every), int), np.full(len(every), START), ~no, zero, self.running.copy(), self.anew.copy(), zero)]
        done, tried, size = np.zeros(len(every), int), np.zeros(len(every), int), len(every)
        live = every[done < self.s.iterations]
        while len(live):
            if self.n_paths > self.MOST:
                self.forget()
            tried[live] += 1
            found = self.propose(live)
            if found is not None:
                b, code, jump = found[0], found[1], found[6]
                accept, delta = self.decide(*found)
                done[b] += 1
                tried[b] = 0
                parts.append((b, done[b], code, accept, delta, self.running[b], self.anew[b], jump))
                size += len(b)
            late = live[tried[live] >= self.s.retries]
            if len(late):
                done[late] += 1
                tried[late] = 0
                m = len(late)
                parts.append((late, done[late], np.full(m, FAIL), no[:m], zero[:m], self.running[late], self.anew[late], zero[:m]))
                size += m
            if size >= self.TRACE:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, size = [], 0
            if (done[live] >= self.s.iterations).any():
                live = live[done[live] < self.s.iterations]
        if parts:
            yield tuple(map(np.concatenate, zip(*parts)))

    def mixtures(self) -> Iterator[tuple[int, str, str, float, float]]:
        """(chain, kind, seq, weight, logl) of the last and the best states."""
        for kind, (path, share, count), logl in (("last", (self.path, self.share, self.count), self.running), ("best", self.best, self.best_logl)):
            for b, g in enumerate(self.graph):
                graph = self.graphs[g]
                rows = (path[b, : count[b], : graph.last] - self.base[b]).tolist()
                yield from sorted((b, kind, graph.spell(row), w, float(logl[b])) for row, w in zip(rows, share[b].tolist()))
