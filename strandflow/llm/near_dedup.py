"""Near duplicates by an inverted join over MinHash coordinates.

Documents with the same set of shingles form a class, so copies cost one row. A class has
``COORDS`` MinHash coordinates. Two classes at the similarity sought agree in at least
``MATCHES`` of them (all but about one pair in a million at the very threshold), so under
any one order of coordinate values they meet in one of the first COORDS - MATCHES + 1 of
each (prefix). Rare values come first; a bounded sketch of their counts gives the order.
Lists of a value are merged: short ones by pairs, long ones through the member that is on
most long lists, skipping pairs whose set sizes alone rule them out. What agrees in enough coordinates is
confirmed on the full sets. Long lists that are then still in several components are
posted again, under the rarest shingles of their full sets (the same prefix rule, now
exact), and merged by pairs of which one side is outside the list's main component; a post's
place among a set's rarest shingles bounds the sizes of sets that it can still be similar
to, and only posts of such sizes meet. Rows of hot keys are dealt to many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, Tables, add_columns, discard, hot_keys, materialise, new_path, release, salted_join, spans, utf8

COORDS = 64
MATCHES = 34
#: Longest list merged by all its pairs; longer ones go through one member.
SHORT = 16
#: Document ids that are broadcast to pick their texts, and classes whose labels are broadcast
#: in a round of ``components``; beyond them the joins shuffle.
MOST_BROADCAST, MOST_LABELS = 500_000, 200_000
SKETCH_BITS = (16, 22)
CHUNK = 1 << 18
#: Ratio of the set sizes that share a bucket, and the parts of a bucket that is hot.
BUCKET = 1.06
FEW_SALTS = 8

_rng = np.random.Generator(np.random.PCG64(20))
_ODD = lambda n: _rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = _ODD(256)
BASE = _ODD(1)[0]
PLACE = _ODD(64)
FACTOR = _ODD(COORDS)

_lower = np.arange(256)
_lower[65:91] += 32
BYTE = BYTE[_lower]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[np.frombuffer(SPACE_BYTES, np.uint8)] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64, kept up to CHUNK."""
    if len(_POWERS["p"]) >= n:
        return _POWERS["p"][:n], _POWERS["i"][:n]
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    made = []
    for b in (BASE, inverse):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=np.uint64))
    if n <= CHUNK + 1:
        _POWERS["p"], _POWERS["i"] = made
    return made[0], made[1]


@np.errstate(over="ignore")
def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each row's whole text.

    Words are runs without white space, A-Z lower-cased. With fewer words than
    ``width`` the whole sequence is the one shingle; without words the set is empty.
    """
    out: list[np.ndarray] = []
    for i, j in spans(offsets, CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        raw, cuts = data[lo:hi], offsets[i : j + 1] - lo
        n = hi - lo
        if not n:
            out += [np.zeros(0, np.uint64)] * (j - i)
            continue
        word = ~IS_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[cuts] = True
        before = np.concatenate([[False], word[:-1]])
        starts = np.flatnonzero(word & (~before | edge[:n]))
        after = np.concatenate([word[1:], [False]])
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[raw] * power[:n], out=sums[1:])
        h = _mix((sums[ends] - sums[starts]) * inverse[starts])
        first = np.searchsorted(starts, cuts)
        m = len(h) - width + 1
        joined = sum(h[k : m + k] * PLACE[k % 64] for k in range(width)) if m > 0 else np.zeros(0, np.uint64)
        joined = _mix(joined)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(joined[a : b - width + 1]))
            elif b > a:
                whole = (h[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + PLACE[63] * np.uint64(b - a)
                out.append(_mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


@np.errstate(over="ignore")
def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(shingles):
        return 0
    total = (shingles * _mix(shingles)).sum(dtype=np.uint64) + np.bitwise_xor.reduce(shingles) * PLACE[0] + np.uint64(len(shingles))
    return int(_mix(np.array([total], np.uint64)).view(np.int64)[0])


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """COORDS coordinates of each non-empty set: rows x COORDS, 32 bits each."""
    out = np.zeros((len(sets), COORDS), np.uint32)
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 1 << 15):
            total += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        at = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        room = np.empty_like(x)
        for k in range(COORDS):
            np.multiply(x, FACTOR[k], out=room)
            out[i:j, k] = np.minimum.reduceat(room, at) >> np.uint64(32)
        i = j
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, cls (the set's class) and sig of every document."""

    def make(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        sizes, classes, sig = [], [], []
        for i, j in spans(offsets, CHUNK):  # a stretch's sets are gone before the next
            sets = shingle_sets(data, offsets[i : j + 1], width)
            sizes += [len(s) for s in sets]
            classes += [class_of(s) for s in sets]
            rows = iter(minhash([s for s in sets if len(s)]))
            sig += [next(rows).tobytes() if len(s) else None for s in sets]
        return pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sig, pa.binary())

    fields = [("n_shingles", "bigint"), ("cls", "bigint"), ("sig", "binary")]
    return add_columns(docs.select("doc_id", "text"), fields, make, without=("text",))


def _coords(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)


def _keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each coordinate and its value."""
    return _mix(sig.astype(np.uint64) + (np.arange(1, COORDS + 1, dtype=np.uint64) << np.uint64(32)))


def _prefix(table: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Of each row of keys the ``size`` first, the rarest by the table of counts."""
    shift = np.uint64(64 - int(math.log2(len(table))))
    often = table[(keys >> shift).astype(np.int64)].astype(np.uint64)
    order = (often << np.uint64(58)) | (keys >> np.uint64(6))  # one order for all rows
    return np.take_along_axis(keys, np.argsort(order, axis=-1)[..., :size], -1)


def _sketch(rows: DataFrame, keys, size: int) -> np.ndarray:
    """Counts of hashed keys, as powers of two, in a table of bounded size.

    ``keys`` gives the 64-bit keys of a batch, ``size`` is about how many there are.
    """
    bits = min(max(int(math.log2(max(size, 1))) + 1, SKETCH_BITS[0]), SKETCH_BITS[1])
    shift = np.uint64(64 - bits)

    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((keys(batch) >> shift).astype(np.int64).ravel(), minlength=1 << bits)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["b", "c"])
        del total, at
        release()

    counts = rows.mapInArrow(run, "b bigint, c bigint").groupBy("b").agg(F.sum("c").alias("c"))
    found = counts.where("c > 1").select("b", F.ceil(F.log2("c")).cast("byte").alias("c")).toArrow()
    table = np.zeros(1 << bits, np.uint8)
    table[np.asarray(found.column("b"))] = np.asarray(found.column("c"))
    return table


def _posts(rows: DataFrame, make) -> DataFrame:
    """(k, cls, n, place) for the keys that ``make`` gives each row of a batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row, k, place = make(batch)
                cls, n = (np.asarray(batch.column(c)) for c in ("cls", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(cls[row]), pa.array(n[row]), pa.array(place)], names=["k", "cls", "n", "place"])
        release()

    return rows.mapInArrow(run, "k bigint, cls bigint, n bigint, place bigint")


def _coordinate_posts(classes: DataFrame) -> DataFrame:
    rows = classes.select("cls", "n", "sig")
    table = _sketch(rows, lambda batch: _keys(_coords(batch.column("sig"))), classes.count() * COORDS // 8)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    size = COORDS - MATCHES + 1

    def make(batch: pa.RecordBatch):
        k = _prefix(shared.value, _keys(_coords(batch.column("sig"))), size)
        return np.repeat(np.arange(len(k)), size), k.ravel(), np.tile(np.arange(size), len(k))

    return _posts(rows, make)


def _set_posts(sets: DataFrame, percent: int) -> DataFrame:
    """Posts under the first n - need + 1 shingles of each set; those that only one set has
    can't be shared and are left out."""
    rows = sets.select("cls", "n", "items")
    items = lambda batch: [_mix(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column("items")]
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = _sketch(rows, lambda batch: np.concatenate(items(batch)), int(total) * 2)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def make(batch: pa.RecordBatch):
        table, row, keys, places = shared.value, [], [], []
        shift = np.uint64(64 - int(math.log2(len(table))))
        for i, k in enumerate(items(batch)):
            k = _prefix(table, k, len(k) - -(-len(k) * percent // 100) + 1)
            place = np.flatnonzero(table[(k >> shift).astype(np.int64)] > 0)
            row.append(np.full(len(place), i))
            keys.append(k[place])
            places.append(place)
        return np.concatenate(row), np.concatenate(keys), np.concatenate(places)

    return _posts(rows, make)


def _lists(posts: DataFrame, total: int, kept: Tables) -> DataFrame:
    """Posts whose key has two classes or more, with the size of the list; ``total`` is about
    how many posts there are."""
    here = Tables(posts.sparkSession)
    sizes = here.write(posts.groupBy("k").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    hot = hot_keys(sizes.withColumnRenamed("size", "n"), "k", total)
    lists = kept.write(salted_join(posts, sizes, "k", hot), "lists")
    here.clear()
    return lists


def _skip(percent: int, a: str, b: str):
    """Set sizes that a link allows."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _merge(lists: DataFrame, percent: int, here: Tables) -> DataFrame:
    """Candidate pairs a < b: all pairs of short lists, in long ones those with its head.

    What is written on the way to them is one of the tables ``here``, as in the functions below.
    """
    short = lists.where(F.col("size") <= SHORT).select("k", "cls", "n")
    left, right = short.select("k", F.col("cls").alias("a"), F.col("n").alias("na")), short.select("k", F.col("cls").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "k").where((F.col("a") < F.col("b")) & _skip(percent, "na", "nb"))
    long = lists.where(F.col("size") > SHORT).select("k", "cls", "n", "size")
    # a group's middle is on most of its long lists; its members are near it, if not each other
    central = long.groupBy("cls").agg(F.count("*").alias("on"))
    heads = here.write(long.join(central, "cls").groupBy("k").agg(F.max(F.struct("on", "n", "cls")).alias("head"), F.first("size").alias("size")), "heads")
    total = heads.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = hot_keys(heads.withColumnRenamed("size", "n"), "k", total)
    heads = heads.select("k", F.col("head.cls").alias("mid"), F.col("head.n").alias("nm"))
    star = salted_join(long.drop("size"), heads, "k", hot).where((F.col("cls") != F.col("mid")) & _skip(percent, "n", "nm"))
    stars = star.select(F.least("cls", "mid").alias("a"), F.greatest("cls", "mid").alias("b"))
    return pairs.select("a", "b").unionByName(stars).distinct()


def _merge_apart(lists: DataFrame, labels: DataFrame, percent: int, here: Tables) -> DataFrame:
    """Candidate pairs a < b of different components: in each list, those of which one side
    is outside the component that most of the list is in.

    Sets of n and m shingles that share none before the places p and q of a shingle can
    only be similar if m <= (n - p) * (100 + percent) / percent - n, and likewise n. So a
    post meets posts in the buckets of the sizes that its place allows, not its whole list.
    """
    of = lists.select("k", "cls", "n", "place", "size").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    sizes = of.groupBy("k", "comp").agg(F.count("*").alias("size"))
    main = here.write(sizes.groupBy("k").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count("*").alias("comps"), F.sum("size").alias("n")).where("comps > 1"), "main")
    total = main.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    split = here.write(salted_join(of.drop("size"), main.select("k", "main"), "k", hot_keys(main, "k", total)), "split")
    bucket = lambda size: F.floor(F.log(size) / math.log(BUCKET))
    key = lambda b: F.xxhash64("k", b).alias("kb")
    most = (F.col("n") - F.col("place")) * (100 + percent) / percent - F.col("n")
    least = F.col("n") * percent / 100
    meets = F.explode(F.sequence(bucket(least - 1e-6), bucket(most + 1e-6)))
    left = split.where((F.col("comp") != F.col("main")) & (most >= least)).select("k", "cls", "n", "place", "comp", meets.alias("bucket"))
    left = left.select(key("bucket"), F.col("k").alias("ka"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("comp").alias("ca"))
    right = split.select(key(bucket(F.col("n"))), F.col("k").alias("kb_"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("comp").alias("cb"))
    counts = left.groupBy("kb").agg(F.count("*").alias("n"))
    # what two sets of these sizes must share can't all stand after these places
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    early = (F.col("pa") + need <= F.col("na")) & (F.col("pb") + need <= F.col("nb"))
    joined = salted_join(left, right, "kb", hot_keys(counts, "kb", total), salts=FEW_SALTS)
    pairs = joined.where((F.col("ka") == F.col("kb_")) & (F.col("ca") != F.col("cb")) & _skip(percent, "na", "nb") & early)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hubs(pairs: DataFrame) -> DataFrame | None:
    """(cls) of the classes that are on so many of the ``pairs`` that one task shouldn't
    have them all."""
    return hot_keys(_ends(pairs).groupBy("cls").agg(F.count("*").alias("n")), "cls", 2 * pairs.count())


def _at_both(pairs: DataFrame, table: DataFrame, hubs: DataFrame | None, names: dict[str, tuple[str, str]], how: str = "inner") -> DataFrame:
    """``pairs`` (a, b) with columns of ``table`` (cls, ..) for either side, under the
    names given for each."""
    for side, at in (("a", 0), ("b", 1)):
        one = table.select(F.col("cls").alias(side), *[F.col(c).alias(n[at]) for c, n in names.items()])
        hot = hubs.withColumnRenamed("cls", side) if hubs is not None else None
        pairs = salted_join(pairs, one, side, hot, how, by=("a", "b"))
    return pairs


def _agreeing(pairs: DataFrame, classes: DataFrame, here: Tables) -> DataFrame:
    """The pairs that agree in MATCHES coordinates or more, with the number."""
    pairs = here.write(pairs.select("a", "b"), "pairs")
    both = _at_both(pairs, classes.select("cls", "sig"), _hubs(pairs), {"sig": ("sa", "sb")})

    def make(batch: pa.RecordBatch):
        return [pa.array((_coords(batch.column("sa")) == _coords(batch.column("sb"))).sum(1).astype(np.int32))]

    return add_columns(both.select("a", "b", "sa", "sb"), [("agree", "int")], make, without=("sa", "sb")).where(F.col("agree") >= MATCHES)


def _sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, width: int, kept: Tables) -> DataFrame:
    """(cls, n, items) of the ``wanted`` classes, from the whole text of one document each."""
    here = Tables(docs.sparkSession)
    wanted = here.write(reps.join(wanted.select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("want"), "doc_id"), "wanted")
    few = wanted.count() <= MOST_BROADCAST
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id")

    def make(batch: pa.RecordBatch):
        sets = shingle_sets(*utf8(batch.column("text")), width)
        return pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())

    made = add_columns(rows, [("cls", "bigint"), ("n", "bigint"), ("items", "binary")], make, without=("text", "doc_id"))
    # an id that repeats with another text gives another class
    sets = kept.write(made.where("cls = want").select("cls", "n", "items").dropDuplicates(["cls"]), "sets")
    here.clear()
    return sets


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, here: Tables) -> DataFrame:
    """``pairs`` with ``linked``: whether the full sets are similar enough."""
    pairs = here.write(pairs.select("a", "b"), "tried")

    def make(batch: pa.RecordBatch):
        out = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("ia"), batch.column("ib"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            same = len(x) + len(y) - len(np.union1d(x, y))
            out[i] = 100 * same >= percent * (len(x) + len(y) - same)
        return [pa.array(out)]

    both = _at_both(pairs, sets.select("cls", "items"), _hubs(pairs), {"items": ("ia", "ib")})
    return add_columns(both.select("a", "b", "ia", "ib"), [("linked", "boolean")], make, without=("ia", "ib"))


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) of the classes on ``edges`` (a, b): the smallest class reachable.

    Each round takes the least label's label among a class's neighbours for the class and
    for the label that it had, so whole trees move at once: about log2 of the longest path
    rounds. Each is written, and the tables of the round before are deleted.
    """
    spark, here = edges.sparkSession, Tables(edges.sparkSession)
    both = here.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    old = [new_path(spark, "labels")]
    labels = materialise(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels", old[0])
    vertices = labels.count()
    few, hubs = vertices <= MOST_LABELS, None
    if not few:
        hubs = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b", both.count())
        hubs = hubs and here.write(hubs, "hubs")
    while True:
        paths = [new_path(spark, "step"), new_path(spark, "labels")]
        top = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("top"))
        if few:  # each label at its class travels once: a round shuffles edges and steps, not labels
            tops = F.broadcast(labels.join(F.broadcast(top), "comp"))
            near = both.join(tops.select(F.col("cls").alias("b"), "top"), "b")
        else:
            roots = hot_keys(labels.groupBy("comp").agg(F.count("*").alias("n")), "comp", vertices)
            tops = salted_join(labels, top, "comp", roots)
            near = salted_join(both, tops.select(F.col("cls").alias("b"), "top"), "b", hubs)
        near = near.groupBy(F.col("a").alias("cls")).agg(F.min("top").alias("near"))
        step = materialise(near.join(tops, "cls").select("comp", "cls", "top", "near"), "step", paths[0])
        hook = step.groupBy(F.col("comp").alias("cls")).agg(F.min("near").alias("hook"))
        least = F.least("comp", "top", "near", "hook").alias("comp")  # leaves nulls out
        nxt = materialise(step.join(F.broadcast(hook) if few else hook, "cls", "left").select("cls", F.col("comp").alias("was"), least), "labels", paths[1])
        done = nxt.where("was <> comp").isEmpty()
        labels = nxt.select("cls", "comp")
        for path in [*old, paths[0]]:
            discard(spark, path)
        old = [paths[1]]
        if done:
            here.clear()
            return labels


def _apart(pairs: DataFrame, labels: DataFrame, here: Tables) -> DataFrame:
    """The pairs whose classes are in different components."""
    pairs = here.write(pairs.select("a", "b"), "pairs")
    both = _at_both(pairs, labels, _hubs(pairs), {"comp": ("ca", "cb")}, "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _link(candidates: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Components after confirming ``candidates`` (a, b, agree), from ``labels`` on.

    Each class first tries the candidate it agrees with most, which joins most of each
    group; then only the pairs still in different components are tried.
    """
    kept, here = Tables(sets.sparkSession), Tables(sets.sparkSession)
    links = labels.select(F.col("cls").alias("a"), F.col("comp").alias("b"))  # what holds already
    best = F.max(F.struct("agree", "a", "b")).alias("p")
    first = candidates.groupBy("b").agg(best).select("p.a", "p.b").union(candidates.groupBy("a").agg(best).select("p.a", "p.b")).distinct()
    tried = kept.write(_confirm(first, sets, percent, here), "links")
    here.clear()
    links = links.union(tried.where("linked").select("a", "b"))
    labels = components(links)
    rest = _apart(candidates.join(tried, ["a", "b"], "left_anti"), labels, here)
    more = kept.write(_confirm(rest, sets, percent, here).where("linked"), "links")
    here.clear()
    if not more.isEmpty():
        # the components stand for their classes from here on
        labels = components(labels.select(F.col("cls").alias("a"), F.col("comp").alias("b")).union(more.select("a", "b")))
    kept.clear()
    return labels


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))


def find_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Documents are linked when 100 * shared >= percent * united shingles, on full sets;
    component_id is the smallest doc_id reachable. A null or wordless text has no
    shingles and links with nothing; a row with a null doc_id keeps a null
    component_id, links nothing and is kept. Equal rows stay equal rows. An empty table
    gives an empty result. Other columns are not read.
    """
    rows = materialise(signatures(docs, width), "signatures")
    alive = rows.where("n_shingles > 0 and doc_id is not null")
    reps = alive.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = materialise(reps, "classes")
    labels = _all_links(docs, classes.drop("copies"), width, percent)
    named = classes.select("cls", F.col("doc_id").alias("low")).join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    total, n_classes = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    of_class = salted_join(named, lowest.drop("n"), "comp", hot_keys(lowest, "comp", n_classes)).select("cls", "component_id")
    copied = hot_keys(classes.select("cls", F.col("copies").alias("n")), "cls", total)
    empty = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("cls")).alias("cls"))
    out = salted_join(out, of_class, "cls", copied, "left")
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _all_links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    kept, here = Tables(docs.sparkSession), Tables(docs.sparkSession)  # until a part's end, until a table is made
    lists = _lists(_coordinate_posts(classes), classes.count() * (COORDS - MATCHES + 1), kept)
    none = classes.select("cls", F.col("cls").alias("comp")).limit(0)
    candidates = kept.write(_agreeing(_merge(lists, percent, here), classes, here), "candidates")
    here.clear()
    labels = _link(candidates, _sets(docs, classes, _ends(candidates), width, kept), none, percent)
    # long lists that are in one component by now need no more pairs
    last = Tables(docs.sparkSession)
    again = last.write(_mixed(lists.where(F.col("size") > SHORT), labels, here), "again")
    here.clear()
    kept.clear()
    if not again.isEmpty():
        sets = _sets(docs, classes, again, width, kept)
        posts = sets.agg(F.coalesce(F.sum(F.col("n") * (100 - percent) / 100 + 1), F.lit(0.0))).first()[0]
        lists = _lists(_set_posts(sets, percent), int(posts), kept)
        candidates = kept.write(_agreeing(_merge_apart(lists, labels, percent, here), classes, here), "candidates")
        here.clear()
        labels = labels if candidates.isEmpty() else _link(candidates, sets, labels, percent)
        kept.clear()
    last.clear()
    return labels


def _mixed(lists: DataFrame, labels: DataFrame, here: Tables) -> DataFrame:
    """(cls) of the classes on lists that are in two components or more."""
    of = lists.select("k", "cls").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    split = of.groupBy("k").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low <> high")
    split = here.write(split.select("k", "n"), "mixed")
    total = split.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return salted_join(lists.select("k", "cls"), split.select("k"), "k", hot_keys(split, "k", total), "left_semi").select("cls").distinct()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, columns unchanged: the smallest doc_id.

    Rows with a null id stay, as do null and wordless texts; of rows that repeat an id,
    those of the group's other members go with it and the rest stay as given.
    """
    gone = materialise(find_groups(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns)
