"""Handles and other intervals over positions: overlap, containment, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def range_join(left: DataFrame, right: DataFrame, on: list[str], width: int) -> DataFrame:
    """Pairs whose closed intervals overlap; ``left`` has start, stop, ``right`` start_r, stop_r.

    Both sides are posted in bins of ``width`` positions and meet by equality; a pair counts
    in the first bin both have, so it comes once. Bins keep the join an equi-join that is
    split when a bin is hot.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    one = left.where("start <= stop").withColumn("_bin", bins("start", "stop"))
    two = right.where("start_r <= stop_r").withColumn("_bin", bins("start_r", "stop_r"))
    first = F.floor(F.greatest("start", "start_r") / width)
    meet = (F.col("start") <= F.col("stop_r")) & (F.col("start_r") <= F.col("stop")) & (F.col("_bin") == first)
    return one.join(two, [*on, "_bin"]).where(meet).drop("_bin")


def overlaps(handles: DataFrame, width: int = 8) -> DataFrame:
    """(path_id, handle, other) of handles of the same path that overlap."""
    other = handles.select("path_id", F.col("handle_id").alias("other"), F.col("start").alias("start_r"), F.col("stop").alias("stop_r"))
    pairs = range_join(handles.select("path_id", F.col("handle_id").alias("handle"), "start", "stop"), other, ["path_id"], width)
    return pairs.where("handle <> other").select("path_id", "handle", "other")


def independent(handles: DataFrame, seed: int = 42, width: int = 8) -> DataFrame:
    """(path_id, handle_id): a largest-possible choice of handles of each path of which no two
    overlap: what is left out overlaps one that is chosen.

    The same as going through a path's handles in the order of a seeded digest of their ids and
    taking each that overlaps none before it. Every round takes all handles whose open
    neighbours come later and closes those neighbours, so a few rounds, as many as the longest
    chain of handles that wait for each other, decide all paths.
    """
    rank = lambda c: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("path_id").cast("string"), F.col(c).cast("string"))), F.col(c))
    pairs = written(overlaps(handles, width), "overlaps")
    waits = written(pairs.where(rank("other") < rank("handle")), "waits")
    open_ = written(handles.select("path_id", F.col("handle_id").alias("handle")).distinct(), "open")
    chosen = open_.limit(0)
    while not open_.isEmpty():
        free = written(open_.join(waits.select("path_id", "handle").distinct(), ["path_id", "handle"], "left_anti"), "free")
        chosen = chosen.unionByName(free)
        closed = pairs.join(free, ["path_id", "handle"]).select("path_id", F.col("other").alias("handle")).union(free).distinct()
        open_ = written(open_.join(closed, ["path_id", "handle"], "left_anti"), "open")
        waits = waits.join(open_, ["path_id", "handle"], "left_semi")
        waits = written(waits.join(open_.withColumnRenamed("handle", "other"), ["path_id", "other"], "left_semi"), "waits")
    return chosen.select("path_id", F.col("handle").alias("handle_id"))


def contained(handles: DataFrame, paths: DataFrame) -> DataFrame:
    """(handle_id, path_id) of handles whose sequence a path has at their place."""
    joined = handles.select("sample_id", "handle_id", "start", "seq").join(paths.select("sample_id", "path_id", F.col("seq").alias("path")), "sample_id")
    return joined.where(F.substring("path", F.col("start") + 1, F.length("seq")) == F.col("seq")).select("sample_id", "handle_id", "path_id")


def remaining(handles: DataFrame, taken: DataFrame, on: list[str]) -> DataFrame:
    """The ``handles`` that are not among those ``taken``: a set difference on ``on``."""
    return handles.join(taken.select(*on).distinct(), on, "left_anti")


def touching(handles: DataFrame, covered: DataFrame, on: list[str], width: int = 8) -> DataFrame:
    """The ``handles`` that some interval of ``covered`` (start_r, stop_r), open at its end,
    meets: a semi-join on ranges, in bins."""
    closed = covered.withColumn("stop_r", F.col("stop_r") - 1)
    return range_join(handles, closed, on, width).select(*handles.columns).distinct()


def excess_scores(handles: DataFrame, errors: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """(sample_id, path_id, start, stop, seq, score): how much a handle would even out.

    Sums, over the handle's edges, the negative errors, and over the replaced stretch of
    the path the excess min(weight, error); half of it per edge, softened, per edge.
    """
    from ..functions.likelihood import soft
    from ..functions.sequence import path_edges

    known = errors.select("sample_id", "position", "src", "dst", "error")
    id_ = ["sample_id", "path_id", "start", "stop", "seq"]
    both = handles.join(paths.select("sample_id", "path_id", F.col("seq").alias("path"), F.col("weight").alias("path_weight")), ["sample_id", "path_id"])
    old = F.substring("path", F.col("start") + 1, F.length("seq"))
    steps = lambda c, side: both.withColumn("piece", c).select(*id_, "path_weight", F.lit(side).alias("new"), F.inline(path_edges("piece", k)))
    placed = steps(F.col("seq"), True).unionByName(steps(old, False)).withColumn("position", F.col("position") + F.col("start"))
    part = F.when(F.col("new"), -F.col("error")).otherwise(F.least("path_weight", "error"))
    sums = placed.join(known, ["sample_id", "position", "src", "dst"]).groupBy(*id_).agg(F.sum(part).alias("m"))
    edges = F.col("stop") - F.col("start")
    return sums.select(*id_, (soft(F.col("m") / edges / 2) / edges).alias("score"))


def runs(marked: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Maximal runs of consecutive ``at`` values: start, stop and size.

    64 neighbouring values are the bits of one long, summed up by OR before anything is shuffled, so
    that rows are blocks, not values. Runs begin and end where bits change; one that goes on
    from the block before takes the last start there was. A null value is a run of its own.
    """
    kind = marked.schema[at].dataType
    long = lambda n: F.lit(n).cast("bigint")
    place, one, top = F.col(at).cast("bigint"), long(1), long(-1 << 63)
    bit = F.call_function("shiftleft", one, place.bitwiseAND(long(63)).cast("int"))
    blocks = marked.groupBy(*keys, F.shiftright(place, 6).alias("_block")).agg(F.bit_or(bit).alias("_mask"))
    order = Window.partitionBy(*keys).orderBy("_block")
    block, mask = F.col("_block"), F.col("_mask")
    goes_on = (F.lag(block).over(order) == block - 1) & (F.lag(mask).over(order) < 0) & (mask.bitwiseAND(one) == 1)
    is_led = (F.lead(block).over(order) == block + 1) & (F.lead(mask).over(order).bitwiseAND(one) == 1)
    marks = blocks.withColumn("_on", F.coalesce(goes_on, F.lit(False))).withColumn("_led", F.coalesce(is_led, F.lit(False)))
    before = F.shiftleft(mask, 1).bitwiseOR(F.when(F.col("_on"), one).otherwise(long(0)))
    after = F.shiftrightunsigned(mask, 1).bitwiseOR(F.when(F.col("_led"), top).otherwise(long(0)))
    marks = marks.withColumn("_starts", mask.bitwiseAND(F.bitwise_not(before))).withColumn("_ends", mask.bitwiseAND(F.bitwise_not(after)))
    highest = lambda m: F.length(F.bin(m)) - 1
    last = F.when(F.col("_starts") != 0, block * 64 + highest(F.col("_starts")))
    marks = marks.withColumn("_last", F.last(last, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))

    def places(m: str) -> Column:
        bits = F.filter(F.sequence(F.lit(0), highest(F.col(m))), lambda i: F.call_function("shiftrightunsigned", F.col(m), i).bitwiseAND(one) == 1)
        return F.when(F.col(m) != 0, F.transform(bits, lambda i: block * 64 + i)).otherwise(F.array().cast("array<bigint>"))

    starts = F.concat(F.when(F.col("_on"), F.array("_last")).otherwise(F.array().cast("array<bigint>")), places("_starts"))
    run = lambda a, b: F.struct(a.cast(kind).alias("start"), b.cast(kind).alias("stop"), (b - a + 1).alias("size"))
    pairs = F.zip_with(F.slice(starts, F.lit(1), F.size(places("_ends"))), places("_ends"), run)
    nothing = F.array(F.struct(F.lit(None).cast(kind).alias("start"), F.lit(None).cast(kind).alias("stop"), F.lit(1).cast("bigint").alias("size")))
    return marks.select(*keys, F.inline(F.when(block.isNull(), nothing).otherwise(pairs)))


def handles(edges: DataFrame, paths: DataFrame, k: int, longest: int) -> DataFrame:
    """Sub-walks that leave a path and come back to it, or run to an end of the graph, within
    ``longest`` edges.

    (sample_id, path_id, start, stop, seq): the walk's first and last positions, and what it
    spells. Stretches of 1, 2, 4 .. edges off the path are joined end to end, and walks that
    left the path, or began beside it at position 0, are extended by each length in turn: after
    j rounds all open walks with fewer than 2^j edges off the path are there. Those in the
    sample's last layer are handles, and those that an edge takes back to the path.
    """
    leaves = edges.select("sample_id", "position", "src", "dst")
    last = leaves.groupBy("sample_id").agg((F.max("position") + 1).alias("last"))
    on = paths.select("sample_id", "path_id", F.col("seq").alias("path"))
    at, id_ = F.col("position"), ["sample_id", "path_id"]
    spelled = lambda pos: F.substring("path", pos + 1, F.lit(k))
    beside = on.join(leaves, "sample_id").withColumns({"leaves": F.col("src") == spelled(at), "returns": F.col("dst") == spelled(at + 1)})
    beside = written(beside.where("NOT (leaves AND returns)").drop("path"), "beside")
    letter = F.right("dst", F.lit(1))

    left = beside.where("leaves").select(*id_, at.alias("start"), (at + 1).alias("at"), F.col("dst").alias("kmer"), F.concat("src", letter).alias("seq"), F.lit(True).alias("left"))
    began = beside.where("position = 0 AND NOT leaves").select(*id_, at.alias("start"), at.alias("at"), F.col("src").alias("kmer"), F.col("src").alias("seq"), F.lit(False).alias("left")).distinct()
    walks = written(left.unionByName(began), "walks")
    off = beside.where("NOT leaves AND NOT returns").select(*id_, at.alias("at"), F.col("src").alias("kmer"), (at + 1).alias("to_at"), F.col("dst").alias("to"), letter.alias("more"))
    short = F.col("to_at") - F.col("start") <= longest
    size = 1
    while size <= longest:
        off = written(off, "off")
        if off.isEmpty():
            break
        longer = walks.join(off, [*id_, "at", "kmer"]).where(short)
        walks = written(walks.unionByName(longer.select(*id_, "start", F.col("to_at").alias("at"), F.col("to").alias("kmer"), F.concat("seq", "more").alias("seq"), "left")), "walks")
        rest = off.select(*id_, F.col("at").alias("to_at"), F.col("kmer").alias("to"), F.col("to_at").alias("end_at"), F.col("to").alias("end"), F.col("more").alias("rest"))
        off = off.join(rest, [*id_, "to_at", "to"]).select(*id_, "at", "kmer", F.col("end_at").alias("to_at"), F.col("end").alias("to"), F.concat("more", "rest").alias("more"))
        size *= 2

    ends = walks.where("left").join(last, "sample_id").where(F.col("at") == F.col("last")).select(*id_, "start", F.col("at").alias("stop"), "seq")
    back = beside.where("NOT leaves AND returns").select(*id_, at.alias("at"), F.col("src").alias("kmer"), letter.alias("more"))
    closed = walks.join(back, [*id_, "at", "kmer"]).where(F.col("at") + 1 - F.col("start") <= longest)
    return ends.unionByName(closed.select(*id_, "start", (F.col("at") + 1).alias("stop"), F.concat("seq", "more").alias("seq"))).distinct()
