"""Shared helpers: reading tables, durable intermediates, Arrow batches as bytes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words in the contracts: space and \t \n \v \f \r.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: Rows and bytes of a batch that goes to a Python worker: what a worker holds follows these.
BATCH_ROWS, BATCH_BYTES = 1_000, 2 << 20
#: Hot keys that are broadcast, and the rows from which a key can be hot. A key is hot from
#: a share of 1 / MOST_HOT of all rows on, so that there can't be more hot keys than that.
MOST_HOT, LEAST_HOT = 50_000, 500
#: Rows that one task may have: smaller tables have no hot key.
ONE_TASK = 5_000
#: Parts into which a hot key's rows are split.
SALTS = 64

_TEST_DIRS: dict[str, str] = {}

#: Tables of operators in this worker, and those that its present task has asked for.
_KEPT: dict[str, object] = {}
_USED: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is named and
    driver and executors are one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _TEST_DIRS:
        _TEST_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="strandflow-")
    return _TEST_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends
    there, so a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Tables:
    """Tables that one step writes and reads again, deleted together when it is over."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return materialise(df, name, self.paths[-1])

    def clear(self) -> None:
        """Also the shuffles behind them: Spark deletes those of plans that nothing holds any
        more, but only once the driver's heap is collected, which may be long after."""
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []
        gc.collect()
        self.spark._jvm.System.gc()


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key) of ``counts`` (key, n) with so many of ``total`` rows that one task shouldn't
    have them all; MOST_HOT keys at most, as each has at least that share of the rows.
    None if all rows fit into one task."""
    if total <= ONE_TASK:
        return None
    return counts.where(F.col("n") > max(LEAST_HOT, total / MOST_HOT)).select(key)


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner", salts: int = SALTS, by: tuple[str, ...] = ()) -> DataFrame:
    """``many`` joined with ``one`` on ``key``, the rows of each key in ``hot`` (bounded, see
    ``hot_keys``) and those without a key dealt to ``salts`` parts by a hash of ``by`` or
    all columns; ``one`` should have few rows for such a key."""
    if hot is None:
        return many.join(one, key, how)
    keys = F.broadcast(hot.select(F.col(key).alias("_hot_key")))
    mark = lambda df: df.join(keys, F.col(key) == F.col("_hot_key"), "left")
    spread = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    part = F.when(spread, F.pmod(F.xxhash64(*(by or many.columns)), F.lit(salts))).otherwise(0).cast("int")
    every = F.explode(F.when(F.col("_hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    left = mark(many).select(*many.columns, part.alias("_part"))
    right = mark(one).select(*one.columns, every.alias("_part"))
    return left.join(right, [key, "_part"], how).drop("_part")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def in_training(doc_id: str = "doc_id"):
    """Rows that a model may learn from: a non-null id outside the held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


def place(*key: str):
    """A number from 0 to 1 that a hash of ``key`` gives: samples drawn by it don't depend
    on partitions, and rows with the same key are in or out together."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches in this session, so that several workers fit beside the heap.

    The plan reads these settings when it runs, so they stay; they are only ever lowered.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))
    if not 0 < given <= BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)


def kept_in_worker(name: str, make: Callable[[], object]):
    """What ``make`` gives, made once in a worker and kept for its next tasks; a task that ends
    there without having asked for it lets it go (``release``)."""
    _USED.add(name)
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Hand free memory back to the system: a Python worker lives on after its task, and
    what it still held would stand beside the executor's heap. Workers go from operator to
    operator, so what this task didn't use is dropped."""
    for name in _KEPT.keys() - _USED:
        del _KEPT[name]
    _USED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and its offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows whose bytes together are at most ``most``; a longer row is
    a run of its own, so that memory follows the longest text and not the batch."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that end before a space, so that a very long
    one is taken apart bit by bit."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def add_columns(
    df: DataFrame,
    fields: list[tuple[str, str]],
    make: Callable[[pa.RecordBatch], Iterable[pa.Array]],
    without: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with ``fields`` computed batch-wise by ``make``.

    Input columns of the same name give way to the new ones; those in ``without`` reach
    ``make`` but are left out of the result.
    """
    bound_batches(df.sparkSession)
    new = {name for name, _ in fields}
    df = df.drop(*[c for c in df.columns if c in new])
    keep = [f for f in df.schema.fields if f.name not in without]
    added = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = list(make(batch))
            old = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(old + made, names=names + [n for n, _ in fields])
            del batch, made, old
        release()

    return df.mapInArrow(run, T.StructType(keep + added.fields))


def keep_rows(df: DataFrame, using: dict[str, str | Column], mask: Callable[..., np.ndarray]) -> DataFrame:
    """The rows of ``df`` that ``mask`` keeps, all columns as they are.

    ``mask`` gets an Arrow array for each entry of ``using``: a column of ``df`` by its
    name, or an expression, which travels under a name that no column of ``df`` has.
    """
    bound_batches(df.sparkSession)
    made = {k: c for k, c in using.items() if not isinstance(c, str)}
    added = dict(zip(made, free_names(df, *made), strict=True))
    columns = [*df.columns, *added.values()]
    places = [columns.index(added[k] if k in added else c) for k, c in using.items()]
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = mask(*[batch.column(i) for i in places])
                yield batch.select(list(range(width))).filter(pa.array(keep, pa.bool_()))
                del batch
        release()

    return df.select("*", *[made[k].alias(n) for k, n in added.items()]).mapInArrow(run, df.schema)
