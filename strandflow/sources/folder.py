"""Folders of samples as a data source: one folder a sample, with files such as ``_reads``.

Spark's own readers skip names that begin with ``_``, and number no lines. Here files are
listed and read through the cluster's file system (local paths and the schemes that Arrow
opens), large ones in blocks by byte range, small ones several to a task. Names are chosen
before a file is opened.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

FORMAT = "sample_lines"
BLOCK = 64 << 20
#: Blocks grow with the input, so that a table of the blocks of cut files has at most twice as
#: many rows and can be broadcast.
MOST_BLOCKS = 50_000
_CHUNK = 1 << 20
_TEMPORARY = "_temporary"

SCHEMAS = {
    "lines": "sample string, name string, block int, line bigint, value string",
    "counts": "sample string, name string, block int, lines bigint",
    "files": "sample string, name string, bytes bigint",
}


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    system, root = arrow_fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system, root.rstrip("/")


@dataclass
class _Range:
    sample: str
    name: str
    block: int
    start: int
    stop: int


class _Task(InputPartition):
    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


def lines_between(stream, start: int, stop: int) -> Iterator[bytes]:
    """The lines that begin in bytes ``start`` .. ``stop`` of a file, without their ends: ``\\n``,
    ``\\r\\n`` or ``\\r``. Ranges that meet share no line and lose none."""
    at = max(start - 1, 0)
    stream.seek(at)
    held = stream.read(_CHUNK)
    if start > 0:  # on to the first line that begins here
        while held and (cut := held.find(b"\n")) < 0:
            at += len(held)
            held = stream.read(_CHUNK)
        if not held:
            return
        at, held = at + cut + 1, held[cut + 1 :]
    parts: list[bytes] = []  # of a line that is longer than a chunk
    while at < stop:
        *whole, rest = held.split(b"\n")
        for line in whole:
            line = b"".join([*parts, line])
            parts = []
            yield from line.removesuffix(b"\r").split(b"\r")
            at += len(line) + 1
            if at >= stop:
                return
        parts.append(rest)
        held = stream.read(_CHUNK)
        if not held:
            if last := b"".join(parts):
                yield from last.removesuffix(b"\r").split(b"\r")
            return


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.what = options["path"], options.get("what", "lines")
        self.names, self.block = options.get("names", ".*"), int(options.get("blockBytes", BLOCK))
        self.kept: list[tuple[str, str, object]] = []

    def _keeps(self, sample: str, name: str) -> bool:
        if not re.fullmatch(self.names, name, re.DOTALL):
            return False
        tests = {"is": lambda a, b: a == b, "in": lambda a, b: a in b, "begins": lambda a, b: a.startswith(b)}
        return all(tests[kind](sample if column == "sample" else name, value) for column, kind, value in self.kept)

    def partitions(self):
        system, root = _open(self.path)
        found = []
        for info in system.get_file_info(arrow_fs.FileSelector(root, recursive=True)):
            sample, _, name = info.path[len(root) :].lstrip("/").rpartition("/")
            hidden = name.startswith(".") or _TEMPORARY in sample.split("/")
            if info.type == arrow_fs.FileType.File and not hidden and self._keeps(sample, name):
                found.append((sample, name, info.size))
        block = max(self.block, sum(size for *_, size in found) // MOST_BLOCKS)
        tasks: list[_Task] = []
        filled = 0
        for sample, name, size in sorted(found):
            cut = size > block
            if self.what == "counts" and not cut:
                continue  # a file in one block has its lines' numbers
            step = block if cut and self.what != "files" else max(size, 1)
            for k, start in enumerate(range(0, max(size, 1), step)):
                stop = min(start + step, size)
                if not tasks or filled + stop - start > block:
                    tasks.append(_Task([]))
                    filled = 0
                tasks[-1].ranges.append(_Range(sample, name, k, start, stop))
                filled += stop - start
        return tasks or [_Task([])]

    def read(self, partition):
        system, root = _open(self.path)
        for r in partition.ranges:
            if self.what == "files":
                yield (r.sample, r.name, r.stop)
                continue
            with system.open_input_file("/".join(p for p in (root, r.sample, r.name) if p)) as stream:
                lines = lines_between(stream, r.start, r.stop)
                if self.what == "counts":
                    yield (r.sample, r.name, r.block, sum(1 for _ in lines))
                    continue
                for k, line in enumerate(lines):
                    yield (r.sample, r.name, r.block, k, line.decode("utf-8", "replace"))


class _FilteredReader(_Reader):
    def pushFilters(self, filters):
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "begins"}
        for f in filters:
            if type(f) in kinds and f.attribute in (("sample",), ("name",)):
                self.kept.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def _checked(sample: str, name: str) -> str:
    parts = [*(sample.split("/") if sample else []), name]
    if any(p in ("", ".", "..") for p in parts) or "/" in name or name.startswith(".") or _TEMPORARY in parts:
        raise ValueError(f"not a place for a file: {sample!r}, {name!r}")
    return "/".join(parts)


class _Writer(DataSourceWriter):
    """Tasks write aside; a commit moves what the tasks that count have written."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows):
        system, root = _open(self.path)
        aside = f"{root}/{_TEMPORARY}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(aside, recursive=True)
        files: list[tuple[str, str]] = []
        done: set[str] = set()
        stream, current = None, None
        for sample, name, value in rows:
            if name is None:
                raise ValueError("a line without a file's name")
            if (sample, name) != current:
                if stream:
                    stream.close()
                place = _checked(sample or "", name)
                if place in done:
                    raise ValueError(f"lines of {place} are not together")
                done.add(place)
                files.append((f"{aside}/{len(files)}", place))
                stream, current = system.open_output_stream(files[-1][0], compression=None), (sample, name)
            value = value or ""
            if "\n" in value or "\r" in value:
                raise ValueError("a line holds the end of a line")
            stream.write(value.encode() + b"\n")
        if stream:
            stream.close()
        return _Written(files)

    def commit(self, messages):
        system, root = _open(self.path)
        moves = [move for m in messages if m is not None for move in m.files]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("lines of a file were in several tasks")
        there = [info.path for info in system.get_file_info([f"{root}/{to}" for _, to in moves]) if info.type != arrow_fs.FileType.NotFound]
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{there[0]} is there already")
        for path in there:
            system.delete_file(path)
        for folder in sorted({f"{root}/{to}".rpartition("/")[0] for _, to in moves}):
            system.create_dir(folder, recursive=True)
        for aside, to in moves:
            system.move(aside, f"{root}/{to}")
        self._tidy(system, root)

    def abort(self, messages):
        self._tidy(*_open(self.path))

    def _tidy(self, system, root):
        mine, all_jobs = f"{root}/{_TEMPORARY}/{self.job}", f"{root}/{_TEMPORARY}"
        if system.get_file_info(mine).type == arrow_fs.FileType.Directory:
            system.delete_dir(mine)
        if system.get_file_info(all_jobs).type == arrow_fs.FileType.Directory and not system.get_file_info(arrow_fs.FileSelector(all_jobs)):
            system.delete_dir(all_jobs)


class SampleLines(DataSource):
    """Lines of the files in a folder of samples; ``what`` asks for their numbers or the files."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMAS[self.options.get("what", "lines")]

    def reader(self, schema):
        return (_FilteredReader if self.options.get("pushdown") == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def _source(spark: SparkSession, path: str, what: str, names: str, block_bytes: int) -> DataFrame:
    spark.dataSource.register(SampleLines)
    reader = spark.read.format(FORMAT).option("path", path).option("what", what)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")  # Spark takes it as an error elsewhere
    return reader.option("pushdown", pushdown).option("names", names).option("blockBytes", str(block_bytes)).load()


def files(spark: SparkSession, path: str, names: str = ".*") -> DataFrame:
    """(sample, name, bytes) of the files under ``path`` whose whole names match ``names``."""
    return _source(spark, path, "files", names, BLOCK)


def read(spark: SparkSession, path: str, names: str = ".*", block_bytes: int = BLOCK) -> DataFrame:
    """(sample, name, file, line_no, value): the lines of the files under ``path`` whose whole
    names match ``names``; ``file`` is both as one path. Files must not change meanwhile.

    A file is read by as many tasks as it has blocks. Lines are numbered in their block; the
    blocks of files that have several are counted first, and their sums, at most twice
    ``MOST_BLOCKS`` rows, are broadcast. Filters on ``sample`` and ``name`` choose files before
    they are opened where spark.sql.python.filterPushdown.enabled is set. A single line is never
    cut. An empty file has no lines; bytes that are no UTF-8 become U+FFFD.
    """
    lines = _source(spark, path, "lines", names, block_bytes)
    counts = _source(spark, path, "counts", names, block_bytes)
    above = Window.partitionBy("sample", "name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("sample", "name", "block", F.coalesce(F.sum("lines").over(above), F.lit(0)).alias("first"))
    numbered = lines.join(F.broadcast(first), ["sample", "name", "block"], "left")
    file = F.when(F.col("sample") == "", F.col("name")).otherwise(F.concat_ws("/", "sample", "name"))
    return numbered.select("sample", "name", file.alias("file"), (F.col("line") + F.coalesce("first", F.lit(0))).alias("line_no"), "value")


def write(lines: DataFrame, path: str, replace: bool = False) -> None:
    """Writes (sample, name, line_no, value) as one file a name in one folder a sample, its lines
    by ``line_no``; a null value is an empty line, a null or empty sample the folder itself.

    A file is one task's, streamed. Files appear when all are written; one that is there already
    is an error, or replaced with ``replace``. Other files stay.
    """
    lines.sparkSession.dataSource.register(SampleLines)
    rows = lines.select(F.coalesce("sample", F.lit("")).alias("sample"), "name", "line_no", "value")
    ordered = rows.repartition("sample", "name").sortWithinPartitions("sample", "name", "line_no").select("sample", "name", "value")
    ordered.write.format(FORMAT).option("path", path).mode("overwrite" if replace else "append").save()


def prediction_names(only: tuple[str, ...] = ()) -> str:
    """The names that ``formats.prediction_files`` keeps, as a pattern for ``read``."""
    begins = f"(?={'|'.join(map(re.escape, only))})" if only else ""
    return begins + r"(?:_reference|(?!_|@|reads|sequences)(?!.*\.png$).*)"
