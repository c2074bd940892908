"""Folders of samples: listing, choice of names, blocks, and the writer's commit."""

import io

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandflow.sources import folder, formats


@pytest.fixture
def samples(tmp_path):
    for place, text in {
        "0": b"",
        "s1/_reads": b"ACGT\r\nTT\n\nG",
        "s1/_reference": b">r\nACG\nTTT\n",
        "s1/ph_a": b"ACG 0.25\nTTT 0.75\n",
        "s1/x.png": b"\x89\xff\n",
        "s1/.ph_a.crc": b"x",
        "s2/reads1": b"",
        "s2/deep/_reads": b"one\rtwo\r\n",
        "top": b"\xff\n",
        "_temporary/left/0": b"x\n",
    }.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(text)
    return str(tmp_path)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lists_hidden_names(spark, samples):
    got = rows(folder.files(spark, samples), "sample", "name", "bytes")
    assert got == [("", "0", 0), ("", "top", 2), ("s1", "_reads", 11), ("s1", "_reference", 11), ("s1", "ph_a", 18), ("s1", "x.png", 3), ("s2", "reads1", 0), ("s2/deep", "_reads", 9)]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 7, 1 << 20])
def test_lines_and_numbers_at_any_block(spark, samples, block):
    got = rows(folder.read(spark, f"file:{samples}", block_bytes=block), "file", "line_no", "value")
    assert got == [
        ("s1/_reads", 0, "ACGT"), ("s1/_reads", 1, "TT"), ("s1/_reads", 2, ""), ("s1/_reads", 3, "G"),
        ("s1/_reference", 0, ">r"), ("s1/_reference", 1, "ACG"), ("s1/_reference", 2, "TTT"),
        ("s1/ph_a", 0, "ACG 0.25"), ("s1/ph_a", 1, "TTT 0.75"), ("s1/x.png", 0, "��"),
        ("s2/deep/_reads", 0, "one"), ("s2/deep/_reads", 1, "two"), ("top", 0, "�"),
    ]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    lines = [f"{k} " + "ACGT" * (k % 40) for k in range(5000)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "_reads").write_text("\n".join(lines))
    got = folder.read(spark, str(tmp_path), block_bytes=10_000).withColumn("task", F.spark_partition_id())
    assert got.select("task").distinct().count() > 30
    assert [r["value"] for r in got.orderBy("line_no").collect()] == lines
    assert rows(got, "line_no") == [(k,) for k in range(5000)]


def test_lines_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(folder, "_CHUNK", 4)
    text = b"a" * 13 + b"\n" + b"b" * 3 + b"\r\n\n" + b"c" * 9
    for step in range(1, len(text) + 1):
        parts = [list(folder.lines_between(io.BytesIO(text), s, min(s + step, len(text)))) for s in range(0, len(text), step)]
        assert sum(parts, []) == [b"a" * 13, b"bbb", b"", b"c" * 9]


def test_names_are_chosen_before_files_are_opened(spark, samples):
    names = ["_reference", "_reads", "reads1", "sequences", "@x", "ph.fas", "snv", "ph.png", "_", "photo.png.txt"]
    table = spark.createDataFrame([(n,) for n in names], "file string")
    import re

    for only in ((), ("ph", "_"), ("snv",)):
        kept = {n for n in names if re.fullmatch(folder.prediction_names(only), n)}
        assert kept == {r["file"] for r in formats.prediction_files(table, only).collect()}
    assert rows(folder.read(spark, samples, folder.prediction_names(("ph", "_"))), "file") == [("s1/_reference",)] * 3 + [("s1/ph_a",)] * 2
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = folder.read(spark, samples).where((F.col("sample") == "s1") & F.col("name").isin("_reads", "ph_a") & F.col("name").startswith("p"))
        assert rows(got, "file") == [("s1/ph_a",)] * 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    reader = folder._FilteredReader({"path": samples})
    left = list(reader.pushFilters([folder.EqualTo(("sample",), "s1"), folder.In(("name",), ("ph_a", "x")), folder.StringStartsWith(("name",), "p"), folder.EqualTo(("value",), "v")]))
    assert [f.attribute for f in left] == [("value",)]
    assert [(r.sample, r.name) for t in reader.partitions() for r in t.ranges] == [("s1", "ph_a")]


LINES = [("s1", "_reads", 2, "b"), ("s1", "_reads", 1, "a"), ("s1", "_reads", 3, None), ("s2/x", "ph", 5, "c d"), (None, "top", 0, "e")]
SCHEMA = "sample string, name string, line_no bigint, value string"


def test_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    folder.write(spark.createDataFrame(LINES, SCHEMA), path)
    assert rows(folder.read(spark, path), "file", "line_no", "value") == [("s1/_reads", 0, "a"), ("s1/_reads", 1, "b"), ("s1/_reads", 2, ""), ("s2/x/ph", 0, "c d"), ("top", 0, "e")]
    assert (tmp_path / "out/s1/_reads").read_bytes() == b"a\nb\n\n" and not (tmp_path / "out/_temporary").exists()
    # one that is there is an error, and nothing else appears
    more = spark.createDataFrame([("s1", "_reads", 0, "z"), ("s3", "new", 0, "z")], SCHEMA)
    with pytest.raises(PySparkException, match="is there already"):
        folder.write(more, path)
    assert not (tmp_path / "out/s3").exists() and (tmp_path / "out/s1/_reads").read_bytes() == b"a\nb\n\n"
    folder.write(more, path, replace=True)
    assert (tmp_path / "out/s1/_reads").read_bytes() == b"z\n" and (tmp_path / "out/top").exists()
    folder.write(spark.createDataFrame([], SCHEMA), path)
    assert folder.files(spark, path).count() == 4


@pytest.mark.parametrize("row", [("s", None, 0, "a"), ("s", "../up", 0, "a"), ("../s", "x", 0, "a"), ("s", "x", 0, "a\nb"), ("s", ".x", 0, "a")])
def test_failed_write_leaves_nothing(spark, tmp_path, row):
    with pytest.raises(PySparkException):
        folder.write(spark.createDataFrame([row, ("good", "x", 0, "a")], SCHEMA), str(tmp_path / "out"))
    left = tmp_path / "out"
    assert not left.exists() or not any(p.is_file() for p in left.rglob("*"))
