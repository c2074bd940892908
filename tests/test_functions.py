import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandflow.functions import likelihood as lk
from strandflow.functions import sequence as sq
from strandflow.operators import intervals, simulate
from strandflow.sources import formats


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).first()["x"]


def test_sequences(spark):
    assert one(spark, sq.complement("s"), s="ACGTN") == "TGCAN"
    assert one(spark, sq.orientations("s"), s="AAC") == ["AAC", "TTG", "CAA", "GTT"]
    assert one(spark, sq.hamming("a", "b"), a="ACG", b="ATGA") == 1
    assert one(spark, sq.hamming("a", "b"), a="", b="") == 0
    assert one(spark, sq.windows("s", 4), s="ACG") == []
    assert one(spark, sq.windows("s", 2), s="ACG") == [0, 1]
    assert one(spark, sq.wrap("s", 3), s="ACGTACG") == "ACG\nTAC\nG"
    assert one(spark, sq.fill_gaps("s", "r"), s="A--T", r="CGTA") == "AGTT"
    assert one(spark, sq.splice("s", "p", "i"), s="AAAAAA", p="CC", i=2) == "AACCAA"
    assert [one(spark, sq.base_index("b"), b=b) for b in "ACGT"] == [0, 1, 2, 3]
    for bad in ("N", "", "AC"):
        with pytest.raises(Exception, match="Unknown nucleotide"):
            one(spark, sq.base_index("b"), b=bad)
    with pytest.raises(Exception, match="shorter"):
        one(spark, sq.hamming("a", "b"), a="ACG", b="AC")


def test_likelihood(spark):
    for n in (0, 1, 4, 30):
        assert one(spark, lk.log_poisson(F.col("n"), 3.0), n=n) == pytest.approx(n * math.log(3) - 3 - math.lgamma(n + 1))
    assert one(spark, lk.soft(F.col("x")), x=-4.0) == -1
    for n in (1, 2, 3, 9):
        assert sum(one(spark, c, n=n) for c in lk.move_mix(F.col("n"), 3.0)) == pytest.approx(1)


@settings(max_examples=25, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=6), st.text("ACGT", min_size=1, max_size=12))
def test_infix_distance(query, text):
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    best = min(edit(query, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    distance, start = simulate.infix_distance(query, text)
    assert distance == best
    assert any(edit(query, text[start:j]) == best for j in range(start, len(text) + 1))
    # of several, the one that ends first, and of those the shortest
    end = min(j for j in range(len(text) + 1) for i in range(j + 1) if edit(query, text[i:j]) == best)
    assert start == max(i for i in range(end + 1) if edit(query, text[i:end]) == best)


def test_range_join(spark):
    rows = [(1, i, s, s + n) for i, (s, n) in enumerate([(0, 3), (3, 20), (5, 0), (40, 2), (41, 9)])]
    handles = spark.createDataFrame(rows, "path_id bigint, handle_id bigint, start bigint, stop bigint")
    got = {(r["handle"], r["other"]) for r in intervals.overlaps(handles, 4).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and a[2] <= b[3] and b[2] <= a[3]}


def test_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nac\n\nGT\n>b\nTT\n")
    (tmp_path / "_hidden").write_text("ACG 0.25 more\nTTT 0.75\n")
    lines = formats.read_lines(spark, str(tmp_path))
    assert formats.fasta_as_one(lines).collect()[0]["seq"] == "ACGTTT"
    records = {r["header"]: r["seq"] for r in formats.fasta_records(lines).collect()}
    assert records == {"a": "acGT", "b": "TT"}
    hidden = formats.read_hidden_lines(spark.createDataFrame([(f"{tmp_path}/_hidden",)], "file string"))
    assert {(r["seq"], r["weight"]) for r in formats.mixtures(hidden).collect()} == {("ACG", 0.25), ("TTT", 0.75)}
    names = spark.createDataFrame([(n,) for n in ("_reference", "_reads", "ph.fas", "reads1", "@x", "p.png", "snv")], "file string")
    assert {r["file"] for r in formats.prediction_files(names).collect()} == {"_reference", "ph.fas", "snv"}
    assert {r["file"] for r in formats.prediction_files(names, ("ph", "_")).collect()} == {"_reference", "ph.fas"}


def test_writers(spark, tmp_path):
    mix = spark.createDataFrame([(1, "best", "ACG", 0.5)], "sample_id bigint, kind string, seq string, weight double")
    formats.write_mixture(mix, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == "ACG 0.5"
    rows = spark.createDataFrame([("n", "A" * 71)], "name string, seq string")
    assert formats.fasta_lines(rows).first()["value"] == ">n\n" + "A" * 70 + "\nA"


def test_merged_lines_and_steps(spark, tmp_path):
    lines = spark.createDataFrame([("f", 0, "@HD x"), ("f", 1, "r1 0 c 5 9 3M * 0 0 AAA II"), ("f", 2, "r2 0 c 7 9 3M * 0 0 CCC II"), ("f", 3, "r3 0 c 7 9 3M * 0 0 C II")], "file string, line_no int, value string")
    other = spark.createDataFrame([("f", 0, "r2 0 c 7 9 3M * 0 0 TTT II"), ("f", 1, "r1 0 c 5 9 3M * 0 0 GGG II"), ("g", 1, "r3 0 c 5 9 3M * 0 0 GGG II")], "file string, line_no int, value string")
    got = [r["value"] for r in formats.merge_sam(lines, other).orderBy("line_no").collect()]
    assert got == ["@HD x", "r1\t0\tc\t5\t9\t3M\t*\t0\t0\tGGG\tII", "r2\t0\tc\t7\t9\t3M\t*\t0\t0\tTTT\tII"]
    trace = spark.createDataFrame([(1, i, "New", -1.0 * i, -1.5 * i, 0.25) for i in range(20)], "sample_id bigint, iter bigint, move string, logl_acc double, logl double, jump double").repartition(4)
    formats.write_steps(formats.history_lines(trace), str(tmp_path / "h"))
    text = [f.read_text() for f in (tmp_path / "h" / "sample_id=1").glob("*.txt")]
    assert "".join(text).splitlines() == [f"({-1.0 * i}, {-1.5 * i})" for i in range(20)] or text[0].startswith("(-0.0, -0.0)")
    assert {r["value"] for r in formats.statistics_lines(trace).collect()} == {"New: 0.25"}


def test_lines_of_many_samples_share_files(spark, tmp_path):
    trace = spark.createDataFrame([(i % 300, i, "New", -1.0 * i, 0.5 * i, 0.25) for i in range(1200)], "sample_id bigint, iter bigint, move string, logl_acc double, logl double, jump double").repartition(5)
    lines = formats.history_lines(trace).withColumn("file", F.nullif(F.col("sample_id"), F.lit(7)).cast("string"))
    for order in ((), ("iter",)):
        path = str(tmp_path / f"t{len(order)}")
        formats.write_together(lines, path, *order)
        assert len(list((tmp_path / f"t{len(order)}").rglob("*.txt"))) <= 5
        got = formats.read_together(spark, path)
        assert sorted((r["file"] or "", r["value"]) for r in got.collect()) == sorted(("" if i % 300 == 7 else str(i % 300), f"({-1.0 * i}, {0.5 * i})") for i in range(1200))
    text = [f.read_text().splitlines() for f in sorted((tmp_path / "t1").rglob("*.txt"))]
    at = [float(v.split("\t")[1][1:].split(",")[0]) for part in text for v in part if v.startswith("12\t")]
    assert at == [-12.0, -312.0, -612.0, -912.0]


@pytest.mark.parametrize("name", ["history_written", "statistics_written", "alignments_written", "mixture_written"])
def test_written_queries_make_few_files(spark, tmp_path, monkeypatch, name):
    from strandflow.jobs import queries

    tables = tmp_path / "tables"
    spark.range(400).selectExpr("id AS event_id", "id % 100 AS user_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value").write.parquet(str(tables / "events.parquet"))
    spark.range(3000).selectExpr("id * 250 AS l_orderkey", "id AS l_partkey", "id % 10 AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber").write.parquet(str(tables / "lineitem.parquet"))
    monkeypatch.setattr(queries.lineage, "new_place", lambda spark, name: str(tmp_path / "out"))
    assert queries.QUERIES[name](spark, str(tables)).count() > 0
    assert len(list((tmp_path / "out").rglob("*.txt"))) <= 16


def test_simulation_does_not_depend_on_partitions(spark):
    references = simulate.reference(spark, 50, 2)
    assert all(len(r["seq"]) == 50 and set(r["seq"]) <= set("ACGT") for r in references.collect())
    haps = simulate.mutants(references, 3, 1.5).withColumn("weight", F.lit(1.0))
    assert haps.count() == 8
    make = lambda df: sorted(map(tuple, simulate.simulate_reads(df, 40, 8, 10, 0.0).collect()))
    reads = make(haps)
    assert reads == make(haps.repartition(7))
    seqs = {}
    for h in haps.collect():
        seqs.setdefault(h["sample_id"], []).append(h["seq"])
    assert len(reads) == 80 and all(any(s[i : i + len(r)] == r for s in seqs[k]) for k, _, i, r in reads)


def test_stream_counts_like_a_table(spark, tmp_path):
    from datetime import datetime, timedelta

    from strandflow.streaming import edges as stream

    start = datetime(2024, 1, 1)
    rows = [(1, i % 3, "ACGTAC"[i % 2 :], start + timedelta(minutes=13 * i)) for i in range(40)]
    schema = "sample_id bigint, start int, read string, ts timestamp"
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = stream.edge_counts(stream.read_stream(spark, str(tmp_path / "in")), 3)
    stream.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["window_start"], r["position"], r["src"], r["dst"]): r["weight"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table = stream.edge_counts(spark.createDataFrame(rows, schema), 3).collect()
    want = {(r["window"]["start"], r["position"], r["src"], r["dst"]): r["weight"] for r in table}
    closed = {k: v for k, v in want.items() if k[0] + timedelta(hours=3) <= rows[-1][3]}
    assert got and all(want[k] == v for k, v in got.items()) and closed.keys() <= got.keys()


def test_infix_matches_of_any_length(spark):
    """Bit-parallel against the whole table, also for patterns of several words."""
    import random

    from strandflow.functions.infix import infix_match
    from strandflow.operators.simulate import infix_matches

    rng = random.Random(1)
    rows = [("ACGT", ""), ("", "ACGT"), ("", ""), ("NNA", "ACGNNAX")]
    for _ in range(120):
        size, text = rng.choice([1, 3, 12, 59, 60, 61, 70, 125, 190]), "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 20, 150])))
        query = "".join(rng.choice("ACGT") for _ in range(size))
        if rng.random() < 0.6 and len(text) > size:
            at = rng.randrange(len(text) - size + 1)
            query = list(text[at : at + size])
            for _ in range(rng.randint(0, 4)):
                query[rng.randrange(size)] = rng.choice(["A", "C", "", "GG"])
            query = "".join(query)
        rows.append((query, text))
    table = spark.createDataFrame([*rows, (None, "A"), ("A", None)], "query string, text string").coalesce(1)
    got = [r["m"] and tuple(r["m"]) for r in table.select(infix_match("query", "text").alias("m")).collect()]
    assert got == [*zip(*(x.tolist() for x in infix_matches(*map(list, zip(*rows, strict=True)))), strict=True), None, None]


def test_a_long_chain_is_many_groups(spark):
    from pyspark.sql import functions as F

    from strandflow.operators import summaries

    steps = spark.range(200_000).select(F.when(F.col("id") % 4 == 0, None).otherwise(F.lit(1)).alias("chain"), (F.col("id") * 7919 % 200_000).alias("iter"), (F.col("id") % 3 == 0).alias("accept"), (F.col("id") % 11 - 5).cast("double").alias("delta"))
    steps = steps.repartition(8)
    made = summaries.trace(steps, ["chain"], "iter", F.lit(10.0))
    got = {(r["chain"], r["iter"]): r["logl"] for r in made.collect()}
    want, running = {}, {None: 10.0, 1: 10.0}
    for r in sorted(steps.collect(), key=lambda r: r["iter"]):
        running[r["chain"]] += r["delta"] if r["accept"] else 0.0
        want[r["chain"], r["iter"]] = running[r["chain"]]
    assert got == want and made.columns == ["chain", "iter", "accept", "delta", "logl"]
    groups = steps.groupBy("chain", F.floor(F.col("iter") / summaries.BLOCK)).count()
    assert groups.agg(F.max("count")).first()[0] <= summaries.BLOCK
