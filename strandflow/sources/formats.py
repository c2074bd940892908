"""Readers and writers of the text formats around sequence mixtures.

A reader takes lines, (file, line_no, value), and returns rows; ``read_lines`` makes lines
of files. Order comes from ``line_no``, never from partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def _by_line():
    return Window.partitionBy("file").orderBy("line_no")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files under ``path``, a folder or pattern that Spark's readers open.

    Whole files are split, so that lines keep their numbers. Spark skips names that begin
    with ``_`` or ``.``; ``read_hidden_lines`` reads those.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return _numbered(texts)


def read_shared_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder that jobs wrote, with the columns its folders are named by, in any
    order: for files whose lines stand for themselves."""
    return spark.read.text(path)


def read_together(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no 0, value) of a folder by ``write_together``, in any order: for lines that
    stand for themselves."""
    cut = F.instr("value", "\t")
    return spark.read.text(path).select(F.nullif(F.left("value", cut - 1), F.lit("")).alias("file"), F.lit(0).alias("line_no"), F.expr("substr(value, instr(value, '\t') + 1)").alias("value"))


def _numbered(texts: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n$", "")
    lines = F.posexplode(F.split(body, "\n"))
    return texts.select("file", lines.alias("line_no", "value"))


def read_hidden_lines(paths: DataFrame) -> DataFrame:
    """Lines of the files named in ``paths`` (file), on folders that executors share."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name in batch["file"]:
                with open(name.removeprefix("file://"), encoding="utf-8") as f:
                    yield pd.DataFrame({"file": [name.rpartition("/")[2]], "value": [f.read()]})

    return _numbered(paths.select("file").mapInPandas(run, "file string, value string"))


def _ordered(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["value"]), "")


def fasta_as_one(lines: DataFrame) -> DataFrame:
    """(file, seq): all records of a file as one upper-case sequence; headers dropped."""
    body = lines.where((F.col("value") != "") & ~F.startswith("value", F.lit(">")))
    return body.groupBy("file").agg(F.upper(_ordered(F.collect_list(F.struct("line_no", "value")))).alias("seq"))


def fasta_records(lines: DataFrame) -> DataFrame:
    """(file, record, header, seq): each record by itself; wrapped lines joined."""
    head = F.startswith("value", F.lit(">"))
    numbered = lines.withColumn("record", F.sum(head.cast("int")).over(_by_line())).where("record > 0")
    body = F.collect_list(F.when(~head, F.struct("line_no", "value")))
    return numbered.groupBy("file", "record").agg(F.max(F.when(head, F.expr("substr(value, 2)"))).alias("header"), _ordered(body).alias("seq"))


def fastq_reads(lines: DataFrame) -> DataFrame:
    """(file, read): the second of each four lines, trimmed."""
    return lines.where(F.col("line_no") % 4 == 1).select("file", F.trim("value").alias("read"))


def sam_reads(lines: DataFrame) -> DataFrame:
    """(file, name, start, read): position from 0 and sequence; header lines dropped."""
    part = F.split("value", r"\s+")
    at = lambda i: F.get(part, F.lit(i))
    return lines.where(~F.startswith("value", F.lit("@")) & (F.col("value") != "")).select("file", at(0).alias("name"), (at(3).cast("int") - 1).alias("start"), at(9).alias("read"))


def sam_sequences(lines: DataFrame) -> DataFrame:
    """(file, read): the last but one tab-separated field, as older simulators write."""
    return lines.where(~F.startswith("value", F.lit("@")) & (F.col("value") != "")).select("file", F.element_at(F.split("value", "\t"), -2).alias("read"))


def simulated_sequences(lines: DataFrame) -> DataFrame:
    """(file, seq): the last token of each line after the header."""
    return lines.where((F.col("line_no") > 0) & (F.trim("value") != "")).select("file", F.element_at(F.split(F.trim("value"), r"\s+"), -1).alias("seq"))


def tokens(lines: DataFrame) -> DataFrame:
    """(file, line_no, at, token): whatever stands between white space, as it is."""
    return lines.select("file", "line_no", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "token")).where("token <> ''")


def mixtures(lines: DataFrame) -> DataFrame:
    """(file, seq, weight) of ``seq weight`` lines; further tokens are ignored."""
    part = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(part) >= 2).select("file", F.get(part, F.lit(0)).alias("seq"), F.get(part, F.lit(1)).cast("double").alias("weight"))


def colon_mixtures(lines: DataFrame) -> DataFrame:
    """Wrapped FASTA whose header's second token ends in ``:weight`` and one character.

    Equal sequences add up, and the weights of a file are divided by their total.
    """
    from ..operators.summaries import renormalise

    token = F.get(F.split("header", r"\s+"), F.lit(1))
    last = F.element_at(F.split(token, ":"), -1)
    records = fasta_records(lines).select("file", "seq", F.left(last, F.length(last) - 1).cast("double").alias("weight"))
    return renormalise(records, "seq", ["file"])


def underscore_mixtures(lines: DataFrame) -> DataFrame:
    """FASTA with one line per sequence, whose header ends in ``_weight``."""
    rows = lines.withColumn("seq", F.lead("value").over(_by_line())).where(F.startswith("value", F.lit(">")))
    return rows.select("file", "seq", F.element_at(F.split("value", "_"), -1).cast("double").alias("weight"))


def gapped_mixtures(lines: DataFrame, reference: DataFrame) -> DataFrame:
    """Lines that begin with V end in the weight; the next line is a sequence, its ``-``
    filled from ``reference`` (file, seq)."""
    from ..functions.sequence import fill_gaps

    rows = lines.withColumn("_seq", F.lead("value").over(_by_line())).where(F.startswith("value", F.lit("V")))
    joined = rows.join(reference.select("file", F.col("seq").alias("_ref")), "file")
    return joined.select("file", fill_gaps("_seq", "_ref").alias("seq"), F.element_at(F.split("value", r"\s+"), -1).cast("double").alias("weight"))


def likelihood_history(lines: DataFrame) -> DataFrame:
    """(file, line_no, logl): the last number of ``(a, b)`` lines, or the line's number."""
    return lines.select("file", "line_no", F.regexp_extract("value", r"([-+0-9.eE]+)\)?\s*$", 1).cast("double").alias("logl"))


def move_statistics(lines: DataFrame) -> DataFrame:
    """(file, move, value) of ``Move: value`` lines."""
    part = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(part) >= 2).select("file", F.regexp_replace(F.get(part, F.lit(0)), ":$", "").alias("move"), F.element_at(part, -1).cast("double").alias("value"))


def prediction_files(names: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """Which of ``names`` (file) hold predictions: the reference counts as one; other names
    that begin with ``_``, ``@``, ``reads`` or ``sequences`` or end in ``.png`` don't. With
    ``only``, a name must begin with one of its prefixes."""
    name = F.col("file")
    hidden = F.startswith(name, F.lit("_")) & (name != "_reference")
    other = name.rlike(r"^(@|reads|sequences)") | F.endswith(name, F.lit(".png"))
    kept = names.where(~hidden & ~other)
    return kept.where(name.rlike("^(" + "|".join(only) + ")")) if only else kept


def mixture_lines(mixture: DataFrame) -> DataFrame:
    """``seq weight`` lines of each sample and kind of result."""
    return mixture.select("sample_id", "kind", F.concat_ws(" ", "seq", F.col("weight").cast("string")).alias("value"))


def write_mixture(mixture: DataFrame, path: str) -> None:
    """One text folder per sample and kind of result."""
    mixture_lines(mixture).repartition("sample_id", "kind").write.partitionBy("sample_id", "kind").mode("overwrite").text(path)


def alignment_lines(alignments: DataFrame) -> DataFrame:
    """``read start`` lines of each sample."""
    return alignments.select("sample_id", F.concat_ws(" ", "read", F.col("start").cast("string")).alias("value"))


def write_alignments(alignments: DataFrame, path: str) -> None:
    """One text folder per sample, with one file: tasks that each held some of every sample
    would write as many files as both together make."""
    alignment_lines(alignments).repartition("sample_id").write.partitionBy("sample_id").mode("overwrite").text(path)


def fasta_lines(sequences: DataFrame, name: str = "name", seq: str = "seq", width: int = 70) -> DataFrame:
    """(value): a FASTA record per row, wrapped."""
    from ..functions.sequence import wrap

    return sequences.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), wrap(seq, width)).alias("value"))


def history_lines(trace: DataFrame) -> DataFrame:
    """``(accumulated, recomputed)`` lines of a chain's log-likelihoods, in its order."""
    value = F.concat(F.lit("("), F.col("logl_acc").cast("string"), F.lit(", "), F.col("logl").cast("string"), F.lit(")"))
    return trace.select("sample_id", "iter", value.alias("value"))


def statistics_lines(trace: DataFrame) -> DataFrame:
    """``Move: value`` lines of the steps' jump densities, in their order."""
    return trace.select("sample_id", "iter", F.concat("move", F.lit(": "), F.col("jump").cast("string")).alias("value"))


def write_steps(lines: DataFrame, path: str) -> None:
    """One text folder per sample, each sample's lines in one file in the order of ``iter``.

    For tools that want a file a sample; many samples go to ``write_together``."""
    ordered = lines.repartition("sample_id").sortWithinPartitions("sample_id", "iter")
    ordered.select("sample_id", "value").write.partitionBy("sample_id").mode("overwrite").text(path)


def write_together(lines: DataFrame, path: str, *order: str) -> None:
    """Lines (file, value) of many files in as many text files as there are tasks, each line with
    its file's name and a tab before it: what is written, moved and listed follows the bytes
    and not the number of names. With ``order``, the lines of a name stand below each other in
    it, those of a long one in several tasks. A name holds no tab; none is read back as null.
    """
    rows = lines.repartitionByRange("file", *order).sortWithinPartitions("file", *order) if order else lines
    rows.select(F.concat(F.coalesce("file", F.lit("")), F.lit("\t"), F.coalesce("value", F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def merge_sam(lines: DataFrame, replacing: DataFrame) -> DataFrame:
    """(file, line_no, value): header lines as they are, and each other line with its
    sequence taken from the line of ``replacing`` that has the same name in the same file.

    Lines keep their numbers; those that nothing replaces are left out.
    """
    head = F.startswith("value", F.lit("@"))
    part = F.split("value", r"\s+")
    other = replacing.where(~head & (F.col("value") != "")).select("file", F.get(part, F.lit(0)).alias("_name"), F.get(part, F.lit(9)).alias("_seq"))
    rows = lines.where(~head & (F.col("value") != "")).select("file", "line_no", F.get(part, F.lit(0)).alias("_name"), part.alias("_part"))
    joined = rows.join(other, ["file", "_name"])
    value = F.array_join(F.concat(F.slice("_part", 1, 9), F.array("_seq"), F.slice("_part", 11, F.size("_part"))), "\t")
    return lines.where(head).select("file", "line_no", "value").unionByName(joined.select("file", "line_no", value.alias("value")))
