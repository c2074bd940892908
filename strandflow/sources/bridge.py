"""DNA derived from the star-schema tables, the same in Spark and in plain SQL.

Every 5,000 orders make two samples, so samples and their distinct reads grow with
``lineitem``. A sample has a reference and three mutants, whose lengths, bases and
differences follow from its number by integer arithmetic. Each row of ``lineitem`` is one
read of twelve bases; its sample, haplotype and place come from the keys. Reads start at
every place of one sample, every second of the next and every third of the one after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READ, K = 12, 7
HAPLOTYPES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_id() -> Column:
    """The sample of a row of ``lineitem``."""
    return (F.floor(F.col("l_orderkey") / 5000) * 2 + F.col("l_linenumber") % 2).cast("bigint")


def length(sample: Column) -> Column:
    return 60 + 6 * (sample % 4)


def hap_id() -> Column:
    digit = F.col("l_suppkey") % 10
    return F.when(digit < 4, 0).when(digit < 7, 1).when(digit < 9, 2).otherwise(3).cast("bigint")


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, hap_id, seq) of each sample that has reads; haplotype 0 is the reference."""
    samples = table(spark, sf_dir, "lineitem").select(sample_id().alias("sample_id")).distinct()
    both = samples.select("sample_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HAPLOTYPES - 1).cast("bigint"))).alias("hap_id"))
    s, h = F.col("sample_id"), F.col("hap_id")

    def base(p: Column) -> Column:
        plain = (p * p * 31 + p * (17 + s % 7) + 5 + s * 13) % 101
        changed = (h > 0) & ((p * 7 + h * 13 + s * 5) % 17 == 0)
        return F.substring(F.lit("ACGT"), (F.when(changed, plain + 1 + h % 3).otherwise(plain) % 4 + 1).cast("int"), F.lit(1))

    places = F.sequence(F.lit(0).cast("bigint"), length(s) - 1)
    # never null, so that no join has it spelled for each row of the table to see whether it is
    return both.select("sample_id", "hap_id", F.coalesce(F.array_join(F.transform(places, base), ""), F.lit("")).alias("seq"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, seq): the reference of each sample that has reads."""
    return haplotypes(spark, sf_dir).where("hap_id = 0").select("sample_id", "seq")


def reads(spark: SparkSession, sf_dir: str, errors: bool = False, only: int | None = None) -> DataFrame:
    """(sample_id, start, read, n): distinct placed reads with how often each occurs.

    With ``errors``, every 97th order's reads end in the complement of their last base,
    which makes dead ends in the graph. ``only``: those of one haplotype, as of a sample
    of one clone.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    wrong = (F.col("l_orderkey") % 97 == 0) if errors else F.lit(False)
    placed = lines.select(sample_id().alias("sample_id"), (F.col("l_orderkey") * 5 + F.col("l_partkey")).alias("x"), hap_id().alias("hap_id"), wrong.alias("wrong"))
    placed = placed if only is None else placed.where(F.col("hap_id") == only)
    x = F.col("x") % (length(F.col("sample_id")) - READ + 1)
    start = (x - x % (1 + F.col("sample_id") % 3)).cast("int").alias("start")
    counts = placed.groupBy("sample_id", start, "hap_id", "wrong").agg(F.count("*").alias("n"))
    read = F.substring("seq", F.col("start") + 1, F.lit(READ))
    turned = F.concat(F.left(read, F.lit(READ - 1)), F.translate(F.right(read, F.lit(1)), "ACGT", "TGCA"))
    joined = counts.join(haplotypes(spark, sf_dir), ["sample_id", "hap_id"])
    out = joined.select("sample_id", "start", F.when(F.col("wrong"), turned).otherwise(read).alias("read"), "n")
    return out.groupBy("sample_id", "start", "read").agg(F.sum("n").alias("n"))


def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, path_id, seq, weight): the share of each haplotype in a sample's reads."""
    lines = table(spark, sf_dir, "lineitem").select(sample_id().alias("sample_id"), hap_id().alias("hap_id"))
    counts = lines.groupBy("sample_id", "hap_id").agg(F.count("*").alias("n"))
    totals = counts.groupBy("sample_id").agg(F.sum("n").alias("total"))
    joined = counts.join(totals, "sample_id").join(haplotypes(spark, sf_dir), ["sample_id", "hap_id"])
    return joined.select("sample_id", F.col("hap_id").alias("path_id"), "seq", (F.col("n") / F.col("total")).alias("weight"))


#: The same in SQL, to put in front of a query.
SQL = """
WITH RECURSIVE drawn AS (SELECT CAST(l_orderkey // 5000 * 2 + l_linenumber % 2 AS BIGINT) AS sample_id, l_orderkey * 5 + l_partkey AS x,
  CAST(CASE WHEN l_suppkey % 10 < 4 THEN 0 WHEN l_suppkey % 10 < 7 THEN 1 WHEN l_suppkey % 10 < 9 THEN 2 ELSE 3 END AS BIGINT) AS hap_id,
  l_orderkey % 97 = 0 AS wrong FROM lineitem),
bases AS (SELECT s AS sample_id, h AS hap_id, p, (p * p * 31 + p * (17 + s % 7) + 5 + s * 13) % 101
    + CASE WHEN h > 0 AND (p * 7 + h * 13 + s * 5) % 17 = 0 THEN 1 + h % 3 ELSE 0 END AS b
  FROM (SELECT DISTINCT sample_id AS s FROM drawn), range(0, 4) hs(h), range(0, 78) ps(p) WHERE p < 60 + 6 * (s % 4)),
hap AS (SELECT sample_id, hap_id, string_agg(substr('ACGT', CAST(b % 4 + 1 AS INT), 1), '' ORDER BY p) AS seq FROM bases GROUP BY ALL),
ref AS (SELECT sample_id, seq FROM hap WHERE hap_id = 0),
placed AS (SELECT sample_id, hap_id, wrong, CAST(x - x % (1 + sample_id % 3) AS INT) AS start FROM (SELECT * REPLACE (x % (49 + 6 * (sample_id % 4)) AS x) FROM drawn)),
exact AS (SELECT sample_id, start, substr(seq, start + 1, 12) AS read FROM placed JOIN hap USING (sample_id, hap_id)),
noisy AS (SELECT sample_id, start, CASE WHEN wrong THEN substr(seq, start + 1, 11) || translate(substr(seq, start + 12, 1), 'ACGT', 'TGCA')
  ELSE substr(seq, start + 1, 12) END AS read FROM placed JOIN hap USING (sample_id, hap_id)),
reads AS (SELECT sample_id, start, read, count(*) AS n FROM exact GROUP BY ALL),
noisy_reads AS (SELECT sample_id, start, read, count(*) AS n FROM noisy GROUP BY ALL),
paths AS (SELECT sample_id, hap_id AS path_id, seq, count(*) / CAST(sum(count(*)) OVER (PARTITION BY sample_id) AS DOUBLE) AS weight
  FROM placed JOIN hap USING (sample_id, hap_id) GROUP BY sample_id, hap_id, seq),
edges AS (SELECT sample_id, start + i AS position, substr(read, i + 1, 7) AS src, substr(read, i + 2, 7) AS dst, CAST(sum(n) AS BIGINT) AS weight
  FROM reads, range(0, 5) r(i) GROUP BY ALL),
noisy_edges AS (SELECT sample_id, start + i AS position, substr(read, i + 1, 7) AS src, substr(read, i + 2, 7) AS dst, CAST(sum(n) AS BIGINT) AS weight
  FROM noisy_reads, range(0, 5) r(i) GROUP BY ALL),
weighted AS (SELECT sample_id, position, src, dst, weight / CAST(sum(weight) OVER (PARTITION BY sample_id, position) AS DOUBLE) AS weight FROM edges),
path_edges AS (SELECT sample_id, path_id, weight, i AS position, substr(seq, CAST(i + 1 AS INT), 7) AS src, substr(seq, CAST(i + 2 AS INT), 7) AS dst
  FROM paths, range(0, 71) r(i) WHERE i < length(seq) - 7),
coverage AS (SELECT sample_id, position, src, dst, sum(weight) AS coverage FROM path_edges GROUP BY ALL)
"""
