"""Edge counts of a stream of aligned reads.

The reads of a sequencing run arrive as files; the graph's weights are kept up to date in
windows of event time, with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import windows


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, start, read, ts) from Parquet files that arrive in ``path``."""
    return spark.readStream.schema("sample_id bigint, start int, read string, ts timestamp").parquet(path)


def edge_counts(reads: DataFrame, k: int, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Weights of edges by event-time window; works on streams and on tables alike."""
    rows = reads.withWatermark("ts", late).select("sample_id", "start", "read", "ts", F.explode(windows("read", k + 1)).alias("i"))
    at = lambda d: F.substring("read", F.col("i") + d, F.lit(k))
    keys = ["sample_id", F.window("ts", window).alias("window"), (F.col("start") + F.col("i")).alias("position"), at(1).alias("src"), at(2).alias("dst")]
    return rows.groupBy(*keys).agg(F.count("*").alias("weight"))


def write_counts(counts: DataFrame, path: str, checkpoint: str):
    """Append each window when the watermark closes it; all input there is, then stop."""
    flat = counts.select("sample_id", F.col("window.start").alias("window_start"), "position", "src", "dst", "weight")
    return flat.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
