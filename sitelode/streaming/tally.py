"""Domain tallies over a stream of result rows, for captures that arrive all day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelode.functions import text, urls


def read_results(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream of result rows."""
    return spark.readStream.schema(schema).parquet(folder)


def domain_windows(results: DataFrame, *, window: str = "1 day", late: str = "120 days") -> DataFrame:
    """Appearances and visibility of each domain in windows of capture time; deliveries that come again count once.

    A row is counted if it comes no later than ``late`` after the newest capture seen; deliveries lag by up to eleven weeks,
    so the default leaves room. A window is written when it can get no more rows.
    """
    rows = results.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["organic_id"])
    own = rows.withColumn("domain", urls.normalize_domain("domain")).where("domain <> ''")
    by = own.groupBy(F.window("captured_at", window).alias("w"), "domain").agg(F.count("*").alias("appearances"), F.sum(text.visibility("position")).cast("double").alias("score"), F.min(F.when(F.col("position") > 0, F.col("position"))).alias("best_pos"))
    return by.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "domain", "appearances", "score", "best_pos")


def write(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Closed windows as Parquet; restarts go on from the checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
