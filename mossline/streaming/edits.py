"""Edit counts of files kept up to date from a stream of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edits_per_window(commits: DataFrame, *, late: str = "30 days", window: str = "7 days") -> DataFrame:
    """repo, file_path, window, n_commits of a stream of commits; redelivered commits count once within the watermark."""
    timed = commits.withColumn("authored_at", F.col("authored_at").cast("timestamp")).filter("sha is not null and authored_at is not null").withWatermark("authored_at", late)
    once = timed.dropDuplicatesWithinWatermark(["sha"])
    files = once.select("repo", "authored_at", F.explode(F.array_distinct("files")).alias("file_path"))
    return files.groupBy("repo", "file_path", F.window("authored_at", window)).agg(F.count(F.lit(1)).alias("n_commits"))


def started(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes finished windows to parquet and ends when what is there has been read."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
