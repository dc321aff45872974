"""A cache of model replies as a partitioned table: look up, find misses, add."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, text string, reasoning string"


def looked_up(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a cached reply, requests without), by `key`; a key cached twice gives its smaller text, a row without text is a miss."""
    known = cache.filter("text is not null").groupBy("key").agg(F.min(F.struct("text", "reasoning")).alias("r")).select("key", "r.*")
    return requests.join(known, "key"), requests.join(known.select("key"), "key", "left_anti")


def add(replies: DataFrame, path: str) -> None:
    """Appends replies, partitioned by the first two digits of their key."""
    replies.select("key", "text", "reasoning").withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", shard string").parquet(path).drop("shard")


def traffic(requests: DataFrame, *, key: str, at: str, group: str) -> DataFrame:
    """group, n_live, n_cached: a key's first request is live, its later ones are answered from the cache."""
    firsts = requests.groupBy(key).agg(F.min(F.struct(at, group)).alias("f")).groupBy(F.col(f"f.{group}").alias(group)).agg(F.count(F.lit(1)).alias("n_live"))
    whole = requests.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return whole.join(firsts, group, "left").select(group, F.coalesce("n_live", F.lit(0)).alias("n_live"), (F.col("_n") - F.coalesce("n_live", F.lit(0))).alias("n_cached"))
