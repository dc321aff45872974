"""Agreement of several runs, and merging a re-ordered head into a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossline.functions import text as T
from mossline.functions.vectors import dot


def vote(runs: DataFrame, n_runs, *, key: str, top: int = 20) -> DataFrame:
    """instance_id, key, score, appearances, label, rank (from 1): mean score of a key times the share of runs that have it.

    runs: instance_id, run, rank (from 0), key, score; n_runs: a number or column. The first `top` of each run count; a
    key that a run repeats adds to the mean and counts once as an appearance.
    """
    n = F.lit(n_runs) if isinstance(n_runs, int) else n_runs
    per = runs.filter(F.col("rank") < top).withColumn("_n", n).groupBy("instance_id", key).agg(F.avg("score").alias("_mean"), F.count_distinct("run").alias("appearances"), F.max("_n").alias("_n"))
    scored = per.withColumn("score", F.round(F.col("_mean") * F.col("appearances") / F.col("_n"), 6)).withColumn("label", T.confidence_label(F.col("_n"), F.col("appearances")))
    order = Window.partitionBy("instance_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).select("instance_id", key, "score", "appearances", "label", "rank")


def merged_head(ranking: DataFrame, listwise: DataFrame, *, key: str, head: int = 10) -> DataFrame:
    """instance_id, key, score, rank (from 0): the head in the order of `listwise`, then the rest of it, then the tail.

    ranking: instance_id, key, score, rank (from 0); listwise: instance_id, key, position, confidence. Matched keys take
    the confidence as their score; unknown keys are dropped, repeated ones count once at their first position.
    """
    first = listwise.groupBy("instance_id", key).agg(F.min_by("confidence", "position").alias("confidence"), F.min("position").alias("position"))
    joined = ranking.join(first, ["instance_id", key], "left").withColumn("_head", F.col("rank") < head)
    matched = F.col("_head") & F.col("position").isNotNull()
    order = Window.partitionBy("instance_id").orderBy(F.when(matched, 0).when(F.col("_head"), 1).otherwise(2), F.when(matched, F.col("position")).otherwise(F.col("rank")), key)
    return joined.withColumn("new_rank", F.row_number().over(order) - 1).select("instance_id", key, F.when(matched, F.col("confidence")).otherwise(F.col("score")).alias("score"), F.col("new_rank").alias("rank"))


def reranked(candidates: DataFrame, *, key: str, cut_to: int = 20) -> DataFrame:
    """instance_id, key, score, rank (from 0): candidates by the dot product of their vector with their instance's query.

    candidates: instance_id, key, vector, query (arrays of one length), rank (from 0). Without a vector or query a
    candidate scores 0; ties keep the order of `rank`.
    """
    score = F.round(F.coalesce(dot(F.col("vector"), F.col("query")), F.lit(0.0)), 6)
    order = Window.partitionBy("instance_id").orderBy(F.desc("score"), "old", key)
    scored = candidates.select("instance_id", key, score.alias("score"), F.col("rank").alias("old"))
    return scored.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < cut_to).select("instance_id", key, "score", "rank")


def augmented_query(report: Column, chains: Column, limit: int = 2_000) -> Column:
    """A report with the chains found so far below it, which are cut to `limit` characters."""
    text = F.substring(F.array_join(F.filter(chains, lambda c: c != ""), " "), 1, limit)
    return F.when(text != "", F.concat(report, F.lit("\n"), text)).otherwise(report)


def extended_pool(candidates: DataFrame, files: DataFrame, functions: DataFrame, *, top_files: int = 3, per_file: int = 3) -> DataFrame:
    """instance_id, node_id: candidates, and of each instance's first files the best functions that aren't among them.

    files: instance_id, repo, file_path, rank (from 0); functions: repo, file_path, node_id, order_key (small is better).
    Known candidates are taken out before the functions of a file are counted.
    """
    near = files.filter(F.col("rank") < top_files).join(functions, ["repo", "file_path"]).join(candidates.select("instance_id", "node_id"), ["instance_id", "node_id"], "left_anti")
    order = Window.partitionBy("instance_id", "file_path").orderBy("order_key", "node_id")
    extra = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_file).select("instance_id", "node_id")
    return candidates.select("instance_id", "node_id").union(extra).distinct()


def suspect_lines(candidates: DataFrame, statements: DataFrame) -> DataFrame:
    """instance_id, node_id, start_line, end_line: the span of the statements drilled into, else that of the function."""
    drilled = statements.groupBy("instance_id", "node_id").agg(F.min("line").alias("_a"), F.max("line").alias("_b"))
    return candidates.join(drilled, ["instance_id", "node_id"], "left").select("instance_id", "node_id", F.coalesce("_a", "start_line").alias("start_line"), F.coalesce("_b", "end_line").alias("end_line"))
