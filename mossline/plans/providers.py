"""What a model would do, behind small interfaces with defaults that need none, and calls that go through the cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossline.functions import blocks
from mossline.functions import text as T
from mossline.functions.vectors import hashed_vectors
from mossline.operators.retrieval import TEXT_ROWS
from mossline.runtime import cut
from mossline.sources import replies

#: Given a prompt: (text, reasoning) of the reply.
Model = Callable[[str], tuple[str, str | None]]


def encoded(texts: DataFrame, *, key: str | list[str], text: str = "text", dimensions: int = 64) -> DataFrame:
    """The key columns and vector: unit vectors of texts by hashed tokens."""
    keys = [key] if isinstance(key, str) else key
    return hashed_vectors(texts.select(*keys, T.code_tokens(F.col(text)).alias("_tokens")), tokens="_tokens", dimensions=dimensions)


def summaries(functions: DataFrame) -> DataFrame:
    """node_id, summary: what a function does: its docstring's first line, else its name in words."""
    words = F.array_join(F.array_distinct(F.slice(T.code_tokens(F.col("name")), 2, 20)), " ")
    return functions.select("node_id", F.when(F.coalesce("docstring", F.lit("")) != "", F.substring_index("docstring", "\n", 1)).otherwise(F.when(words != "", words).otherwise(F.col("name"))).alias("summary"))


def labels(members: DataFrame, n: int = 8) -> DataFrame:
    """cluster, label: the most frequent words of a cluster's first n summaries. members: cluster, node_id, summary; '' if there are none."""
    first = members.groupBy("cluster").agg(F.slice(F.sort_array(F.collect_set(F.struct("node_id", "summary"))), 1, n).alias("m"))
    words = first.select("cluster", F.explode_outer(F.flatten(F.transform("m", lambda x: T.identifiers(x["summary"])))).alias("w")).groupBy("cluster", "w").agg(F.count(F.lit(1)).alias("n"))
    best = words.groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "w"))), 1, 3).alias("b"))
    return best.select("cluster", F.substring(F.coalesce(F.array_join(F.transform("b", lambda x: x["w"]), " "), F.lit("")), 1, 60).alias("label"))


def ranked_by_overlap(reports: DataFrame, outlines: DataFrame, k: int = 10) -> DataFrame:
    """instance_id, file_path, position (from 0): files of the report's repository by how many distinct identifiers they share with it.

    reports: instance_id, repo, text; outlines: repo, file_path, outline. Pairs are counted in blocks, as in BM25; ties go to the
    smaller path.
    """

    def side(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
        terms = F.transform(F.array_distinct(T.identifiers(F.col(text))), lambda t: F.xxhash64(t))
        found = rows.select(F.col("repo").alias("scope"), F.col(key).alias(name), terms.alias("t")).filter(F.size("t") > 0)
        return found.withColumn("w", F.transform("t", lambda _: F.lit(1.0)))

    best = blocks.best(side(reports, "instance_id", "text", "q"), side(outlines, "file_path", "outline", "r"), k, blocks.sparse_kernel(0), query_rows=TEXT_ROWS, record_rows=TEXT_ROWS)
    return best.select(F.col("q").alias("instance_id"), F.col("r").alias("file_path"), (F.col("rank") - 1).alias("position"))


def listwise_by_overlap(head: DataFrame) -> DataFrame:
    """instance_id, node_id, position (from 0), confidence: the head of a ranking by the share of a function's name and summary that the report has.

    head: instance_id, node_id, rank, name (text of the function), text (the report). Ties keep the order of `rank`.
    """
    tokens = head.select("instance_id", "node_id", "rank", F.array_distinct(T.code_tokens(F.col("name"))).alias("_f"), F.array_distinct(T.code_tokens(F.col("text"))).alias("_r"))
    share = F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("_f", "_r")), F.size("_f")), F.lit(0.0)), 6)
    order = Window.partitionBy("instance_id").orderBy(F.desc("confidence"), "rank", "node_id")
    return tokens.select("instance_id", "node_id", "rank", share.alias("confidence")).withColumn("position", F.row_number().over(order) - 1).select("instance_id", "node_id", "position", "confidence")


def answered(requests: DataFrame, cache: DataFrame, model: Model, *, per_minute: float = 0, tries: int = 8, tasks: int = 8) -> tuple[DataFrame, DataFrame]:
    """(all requests with text and reasoning, the new replies): cached ones are joined, misses are asked once per key.

    requests: key, prompt. Misses are asked by `tasks` tasks, each of which keeps at least 60 * tasks / per_minute seconds
    between its calls, so that all together keep to the rate. A failed call is made again, after twice the time each
    time; a request that fails every time gets a null text and isn't cached. Replies are written out before they are
    used, so a model is asked once whatever is read.
    """
    hit, miss = replies.looked_up(requests, cache)
    pause = 60 * tasks / per_minute if per_minute else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = float("-inf")
        for batch in batches:
            out = []
            for key, prompt in zip(batch["key"], batch["prompt"], strict=True):
                text = reasoning = None
                for attempt in range(tries):
                    if pause:
                        time.sleep(max(0.0, last + pause - time.monotonic()))
                        last = time.monotonic()
                    try:
                        text, reasoning = model(prompt)
                        break
                    except Exception:  # whatever a provider raises counts as a failed try
                        time.sleep(min(60, 0.01 * 2**attempt))
                out.append((key, text, reasoning))
            yield pd.DataFrame(out, columns=["key", "text", "reasoning"])

    fresh = cut(miss.select("key", "prompt").dropDuplicates(["key"]).repartition(tasks, "key").mapInPandas(run, replies.SCHEMA))
    return hit.unionByName(miss.join(fresh, "key")), fresh.filter("text is not null")


def instances(issues: DataFrame, hunks: DataFrame, *, repos: list[str] | None = None, several_files: bool = False, several_hunks: bool = False) -> DataFrame:
    """Issues of some repositories, on demand only those whose patch has more than one Python file or hunk."""
    kept = issues.filter(F.col("repo").isin(repos)) if repos else issues
    counts = hunks.groupBy("instance_id").agg(F.count_distinct("file_path").alias("_f"), F.count(F.lit(1)).alias("_h"))
    if several_files or several_hunks:
        wanted = counts.filter((F.col("_f") > 1 if several_files else F.lit(True)) & (F.col("_h") > 1 if several_hunks else F.lit(True)))
        kept = kept.join(wanted.select("instance_id"), "instance_id", "left_semi")
    return kept
