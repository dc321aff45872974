"""Metrics of ranked predictions against gold, missing where an instance has no gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE, BINS = 10, 10


def ranked_once(predictions: DataFrame, key: str, top: int = 50) -> DataFrame:
    """instance_id, key, rank (from 1): the first occurrence of each key among an instance's first `top`, ranked anew."""
    first = predictions.filter(F.col("rank") <= top).groupBy("instance_id", key).agg(F.min("rank").alias("_r"))
    return first.select("instance_id", key, F.row_number().over(Window.partitionBy("instance_id").orderBy("_r", key)).alias("rank"))


def hits(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """instance_id, n_gold, ranks: the ranks at which an instance's gold keys were predicted; instances without gold are absent."""
    wanted = gold.select("instance_id", key).distinct()
    found = wanted.join(predictions.groupBy("instance_id", key).agg(F.min("rank").alias("rank")), ["instance_id", key], "left")
    return found.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_gold"), F.array_sort(F.collect_list("rank")).alias("ranks"))


def accuracy_at(k: int):
    return F.exists("ranks", lambda r: r <= k).cast("double")


def recall_at(k: int):
    return F.size(F.filter("ranks", lambda r: r <= k)) / F.col("n_gold")


def reciprocal_rank():
    return F.coalesce(1.0 / F.get("ranks", F.lit(0)), F.lit(0.0))


def line_recall(lines: DataFrame, gold_lines: DataFrame, *, k: int = 5, tolerance: int = TOLERANCE) -> DataFrame:
    """instance_id, line_recall: the share of gold ranges that one of the first k predicted ranges of the file meets, with tolerance.

    lines: instance_id, rank, file_path, start_line, end_line; gold_lines: instance_id, file_path, start_line, end_line.
    The join is on instance and file with the overlap as a further condition.
    """
    g = gold_lines.select("instance_id", "file_path", "start_line", "end_line").withColumn("_g", F.xxhash64("file_path", "start_line", "end_line")).distinct()
    p = lines.filter(F.col("rank") <= k).select("instance_id", "file_path", F.col("start_line").alias("ps"), F.col("end_line").alias("pe"))
    met = g.join(p, ["instance_id", "file_path"]).filter((F.col("pe") + tolerance >= F.col("start_line")) & (F.col("ps") - tolerance <= F.col("end_line"))).select("instance_id", "_g").distinct().withColumn("met", F.lit(1))
    return g.join(met, ["instance_id", "_g"], "left").groupBy("instance_id").agg((F.sum(F.coalesce("met", F.lit(0))) / F.count(F.lit(1))).alias("line_recall"))


def calibration_error(tops: DataFrame, bins: int = BINS) -> DataFrame:
    """ece: mean distance of confidence and accuracy over equal bins of confidence, weighted by their size.

    tops: confidence, correct (0 or 1), one row per instance with gold and a prediction. Bins are half open, so 1.0 and
    values outside 0 to 1 are in none, yet count in the whole. Edges are multiples of a tenth as floating point has them.
    """
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    c = F.col("confidence")
    bin_of = F.coalesce(*[F.when((c >= edges[i]) & (c < edges[i + 1]), F.lit(i)) for i in range(bins)])
    whole = tops.agg(F.count(F.lit(1)).alias("n"))
    per = tops.withColumn("bin", bin_of).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("m"), F.avg("confidence").alias("conf"), F.avg(F.col("correct").cast("double")).alias("acc"))
    return per.crossJoin(F.broadcast(whole)).agg(F.round(F.sum(F.col("m") / F.col("n") * F.abs(F.col("conf") - F.col("acc"))), 6).alias("ece"))


def first_confidences(functions: DataFrame, gold_functions: DataFrame) -> DataFrame:
    """confidence, correct: the score of each instance's first function and whether it is gold; instances without gold are absent."""
    first = functions.groupBy("instance_id").agg(F.min_by(F.struct("function_key", "score"), F.struct("rank", "function_key")).alias("f")).select("instance_id", "f.*")
    judged = first.join(gold_functions.select("instance_id").distinct(), "instance_id").join(gold_functions.select("instance_id", "function_key").distinct().withColumn("_hit", F.lit(1)), ["instance_id", "function_key"], "left")
    return judged.select(F.col("score").alias("confidence"), F.coalesce("_hit", F.lit(0)).alias("correct"))


def report(files: DataFrame, gold_files: DataFrame, functions: DataFrame, gold_functions: DataFrame, lines: DataFrame, gold_lines: DataFrame, *, asked: DataFrame) -> DataFrame:
    """One row: the mean of each metric over the instances that have gold for it, their number, all instances asked, and the calibration error.

    functions: instance_id, function_key, rank, score; asked: instance_id, one row an instance. An instance without any
    prediction counts as one that found nothing.
    """
    f, g = hits(files, gold_files, "file_path"), hits(functions, gold_functions, "function_key")
    per_file = f.agg(*[F.round(F.avg(accuracy_at(k)), 6).alias(f"file_acc_{k}") for k in (1, 3, 5)])
    per_function = g.agg(
        *[F.round(F.avg(recall_at(k)), 6).alias(f"func_recall_{k}") for k in (1, 3, 5)], *[F.round(F.avg(accuracy_at(k)), 6).alias(f"func_acc_{k}") for k in (1, 5)],
        F.round(F.avg(reciprocal_rank()), 6).alias("mrr"), F.count(F.lit(1)).alias("n_with_gold_function"),
    )
    per_line = line_recall(lines, gold_lines).agg(F.round(F.avg("line_recall"), 6).alias("line_recall_5"))
    whole = asked.agg(F.count(F.lit(1)).alias("n_predictions"))
    return per_file.crossJoin(per_function).crossJoin(per_line).crossJoin(calibration_error(first_confidences(functions, gold_functions))).crossJoin(whole)


def per_instance(asked: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """instance_id, top1_func, n_files: the first function and the number of files of each instance; null and 0 for one without.

    asked: instance_id; functions: instance_id, function_key, rank; files: instance_id.
    """
    first = functions.groupBy("instance_id").agg(F.min_by("function_key", F.struct("rank", "function_key")).alias("top1_func"))
    counts = files.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_files"))
    return asked.select("instance_id").join(first, "instance_id", "left").join(counts, "instance_id", "left").select("instance_id", "top1_func", F.coalesce("n_files", F.lit(0).cast("long")).alias("n_files"))


def markdown(row: dict, name: str, baselines: dict[str, dict] | None = None) -> str:
    """A table of one system's metrics below those of others; a dash where a value is missing."""
    columns = list(row)
    shown = lambda v: "–" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| system | " + " | ".join(columns) + " |", "|" + "---|" * (len(columns) + 1)]
    for system, values in [*(baselines or {}).items(), (name, row)]:
        lines.append(f"| {system} | " + " | ".join(shown(values.get(c)) for c in columns) + " |")
    return "\n".join(lines) + "\n"


def write_csv(rows: DataFrame, path: str, files: int | None = 1) -> None:
    """CSV with a header line: one file, as a report of one row needs, or as many as the rows' partitions with None."""
    (rows.coalesce(files) if files else rows).write.mode("overwrite").csv(path, header=True)
