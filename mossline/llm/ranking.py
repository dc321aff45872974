"""One ranking from several differently scaled scores: percentiles, normal quantiles, weighted mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossline.operators.prefix import group_ranks
from mossline.runtime import cut

#: The published coefficients of Acklam's rational approximation of the inverse normal distribution.
CENTRE_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def horner(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1 (relative error below 1.2e-9)."""
    q = p - 0.5
    r = q * q
    low, high = F.sqrt(-2.0 * F.log(p)), F.sqrt(-2.0 * F.log(1.0 - p))
    return (
        F.when(p < TAIL, horner(TAIL_NUM, low) / horner(TAIL_DEN, low))
        .when(p > 1.0 - TAIL, -horner(TAIL_NUM, high) / horner(TAIL_DEN, high))
        .otherwise(horner(CENTRE_NUM, r) * q / horner(CENTRE_DEN, r))
    )


def root_relative(path: Column) -> Column:
    """A path as spelled from the root of its repository: forward slashes, no blanks around, no ./ or / before, nor a diff's a/ or b/."""
    p = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/(\\./|/)+", "/")
    return F.regexp_replace(p, "^([ab]/(?=.)|(\\.?/)+)", "")


#: A group of more rows than this is not gathered in one task.
HOT_ROWS = 2_000_000


def ordering_value(n: Column, n_scores: Column, n_ranks: Column, low: Column) -> Column:
    """What orders a list, larger first: scores if all its items have one, ranks if all have one, else scores and below them ranks."""
    return (
        F.when(n_scores == n, F.col("_score")).when(n_ranks == n, -F.col("_rank"))
        .otherwise(F.coalesce(F.col("_score"), F.coalesce(low, F.lit(0.0)) - 1.0 - F.abs("_rank")))
    )


def bounded(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.7e308)), F.lit(-1.7e308))


def gathered_items(once: DataFrame) -> DataFrame:
    """_g, _i, _in, _lists, n_items of groups that fit one task: rows are brought together by group once, all else is local to it."""
    lists, group = Window.partitionBy("_g", "_s"), Window.partitionBy("_g")
    valued = (
        once.withColumn("_n", F.count(F.lit(1)).over(lists))
        .withColumn("_v", bounded(ordering_value(F.col("_n"), F.count("_score").over(lists), F.count("_rank").over(lists), F.min("_score").over(lists))))
        .withColumn("n_below", F.rank().over(lists.orderBy("_v")).cast("long") - 1)
        .withColumn("n_ties", F.count(F.lit(1)).over(Window.partitionBy("_g", "_s", "_v")))
        .withColumn("_lists", F.sort_array(F.collect_set(F.struct("_s", "_n")).over(group)))
    )
    items = valued.groupBy("_g", "_i").agg(F.sort_array(F.collect_list(F.struct("_s", "n_below", "n_ties", F.col("_n").alias("n_group")))).alias("_in"), F.first("_lists").alias("_lists"))
    return items.withColumn("n_items", F.count(F.lit(1)).over(group))


def spread_items(once: DataFrame) -> DataFrame:
    """The same of groups of any size: ranks come from blocks of values, no task sees a whole group."""
    sizes = once.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_n"), F.count("_score").alias("_ns"), F.count("_rank").alias("_nr"), F.min("_score").alias("_low"))
    valued = once.join(sizes, ["_g", "_s"]).select("_g", "_s", "_i", bounded(ordering_value(F.col("_n"), F.col("_ns"), F.col("_nr"), F.col("_low"))).alias("_v"))
    ranks = group_ranks(valued, ["_g", "_s"], "_v")
    items = valued.join(ranks, ["_g", "_s", "_v"]).groupBy("_g", "_i").agg(F.sort_array(F.collect_list(F.struct("_s", "n_below", "n_ties", "n_group"))).alias("_in"))
    lists = sizes.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_s", "_n"))).alias("_lists"))
    groups = items.groupBy("_g").agg(F.count(F.lit(1)).alias("n_items")).join(lists, "_g")
    return items.join(groups, "_g").select("_g", "_i", "_in", "_lists", "n_items")


def fused_scores(
    rankings: DataFrame,
    weights: dict[str, float],
    *,
    group: str = "instance_id",
    source: str = "retriever",
    item: str = "file_path",
    score: str = "score",
    rank: str = "rank",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """group, item, fused DOUBLE, n_lists INT, n_items BIGINT: one row per group and item of any of its lists.

    Each list of a group gives every item of the group a percentile among all items of the group, ties averaged; items
    that a list lacks tie below all that it has, so a short list and a long one spread alike. Percentiles go through the
    inverse normal distribution; fused is the mean over the group's lists by `weights`. A list that is missing from a
    group takes no part in it. A list whose items all have a score is ordered by score, one whose items all have a rank by
    rank, any other by score where present and otherwise by rank after all scored items; of an item that a list has twice
    the better place counts. Rows without group, item, or both rank and score, and lists without a weight are ignored.
    Infinite scores order as such. Item text is used as given; `root_relative` normalises paths.
    """
    weights = {k.lower(): float(w) for k, w in weights.items()}
    rows = rankings.select(
        F.col(group).alias("_g"), F.lower(F.trim(F.col(source))).alias("_s"), F.col(item).alias("_i"),
        F.when(~F.isnan(F.col(score)), F.col(score).cast("double")).alias("_score"), F.col(rank).cast("double").alias("_rank"),
    ).filter(F.col("_g").isNotNull() & (F.col("_i") != "") & F.col("_s").isin(*weights) & F.coalesce("_score", "_rank").isNotNull())
    best = [F.max("_score").alias("_score"), F.min("_rank").alias("_rank")]
    hot = cut(rows.groupBy("_g").count().filter(F.col("count") > hot_rows).select("_g"))
    if hot.isEmpty():
        items = gathered_items(rows.repartition("_g").groupBy("_g", "_s", "_i").agg(*best))
    else:
        usual = gathered_items(rows.join(hot, "_g", "left_anti").repartition("_g").groupBy("_g", "_s", "_i").agg(*best))
        items = usual.unionByName(spread_items(rows.join(hot, "_g", "left_semi").groupBy("_g", "_s", "_i").agg(*best)))
    weight = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    n = F.col("n_items")

    def z(p_rank: Column) -> Column:
        return inverse_normal(p_rank / n.cast("double"))

    found = F.aggregate(
        F.col("_in"), F.lit(0.0),
        lambda total, x: total + weight[x["_s"]] * (z((n - x["n_group"] + x["n_below"]).cast("double") + x["n_ties"] / 2.0) - absent(n - x["n_group"], n)),
    )
    floor = F.aggregate(F.col("_lists"), F.lit(0.0), lambda total, x: total + weight[x["_s"]] * absent(n - x["_n"], n))
    total = F.aggregate(F.col("_lists"), F.lit(0.0), lambda total, x: total + weight[x["_s"]])
    return items.select(F.col("_g").alias(group), F.col("_i").alias(item), F.round((found + floor) / total, 9).alias("fused"), F.size("_in").alias("n_lists"), n)


def absent(missing: Column, n: Column) -> Column:
    """Quantile of the items that a list lacks; 0 where it lacks none, as nothing then uses it."""
    return F.when(missing > 0, inverse_normal(missing.cast("double") / 2.0 / n.cast("double"))).otherwise(0.0)


def first_items(fused: DataFrame, *, group: str = "instance_id", item: str = "file_path") -> DataFrame:
    """group, item: the item that comes first; ties go to the item in more lists, then to the smaller text."""
    order = F.struct(-F.col("fused"), -F.col("n_lists"), F.col(item))
    return fused.groupBy(group).agg(F.min_by(item, order).alias(item))


def positions(fused: DataFrame, *, group: str = "instance_id", item: str = "file_path") -> DataFrame:
    """group, item, fused, position BIGINT: 1 for the first; items of equal score share the position of the first of them."""
    ranks = group_ranks(fused.withColumn("_down", -F.col("fused")), [group], "_down")
    return fused.withColumn("_down", -F.col("fused")).join(ranks, [group, "_down"]).select(group, item, "fused", (F.col("n_below") + 1).alias("position"))
