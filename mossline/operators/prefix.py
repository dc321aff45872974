"""Order statistics inside groups of any size.

A window over a hot group would sort a third of all rows in one task. Here a group is cut into blocks by a monotone
function of the ordered value: sums per block are taken first, a window over the few blocks of a group gives what lies
before a block, and the window over rows never sees more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def magnitude_block(value: Column, per_octave: int = 8) -> Column:
    """A monotone whole number of a double: `per_octave` blocks for each doubling of its size."""
    return F.floor(F.signum(value) * F.log2(F.lit(1.0) + F.abs(value)) * per_octave).cast("int")


def group_ranks(df: DataFrame, keys: list[str], value: str, block: Column | None = None) -> DataFrame:
    """One row per group and distinct value: rows below it, rows equal to it, rows of the group.

    df: has `keys` and a double column `value` that is neither null nor NaN.
    Result: keys, value, n_below, n_ties, n_group (BIGINT). Ties are counted before the first shuffle, so a value that
    fills a group is one row. An empty input gives an empty result.
    """
    block = magnitude_block(F.col(value)) if block is None else block
    counts = df.groupBy(*keys, F.col(value), block.alias("_block")).agg(F.count(F.lit(1)).alias("n_ties"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    blocks = (
        df.groupBy(*keys, block.alias("_block"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n_group", F.sum("_n").over(Window.partitionBy(*keys)))
        .drop("_n")
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.join(blocks, [*keys, "_block"])
        .withColumn("n_below", F.col("_before") + F.coalesce(F.sum("n_ties").over(in_block), F.lit(0)))
        .select(*keys, value, "n_below", "n_ties", "n_group")
    )
