"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossline.runtime import cut, small_enough

#: Tokens of a block and of a shard. A shard is what one task orders and sums, so it bounds a task whatever the source.
BLOCK_TOKENS = 1_024
SHARD_TOKENS = 4_000_000
#: Targets and counts per target source are collected; more rows than this are refused.
MOST_TARGETS = 10_000


def normal_source(source: Column) -> Column:
    """A source name without blanks around it and in lower case."""
    return F.lower(F.trim(source))


def sainte_lague(weights: dict[str, float], seats: int, caps: dict[str, int]) -> dict[str, int]:
    """Seats by highest quotients weight / (2k + 1), no party above its cap; ties go to the smaller name.

    The quotient limit is found by bisection, so the work doesn't grow with the seats; the last few seats are given one
    by one. If the caps add up to less than `seats`, every party ends at its cap.
    """
    parties = sorted(p for p in weights if weights[p] > 0 and caps.get(p, 0) > 0)
    got = dict.fromkeys(weights, 0)
    if seats <= 0 or not parties:
        return got
    if sum(caps[p] for p in parties) <= seats:
        return got | {p: caps[p] for p in parties}

    def at(limit: float) -> dict[str, int]:
        return {p: min(caps[p], max(0, math.floor((weights[p] / limit + 1) / 2))) for p in parties}

    low, high = 0.0, 2 * max(weights[p] for p in parties)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if sum(at(middle).values()) > seats:
            low = middle
        else:
            high = middle
    got |= at(high)
    for _ in range(seats - sum(got.values())):
        best = max((p for p in parties if got[p] < caps[p]), key=lambda p: weights[p] / (2 * got[p] + 1))
        got[best] += 1
    return got


def shard_quotas(shards: DataFrame, quotas: DataFrame) -> DataFrame:
    """_source, _shard, _quota: a source's quota of blocks over its shards by highest quotients, none above its cap.

    shards: _source, _shard, _blocks, _cap; quotas: _source, _want. A shard first gets its share rounded down less one,
    then its next four quotients compete: Sainte-Lague never gives a shard more than a seat or two beside its share.
    """
    total = F.sum("_blocks").over(Window.partitionBy("_source"))
    base = (
        shards.join(quotas, "_source")
        .withColumn("_share", F.col("_want") * F.col("_blocks") / total)
        .withColumn("_base", F.greatest(F.lit(0), F.least(F.col("_cap"), F.floor("_share") - 1)).cast("long"))
        .withColumn("_left", F.col("_want") - F.sum("_base").over(Window.partitionBy("_source")))
    )
    order = Window.partitionBy("_source").orderBy(F.desc("_quotient"), "_shard", "_k")
    won = (
        base.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .filter(F.col("_base") + F.col("_k") < F.col("_cap"))
        .withColumn("_quotient", F.col("_blocks") / (2 * (F.col("_base") + F.col("_k")) + 1))
        .withColumn("_rank", F.row_number().over(order))
        .filter("_rank <= _left")
        .groupBy("_source", "_shard")
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    return base.join(won, ["_source", "_shard"], "left").select("_source", "_shard", (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("_quota"))


def mixed(
    sizes: DataFrame,
    targets: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    size: str = "n_tokens",
    total_tokens: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = 7,
) -> DataFrame:
    """key, source, n_tokens, copies INT: each record that takes part and how often (1 to the source's max_repeats).

    sizes: key, source, size (tokens). targets: source, target_share, max_repeats; one row per source, at most
    MOST_TARGETS rows, or a ValueError is raised. Names are compared trimmed and in lower case. Records of other sources or none, without size, and of null
    key take no part. Without `total_tokens` the mix is as large as it can be with every source that has any record at
    its share; shares of sources without records go to the others in proportion. A given total that is beyond what the
    repeats allow leaves sources at their caps and hands their blocks to the others.

    Records are placed in shards by a seeded hash and one after another in blocks of `block_tokens` by where they begin, so
    a block holds that many tokens but for what its last record has beyond its end, and a record longer than a block takes
    the numbers of those that it fills. Quotas therefore count blocks of a source's own average size. A quota of q blocks over n takes every block q // n times and q % n blocks, in seeded order, once more.
    """
    if not small_enough(targets, MOST_TARGETS):
        raise ValueError(f"more than {MOST_TARGETS} targets")
    by_source = (
        sizes.select(F.col(key).alias("_key"), normal_source(F.col(source)).alias("_source"), F.col(size).cast("long").alias("_size"))
        .filter("_key is not null and _source is not null and _size > 0")
        .join(targets.select(normal_source(F.col("source")).alias("_source")).distinct(), "_source", "left_semi")
    )
    wanted = {
        r["s"]: (float(r["share"] or 0), int(r["repeats"] or 1))
        for r in targets.filter("source is not null").groupBy(normal_source(F.col("source")).alias("s")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()
    }
    have = {r["_source"]: r["n"] for r in by_source.groupBy("_source").agg(F.sum("_size").alias("n")).collect()}
    n_shards = F.create_map(*[F.lit(x) for s in have for x in (s, max(1, -(-have[s] // shard_tokens)))]) if have else F.create_map(F.lit(""), F.lit(1))
    shuffled = F.xxhash64(F.lit(seed), "_key")
    order = Window.partitionBy("_source", "_shard").orderBy("_hash", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(
        by_source.withColumn("_hash", shuffled)
        .withColumn("_shard", F.pmod("_hash", n_shards[F.col("_source")]))
        .withColumn("_block", F.floor(F.coalesce(F.sum("_size").over(order), F.lit(0)) / block_tokens))
        .drop("_hash")
    )
    blocks = placed.groupBy("_source", "_shard", "_block").agg(F.sum("_size").alias("_tokens"))
    shards = blocks.groupBy("_source", "_shard").agg(F.count(F.lit(1)).alias("_blocks"), F.sum("_tokens").alias("_tokens"))
    counted = {r["_source"]: (r["n"], r["t"]) for r in shards.groupBy("_source").agg(F.sum("_blocks").alias("n"), F.sum("_tokens").alias("t")).collect()}
    # a quota counts blocks of a source's own average size, so that shares hold in tokens
    live = {s: wanted[s] for s in counted if wanted[s][0] > 0}
    spread = sum(share for share, _ in live.values()) or 1.0
    units = {s: counted[s][1] / block_tokens for s in live}
    full = total_tokens / block_tokens if total_tokens else min((units[s] * live[s][1] * spread / live[s][0] for s in live), default=0)
    caps = {s: math.floor(units[s] * live[s][1]) for s in live}
    seats = sainte_lague({s: live[s][0] for s in live}, math.floor(full), caps)
    want = [(s, min(counted[s][0] * live[s][1], round(seats[s] * counted[s][0] / units[s]))) for s in live]
    spark = sizes.sparkSession
    quotas = spark.createDataFrame(want, "_source string, _want long")
    repeats = spark.createDataFrame([(s, live[s][1]) for s in live], "_source string, _repeats int")
    capped = shards.join(repeats, "_source").withColumn("_cap", F.col("_blocks") * F.col("_repeats")).drop("_repeats", "_tokens")
    chosen = shard_quotas(capped, quotas).join(shards.drop("_tokens"), ["_source", "_shard"])
    lottery = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "_source", "_shard", "_block"), "_block")
    copies = (
        blocks.withColumn("_ticket", F.row_number().over(lottery))
        .join(chosen, ["_source", "_shard"])
        .withColumn("copies", (F.floor(F.col("_quota") / F.col("_blocks")) + (F.col("_ticket") <= F.pmod("_quota", "_blocks")).cast("int")).cast("int"))
        .filter("copies > 0")
        .select("_source", "_shard", "_block", "copies")
    )
    return placed.join(copies, ["_source", "_shard", "_block"]).select(F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_size").alias("n_tokens"), "copies")


def shares_reached(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_records, mixed_tokens, most_copies, reached_share: one row per target source."""
    per = mix.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    wanted = targets.filter("source is not null").groupBy(normal_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())
    return wanted.join(per, "source", "left").select(
        "source", "target_share", "max_repeats",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_records", "mixed_tokens", "most_copies")],
        F.round(F.coalesce(F.col("mixed_tokens") / whole, F.lit(0.0)), 6).alias("reached_share"),
    )
