"""Attributes as known at event time: a temporal join over dyadic time nodes.

Each version of an entity becomes usable once it is both valid and recorded. From then on it is the answer until a
version of higher precedence (later valid_from, then later recorded_at, then higher id) becomes usable. These exact
half-open intervals are disjoint within an entity. Each is decomposed into a handful of dyadic time nodes, no finer than a
sixteenth to a quarter of its length; an event is sent to the enclosing node of each level that its entity's intervals
use, which a join of one row per entity tells. The range condition so becomes an equi-join that spreads a hot entity over
its nodes, and the exact interval is checked after it: an event meets its own version and few neighbours of it, however
many the entity has. Rows travel as hashes of 128 bits; names are joined back to what matched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossline.runtime import micros

#: Leaves of 2**28 microseconds (4.5 minutes); two binary levels a step, 14 levels up to a root of 571 years.
LEAF_BITS, STEP, LEVELS = 28, 2, 14
#: Levels that the nodes of one interval are on.
SPAN = 3
ORIGIN = 1 << 53
TOP_LEAF = (1 << (STEP * (LEVELS - 1))) - 1
#: Versions of one entity are ordered in blocks of 2**38 microseconds (3 days) of their valid_from.
BLOCK_BITS = 38
NEVER = (1 << 62) - 1


def leaf(time: str) -> str:
    """SQL: the leaf that encloses a time in microseconds; times beyond the root share its outer leaves."""
    return f"least(greatest(shiftright({time} + {ORIGIN}L, {LEAF_BITS}), 0L), {TOP_LEAF}L)"


def nodes_of_interval(start: str, end: str) -> str:
    """SQL: array of (level, node) of disjoint nodes that cover the half-open interval, widened to whole nodes of its lowest level.

    The lowest level is such that 4 to 16 of its nodes make the length, so the interval grows by a quarter at most on
    either side (the outer leaves and the last levels aside), and three levels hold all nodes, five or so.
    """
    first, past = leaf(start), f"({leaf(f'({end} - 1)')} + 1)"
    base = f"least(greatest(cast(floor(log2(cast({past} - {first} as double)) / {STEP}) as int) - 1, 0), {LEVELS - SPAN})"
    span = "if({0} < {1}, sequence({0}, {1} - 1L), cast(array() as array<bigint>))"
    arrays = []
    for k in range(SPAN):
        low, high = f"shiftright(x.low + {(1 << STEP * k) - 1}L, {STEP * k})", f"shiftright(x.high, {STEP * k})"
        if k == SPAN - 1:
            nodes = span.format(low, high)
        else:
            up = STEP * (k + 1)
            above_low = f"shiftleft(shiftright(x.low + {(1 << up) - 1}L, {up}), {STEP})"
            above_high = f"shiftleft(shiftright(x.high, {up}), {STEP})"
            nodes = f"if({above_low} < {above_high}, concat({span.format(low, above_low)}, {span.format(above_high, high)}), {span.format(low, high)})"
        arrays.append(f"transform({nodes}, n -> struct(x.base + {k} as level, n as node))")
    widened = f"transform(transform(array(struct({base} as base, {first} as first, {past} as past)), y -> struct(y.base as base, shiftright(y.first, {STEP} * y.base) as low, shiftright(y.past + shiftleft(1L, {STEP} * y.base) - 1L, {STEP} * y.base) as high)), x -> concat({', '.join(arrays)}))[0]"
    return widened


def usable_intervals(versions: DataFrame, entity: list[str], valid_from: str, known_from: str, version_id: str) -> DataFrame:
    """Entity columns, version_id, start, end: when each version is the best one that is valid and known.

    Versions without either time are never usable. Repeated rows count once; of rows with equal times the highest id
    wins. Entity columns may be null: null is not a value that an event could match, so such rows are dropped.
    """
    keys = [f"_e{i}" for i in range(len(entity))]
    v = (
        versions.select(*[F.col(c).alias(k) for c, k in zip(entity, keys, strict=True)], micros(valid_from).alias("_vf"), micros(known_from).alias("_kf"), F.col(version_id).alias("_id"))
        .dropna()
        .withColumn("_block", F.shiftright("_vf", BLOCK_BITS))
        .withColumn("_start", F.greatest("_vf", "_kf"))
        .dropDuplicates([*keys, "_block", "_vf", "_kf", "_id"])
    )
    later_blocks = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = v.groupBy(*keys, "_block").agg(F.min("_start").alias("_first")).withColumn("_later", F.min("_first").over(later_blocks)).drop("_first")
    better = Window.partitionBy(*keys, "_block").orderBy(F.desc("_vf"), F.desc("_kf"), F.desc("_id")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        v.withColumn("_superseded", F.min("_start").over(better))
        .join(blocks, [*keys, "_block"])
        .withColumn("_end", F.coalesce(F.least("_superseded", "_later"), F.lit(NEVER)))
        .filter("_start < _end")
        .select(*keys, "_id", "_start", "_end")
    )


def attributes_known_at(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_keys: list[str],
    entity: list[str],
    event_time: str,
    valid_from: str,
    known_from: str,
    version_id: str,
) -> DataFrame:
    """event_keys, version_id: for each event the best version of its entity that was valid and known at event_time.

    events: one row per event with `event_keys`, the `entity` columns and `event_time`. Events without a time or an
    entity, and those before any usable version, give no row. Other columns of either side are ignored, whatever their
    names. An event time equal to a version's start sees that version; one equal to its end doesn't.
    """
    keys, out = [f"_e{i}" for i in range(len(entity))], [f"_k{i}" for i in range(len(event_keys))]
    entity_hash = [F.xxhash64(*keys).alias("_h"), F.xxhash64(*keys, F.lit("2")).alias("_h2")]
    v = (
        usable_intervals(versions, entity, valid_from, known_from, version_id)
        .withColumn("_n", F.explode(F.expr(nodes_of_interval("_start", "_end"))))
        .select(*entity_hash, "_id", "_start", "_end", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    )
    levels = v.groupBy("_h").agg(F.sort_array(F.collect_set("_level")).alias("_levels"))
    named = events.select(*[F.col(c).alias(k) for c, k in zip(event_keys, out, strict=True)], *[F.col(c).alias(k) for c, k in zip(entity, keys, strict=True)], micros(event_time).alias("_t")).dropna(subset=[*keys, "_t"])
    own = [F.xxhash64(*out, *keys, "_t").alias("_x"), F.xxhash64(*out, *keys, "_t", F.lit("2")).alias("_x2")]
    e = (
        named.select(*entity_hash, "_t", *own).join(levels, "_h").distinct()
        .withColumn("_level", F.explode("_levels"))
        .select("_x", "_x2", "_h", "_h2", "_t", "_level", F.expr(f"shiftright({leaf('_t')}, {STEP} * _level)").alias("_node"))
    )
    matched = e.join(v.withColumnRenamed("_h2", "_v2"), ["_h", "_level", "_node"]).filter("_start <= _t and _t < _end and _h2 = _v2").select("_x", "_x2", "_id")
    return named.select(*out, *own).join(matched, ["_x", "_x2"]).select(*[F.col(k).alias(c) for c, k in zip(event_keys, out, strict=True)], F.col("_id").alias(version_id))


def commit_files(commits: DataFrame) -> DataFrame:
    """repo, sha, file_path, authored_at: each distinct sha and file; of several deliveries the last with a time counts."""
    exploded = commits.select("repo", "sha", "authored_at", "ingested_at", F.explode(F.array_distinct("files")).alias("file_path"))
    return (
        exploded.filter("sha is not null and file_path is not null and authored_at is not null")
        .groupBy("sha", "file_path")
        .agg(F.max(F.struct("ingested_at", "authored_at", "repo")).alias("_last"))
        .select("sha", "file_path", "_last.authored_at", "_last.repo")
    )


def commit_file_versions(commits: DataFrame, file_versions: DataFrame) -> DataFrame:
    """sha, file_path, version_id: the attributes of each file of a commit as valid and known when it was authored."""
    return attributes_known_at(
        commit_files(commits), file_versions, event_keys=["sha", "file_path"], entity=["repo", "file_path"],
        event_time="authored_at", valid_from="valid_from", known_from="recorded_at", version_id="version_id",
    )
