"""Similarity clusters of records by density peaks.

Records with members are compared by their member sets. They meet in blocks of one shared member; a pair is judged once,
in the block of its first common member, so no pairs have to be brought together again. Every record's density is the
weight of its neighbours and its distance that to the nearest denser one. Records far from anything denser are peaks if
they are dense enough themselves; the others point to their nearest denser neighbour, and following the pointers leads
each record to its peak. Records without members are compared by centroid, in blocks of hashed directions, with the peaks
found before and with each other, and go through the same steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossline.runtime import cut

#: Least similarity (Jaccard) of member sets and least cosine of centroids of neighbours, and the length of a centroid.
SAME_MEMBERS, SAME_DIRECTION, DIMENSIONS = 0.28, 0.85, 64
#: A block of more records than this is divided by a second shared member; one that is still larger is joined in tiles of so many rows.
BLOCK_ROWS = 2_000
#: A tile is not made smaller than this, since a row goes into a tile with every other chunk of its block.
LEAST_TILE = 500
#: A record is a peak if the nearest denser one is further away than the first and its own density is at least the second.
#: The distance is that at which two sets stop being neighbours, so by default it is the lack of a denser neighbour that decides.
PEAK_DISTANCE, PEAK_DENSITY = 1 - SAME_MEMBERS, 1
#: Direction hashes: bits of a table for up to FEW_RECORDS records of one scope, and tables. Every doubling adds a bit and a table.
BITS, TABLES, FEW_RECORDS, MOST_BITS = 12, 5, 1 << 18, 18
#: Signs of a direction that are compared before the vectors are.
SIGNS = 60


def denser_pointers(nodes: DataFrame, edges: DataFrame, peak_distance: float = PEAK_DISTANCE, peak_density: int = PEAK_DENSITY) -> DataFrame:
    """id, to, density, distance: each node's nearest denser neighbour and its distance; peaks point to themselves.

    nodes: id, weight, grade (a higher grade counts as denser than any lower one); edges: a, b, distance, weight_a,
    weight_b, each pair once. Without a denser neighbour the distance is null and the node a peak. Equal densities are
    ordered by id, so pointers can't form a ring. Edges travel once to either end to learn the two densities; the nearest
    denser neighbour is then a partial aggregate.
    """
    shares = edges.select("a", F.col("weight_b").alias("w")).union(edges.select("b", "weight_a"))
    around = shares.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("_near"))
    dense = nodes.join(around, "id", "left").select("id", "grade", (F.col("weight") + F.coalesce("_near", F.lit(0))).alias("density"))
    of_a = dense.select(F.col("id").alias("a"), F.col("grade").alias("grade_a"), F.col("density").alias("density_a"))
    of_b = dense.select(F.col("id").alias("b"), F.col("grade").alias("grade_b"), F.col("density").alias("density_b"))
    both = edges.select("a", "b", "distance").join(of_a, "a").join(of_b, "b")
    up = F.struct("grade_b", "density_b", "b") > F.struct("grade_a", "density_a", "a")
    nearest = (
        both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("id"), "distance", F.when(up, F.col("b")).otherwise(F.col("a")).alias("to"))
        .groupBy("id").agg(F.min(F.struct("distance", "to")).alias("_up"))
    )
    peak = F.col("_up").isNull() | ((F.col("_up.distance").cast("float") > F.lit(peak_distance).cast("float")) & (F.col("density") >= peak_density))
    return dense.join(nearest, "id", "left").select("id", F.when(peak, F.col("id")).otherwise(F.col("_up.to")).alias("to"), "density", F.col("_up.distance").alias("distance"))


def followed(pointers: DataFrame) -> DataFrame:
    """id, peak: where the pointers of `id, to` end. Each round takes four times the steps, so depth d takes log4(d) + 1 rounds."""
    now = pointers.select("id", "to")
    while True:
        once = now.join(now.select(F.col("id").alias("to"), F.col("to").alias("_1")), "to")
        twice = once.join(once.select(F.col("id").alias("_1"), F.col("_1").alias("_2")), "_1")
        further = cut(twice.select("id", F.col("_2").alias("to"), (F.col("_1") != F.col("_2")).alias("_moved")))
        now = further.select("id", "to")
        if further.filter("_moved").isEmpty():
            return now.withColumnRenamed("to", "peak")


def member_edges(sets: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b, distance, weight_a, weight_b: pairs of sets (id, tokens sorted, weight) with two common tokens and a Jaccard of `least` or more.

    A pair with that similarity shares a token among the first n - ceil(least * n) + 1 of either set, and its second common
    token is one place further at most. In a block too large for all its pairs, the records are divided by each later token
    up to there; a block of the same two tokens that is too large even so is joined tile by tile, a tile being one chunk of
    the block against another. All pairs are judged, each in the block of its first, or first two, common tokens, so block
    sizes don't change the result.
    """
    needed = f"size(tokens) - greatest(2, cast(ceil({least} * size(tokens)) as int))"
    rows = sets.filter("size(tokens) >= 2").select(F.explode(F.expr(f"slice(tokens, 1, {needed} + 1)")).alias("token"), "id", "tokens", "weight")
    hot = cut(rows.groupBy("token").count().filter(F.col("count") > block_rows).select("token"))
    mirror = [F.col("id").alias("b"), F.col("tokens").alias("tokens_b"), F.col("weight").alias("weight_b")]
    common = F.array_intersect("tokens", "tokens_b")
    distance = F.element_at(F.transform(F.array(F.size(common)), lambda n: (1 - n / (F.size("tokens") + F.size("tokens_b") - n)).cast("float")), 1).alias("distance")
    judged = [F.col("id").alias("a"), "b", distance, F.col("weight").alias("weight_a"), "weight_b"]

    def near(c: Column, *first: str) -> Column:
        """Whether common tokens are enough and begin with those of the block."""
        own = F.size(c) >= 2
        for i, name in enumerate(first):
            own = own & (F.get(c, F.lit(i)) == F.col(name))
        return own & (F.size(c) >= F.lit(Decimal(str(least))) * (F.size("tokens") + F.size("tokens_b") - F.size(c)))

    def meet(rows: DataFrame, keys: list[str]) -> DataFrame:
        placed = rows.select(*keys, "id", "tokens", "weight").repartition(*keys)
        return placed.join(placed.select(*keys, *mirror), keys).filter("id < b").filter(near_once(*keys)).select(*judged)

    def near_once(*first: str) -> Column:
        """The same of the two sets, which are intersected once; as plain columns Catalyst would repeat that for each mention."""
        return F.exists(F.array(common), lambda c: near(c, *first))

    if hot.isEmpty():
        return meet(rows, ["token"])
    pairs = meet(rows.join(hot, "token", "left_anti"), ["token"])
    divided = rows.join(hot, "token").withColumn("second", F.explode(F.expr(f"slice(tokens, 1, {needed} + 2)"))).filter("second > token")
    two = ["token", "second"]
    crowded = cut(divided.groupBy(*two).count().filter(F.col("count") > block_rows).select(*two, F.ceil(F.col("count") / max(block_rows, LEAST_TILE)).cast("int").alias("_chunks")))
    pairs = pairs.union(meet(divided.join(crowded, two, "left_anti"), two))
    if crowded.isEmpty():
        return pairs
    large = divided.join(crowded, two).withColumn("_chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int"))
    tile = [*two, "_low", "_high"]
    left = large.select(*two, F.col("_chunk").alias("_low"), F.explode(F.sequence("_chunk", F.col("_chunks") - 1)).alias("_high"), "id", "tokens", "weight")
    right = large.select(*two, F.explode(F.sequence(F.lit(0), F.col("_chunk"))).alias("_low"), F.col("_chunk").alias("_high"), *mirror)
    met = left.join(right, tile).filter("_low < _high or id < b").filter(near_once(*two))
    swapped = F.col("id") > F.col("b")
    return pairs.union(met.select(
        F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), distance,
        F.when(swapped, F.col("weight_b")).otherwise(F.col("weight")).alias("weight_a"), F.when(swapped, F.col("weight")).otherwise(F.col("weight_b")).alias("weight_b"),
    ))


def bits_for(records: int) -> int:
    """Bits of a direction's hash, so that buckets stay about as full whatever the number of a scope's records."""
    return min(MOST_BITS, BITS + max(0, math.ceil(math.log2(max(1, records) / FEW_RECORDS))))


def planes(dimensions: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, max(SIGNS, (TABLES + bits - BITS) * bits))).astype(np.float32)


def direction_keys(records: DataFrame, dimensions: int, probes: bool, bits: int = BITS) -> DataFrame:
    """key, signs, id: a record's bucket in every table, mixed with its scope, and its first signs in one number.

    With `probes` also the buckets where one sign differs, or two of those that are closest to a plane: of four, and one
    more for every two bits above twelve.
    """
    cuts, tables, close = planes(dimensions, bits), TABLES + bits - BITS, 4 + (bits - BITS) // 2
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)
    own_bits = bits + int(tables).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, scopes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(len(ids), dimensions)
            cut_by = x @ cuts
            signs = ((cut_by[:, :SIGNS] > 0) << np.arange(SIGNS, dtype=np.int64)).sum(axis=1)
            side = cut_by[:, : tables * bits].reshape(len(ids), tables, bits)
            base = (side > 0) @ powers
            keys = [base[:, :, None]]
            if probes:
                flips = powers[np.argsort(np.abs(side), axis=2)]
                keys.append(base[:, :, None] ^ flips)
                keys.extend((base ^ flips[:, :, i] ^ flips[:, :, j])[:, :, None] for i in range(close) for j in range(i + 1, close))
            own = np.concatenate(keys, axis=2) + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]
            own = ((scopes & ~np.int64((1 << own_bits) - 1))[:, None, None] ^ own).reshape(len(ids), -1)
            n = own.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat(signs, n)), pa.array(np.repeat(ids, n))], ["key", "signs", "id"])

    return records.select("id", "scope", "vector").mapInArrow(run, "key long, signs long, id long")


def direction_edges(queries: DataFrame, records: DataFrame, least: float, dimensions: int) -> DataFrame:
    """a, b, distance, weight_a, weight_b: pairs of a query and another record of one scope and near direction.

    Records: id, scope BIGINT, vector, weight. They meet in buckets of hashed directions, finer the more records the
    largest scope has; whose signs differ too much for the cosine (by more than four standard deviations) is dropped at
    once, the cosine of the rest is computed.
    """
    bits = bits_for(records.groupBy("scope").count().agg(F.max("count")).first()[0] or 0)
    angle = np.arccos(least) / np.pi
    most = int(SIGNS * angle + 4 * np.sqrt(SIGNS * angle * (1 - angle)))
    keyed = direction_keys(records, dimensions, False, bits).select("key", F.col("signs").alias("signs_b"), F.col("id").alias("b"))
    met = direction_keys(queries, dimensions, True, bits).join(keyed, "key").filter((F.col("id") != F.col("b")) & (F.bit_count(F.col("signs").bitwiseXOR(F.col("signs_b"))) <= most))
    pairs = met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    side = [F.col("scope"), F.col("vector"), F.col("weight")]
    mine = records.select(F.col("id").alias("a"), *[c.alias(f"{n}_a") for c, n in zip(side, ("scope", "vector", "weight"), strict=True)])
    other = records.select(F.col("id").alias("b"), *[c.alias(f"{n}_b") for c, n in zip(side, ("scope", "vector", "weight"), strict=True)])
    joined = pairs.join(mine, "a").join(other, "b").filter("scope_a = scope_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(i).flatten().to_numpy().reshape(-1, dimensions).astype(np.float64) for i in (4, 5))
            x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
            cosine = (x * y).sum(axis=1)
            near = np.flatnonzero(cosine >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(near)), batch.column(1).take(pa.array(near)), pa.array(np.round(1 - cosine[near], 5).astype(np.float32)), batch.column(2).take(pa.array(near)), batch.column(3).take(pa.array(near))], ["a", "b", "distance", "weight_a", "weight_b"])

    return joined.select("a", "b", "weight_a", "weight_b", "vector_a", "vector_b").mapInArrow(run, "a long, b long, distance float, weight_a long, weight_b long")


def usable(centroid: Column, dimensions: int) -> Column:
    """Whether a centroid has the right length and only finite values, not all of them zero."""
    low, high = F.array_min(centroid).cast("double"), F.array_max(centroid).cast("double")
    full = F.size(F.array_compact(centroid)) == dimensions
    return F.coalesce((F.size(centroid) == dimensions) & full & ~F.isnan(high) & (high < 1e15) & (low > -1e15) & ((high > 1e-9) | (low < -1e-9)), F.lit(False))


def concept_clusters(
    concepts: DataFrame,
    *,
    key: str = "concept_id",
    scope: str = "repo",
    members: str = "member_function_ids",
    centroid: str = "centroid",
    at: str = "built_at",
    same_members: float = SAME_MEMBERS,
    same_direction: float = SAME_DIRECTION,
    dimensions: int = DIMENSIONS,
    block_rows: int = BLOCK_ROWS,
    peak_distance: float = PEAK_DISTANCE,
    peak_density: int = PEAK_DENSITY,
) -> DataFrame:
    """key, cluster BIGINT, density BIGINT, is_peak BOOLEAN: one row per key.

    density is the number of rows near a key's record, itself among them: by members, or if it has none by centroid among
    the rows without members.

    Rows with equal member sets of one scope are one record of more weight. Missing, empty and repeated members don't
    count. A row without members goes by its centroid; one with neither is a cluster of its own, since a label alone is
    shared by unlike groups. Of several rows of a key that with the latest `at` decides. Rows without key are dropped; a
    null scope is a scope of its own.
    """
    source = concepts.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(scope), F.lit(""))).alias("scope"), F.col(members).alias("_m"), F.col(centroid).alias("_c"), F.col(at).cast("timestamp").alias("_at")).filter("_key is not null")
    tokens = F.array_sort(F.array_distinct(F.transform(F.filter(F.col("_m"), lambda m: m.isNotNull() & (m != "")), lambda m: F.xxhash64("scope", m))))
    alone = F.xxhash64("_key", F.lit("alone"))
    rows = cut(
        source.select("_key", "scope", F.coalesce(tokens, F.array().cast("array<bigint>")).alias("tokens"), usable(F.col("_c"), dimensions).alias("usable"), "_at", F.xxhash64("scope", "_c").alias("_face"))
        .withColumn("id", F.when(F.size("tokens") > 0, F.xxhash64("scope", "tokens")).when(F.col("usable"), F.col("_face")).otherwise(alone))
        .select("_key", "scope", "tokens", "usable", "_at", "id", (F.size("tokens") > 0).alias("has_members"))
    )
    sets = cut(rows.filter("has_members").groupBy("id").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("weight")))
    edges = cut(member_edges(sets, same_members, block_rows))
    pointers = cut(denser_pointers(sets.select("id", "weight", F.lit(0).alias("grade")), edges, peak_distance, peak_density))
    known = cut(pointers.select("id", "density").join(followed(pointers), "id"))

    chosen = (
        rows.filter("has_members and usable").select("id", "_key", "_at").join(known, "id")
        .groupBy("peak").agg(F.max(F.struct("density", "_at", "_key")).alias("_best"))
        .select(F.col("peak").alias("id"), "_best._key", "_best._at", F.lit(0).cast("long").alias("weight"), F.lit(1).alias("grade"))
    )
    asking = rows.filter("not has_members and usable").groupBy("id").agg(F.max(F.struct("_key", "_at")).alias("_best"), F.count(F.lit(1)).alias("weight"))
    wanted = chosen.union(asking.select("id", "_best._key", "_best._at", "weight", F.lit(0)))
    vectors = source.filter(usable(F.col("_c"), dimensions)).select("_key", "_at", "scope", F.col("_c").cast("array<float>").alias("vector"))
    records = cut(wanted.join(vectors, ["_key"]).filter(wanted["_at"].eqNullSafe(vectors["_at"])).select("id", "scope", "vector", "weight", "grade").dropDuplicates(["id"]))
    queries = records.filter("grade = 0")
    links = cut(direction_edges(queries, records, same_direction, dimensions))
    second = cut(denser_pointers(records.select("id", "weight", "grade"), links, 1 - same_direction, peak_density))
    by_centroid = queries.select("id").join(second.select("id", "density"), "id").join(followed(second), "id")
    placed = known.union(by_centroid.select(*known.columns))
    own = rows.groupBy(F.col("_key").alias(key)).agg(F.max_by("id", F.struct("_at", "id")).alias("id"))
    return own.join(placed, "id", "left").select(
        key, F.coalesce("peak", "id").alias("cluster"), F.coalesce("density", F.lit(1)).alias("density"), (F.coalesce("peak", "id") == F.col("id")).alias("is_peak")
    )


def pairs_of(clusters: DataFrame, *, key: str = "concept_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """concept_a, concept_b: every pair of keys of one cluster, the smaller first.

    A cluster of more than `block_rows` keys is paired tile by tile, so no task holds more than one chunk against another.
    """
    sizes = clusters.groupBy("cluster").count().filter("count > 1").select("cluster", F.ceil(F.col("count") / block_rows).cast("int").alias("_chunks"))
    rows = clusters.join(sizes, "cluster").select("cluster", "_chunks", F.col(key).alias("_k"), F.pmod(F.xxhash64(key), F.col("_chunks")).cast("int").alias("_chunk"))
    left = rows.select("cluster", F.col("_chunk").alias("_low"), F.explode(F.sequence("_chunk", F.col("_chunks") - 1)).alias("_high"), F.col("_k").alias("a"))
    right = rows.select("cluster", F.explode(F.sequence(F.lit(0), F.col("_chunk"))).alias("_low"), F.col("_chunk").alias("_high"), F.col("_k").alias("b"))
    met = left.join(right, ["cluster", "_low", "_high"]).filter("_low < _high or a < b")
    return met.select(F.least("a", "b").alias("concept_a"), F.greatest("a", "b").alias("concept_b"))


def described(clusters: DataFrame, concepts: DataFrame, *, key: str = "concept_id", members: str = "member_function_ids", label: str = "label", top: int = 5) -> DataFrame:
    """cluster, size, label, typical_concepts, typical_members: one row per cluster, named by its smallest key.

    Each partition keeps the first `top` of a cluster before anything is shuffled. typical_concepts: up to `top` keys of the highest density; typical_members: up to `top` members that most of the
    cluster's concepts have; label: the most frequent one in lower case. Ties go to the smaller value.
    """
    content = concepts.groupBy(key).agg(F.max(F.struct(F.lower(F.trim(F.col(label))).alias("l"), F.array_distinct(members).alias("m"))).alias("_c"))
    rows = clusters.join(content, key)
    best = Window.partitionBy("cluster").orderBy(F.desc("n"), "value")

    def leading(values: DataFrame) -> DataFrame:
        counted = values.filter("value is not null and value <> ''").groupBy("cluster", "value").agg(F.count(F.lit(1)).alias("n"))
        return counted.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]).alias("values"))

    typical = leading(rows.select("cluster", F.explode("_c.m").alias("value"))).withColumnRenamed("values", "typical_members")
    labels = leading(rows.select("cluster", F.col("_c.l").alias("value"))).select("cluster", F.get("values", F.lit(0)).alias("label"))
    dense = Window.partitionBy("cluster").orderBy(F.desc("density"), key)
    firsts = (
        clusters.withColumn("_r", F.row_number().over(dense)).filter(F.col("_r") <= top)
        .groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", key))), lambda x: x[key]).alias("typical_concepts"))
    )
    heads = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("_first")).join(firsts, "cluster")
    return heads.join(labels, "cluster", "left").join(typical, "cluster", "left").select(F.col("_first").alias("cluster"), "size", "label", "typical_concepts", "typical_members")
