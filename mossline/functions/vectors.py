"""Vectors: products as columns, top-k search in blocks, and a hashing encoder that needs no model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossline.functions import blocks

#: Groups whose sums a task holds before it hands them on.
GROUPS_HELD = 4_096


def dot(a: Column, b: Column) -> Column:
    """The dot product of two array columns in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_sums(vectors: DataFrame, *, group: str, vector: str, dimensions: int) -> DataFrame:
    """g, s ARRAY<DOUBLE>, n ARRAY<BIGINT>: per group and value, the sum and the number of the numbers that are no NaN.

    Each partition adds up its own rows first, so a group of any size gives a few rows a partition. Vectors of another
    length take no part.
    """
    rows = vectors.select(F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v")).filter((F.size("v") == dimensions) & F.col("g").isNotNull())
    kind = rows.schema["g"].dataType.simpleString()

    def packed(sums: dict, kind: pa.DataType) -> pa.RecordBatch:
        flat = [np.concatenate([x[i] for x in sums.values()]) for i in (0, 1)]
        offsets = pa.array(np.arange(0, dimensions * len(sums) + 1, dimensions), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(sums), kind), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]], ["g", "s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            known = ~np.isnan(x)
            order = np.argsort(codes.indices.to_numpy(), kind="stable")
            starts = np.flatnonzero(np.diff(codes.indices.to_numpy()[order], prepend=-1))
            total, count = np.add.reduceat(np.where(known, x, 0.0)[order], starts, axis=0), np.add.reduceat(known[order].astype(np.int64), starts, axis=0)
            for i, name in enumerate(codes.dictionary.to_pylist()):
                if name in sums:
                    sums[name] = (sums[name][0] + total[i], sums[name][1] + count[i])
                else:
                    sums[name] = (total[i], count[i])
            if len(sums) > GROUPS_HELD:
                yield packed(sums, batch.column(0).type)
                sums = {}
        if sums:
            yield packed(sums, batch.column(0).type)

    parts = rows.mapInArrow(run, f"g {kind}, s array<double>, n array<bigint>").groupBy("g").agg(F.collect_list("s").alias("s"), F.collect_list("n").alias("n"))
    added = lambda c, zero: F.aggregate(F.slice(c, 2, F.size(c)), F.element_at(c, 1), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero)))
    return parts.select("g", added("s", F.lit(0.0)).alias("s"), added("n", F.lit(0)).alias("n"))


def unit_mean(vectors: DataFrame, *, group: str, vector: str, dimensions: int = 64) -> DataFrame:
    """group, centroid ARRAY<DOUBLE>: mean of a group's vectors divided by its length plus 1e-9; values that all lack count as zero."""
    sums = vector_sums(vectors, group=group, vector=vector, dimensions=dimensions)
    means = sums.select("g", F.zip_with("s", "n", lambda s, n: F.coalesce(F.try_divide(s, n), F.lit(0.0))).alias("c"))
    return means.withColumn("_l", norm(F.col("c")) + 1e-9).select(F.col("g").alias(group), F.transform("c", lambda x: x / F.col("_l")).alias("centroid"))


def top_k(queries: DataFrame, records: DataFrame, k: int, *, query_id: str, record_id: str, query_vector: str, record_vector: str, dimensions: int, scope: str | None = None, query_block: int = blocks.QUERY_ROWS, record_block: int = blocks.RECORD_ROWS) -> DataFrame:
    """query_id, record_id, score, rank (from 1): for each query the k records with the largest dot product, ties by id.

    With `scope`, only records of the query's own scope. Records and queries without a finite vector of the right length,
    or without an id, take no part. Ids are expected to be unique.
    """

    def side(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
        finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        own = rows.select((F.col(scope) if scope else F.lit(0)).alias("scope"), F.col(key).alias(name), F.col(vector).cast("array<double>").alias("v"))
        return own.filter((F.size("v") == dimensions) & F.col(name).isNotNull() & finite)

    found = blocks.best(side(queries, query_id, query_vector, "q"), side(records, record_id, record_vector, "r"), k, blocks.dense_kernel(dimensions), query_rows=query_block, record_rows=record_block)
    return found.select(F.col("q").alias(query_id), F.col("r").alias(record_id), F.round("score", 6).alias("score"), "rank")


def hashed_vector(tokens: Column, dimensions: int = 64) -> Column:
    """A unit vector of signed token counts, by hash; the encoder used where no model is given."""
    slot = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(t, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(F.filter(slot, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    length = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(length > 0, F.transform(sums, lambda x: x / length)).otherwise(sums)


def hashed_slots(tokens: Column, dimensions: int) -> Column:
    """Of each token, twice the place that it counts for, plus one where it counts negatively."""
    return F.transform(tokens, lambda t: (2 * F.pmod(F.xxhash64(t), F.lit(dimensions)) + F.pmod(F.xxhash64(t, F.lit("sign")), F.lit(2))).cast("int"))


def hashed_vectors(rows: DataFrame, *, tokens: str, dimensions: int = 64, name: str = "vector") -> DataFrame:
    """The other columns, and in place of the tokens the vector of `hashed_vector`, for long texts: one pass in Arrow batches, no shuffle."""
    own = [c for c in rows.columns if c != tokens]
    slots = rows.select(*own, hashed_slots(F.coalesce(F.col(tokens), F.array().cast("array<string>")), dimensions).alias("_slots"))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own] + [f"`{name}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, last = batch.num_rows, batch.column(batch.num_columns - 1)
            counts = np.diff(last.offsets.to_numpy())
            code = last.flatten().to_numpy()
            sums = np.bincount(np.repeat(np.arange(n), counts) * dimensions + code // 2, weights=1.0 - 2.0 * (code % 2), minlength=n * dimensions).reshape(n, dimensions)
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            unit = sums / np.where(length > 0, length, 1.0)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dimensions + 1, dimensions), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vector], [*own, name])

    return slots.mapInArrow(run, schema)
