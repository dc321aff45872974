"""Spherical k-means as steps over DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossline.functions.vectors import unit_mean
from mossline.runtime import cut


#: More centroids than this are not handed to every worker.
MOST_CENTROIDS = 10_000


def cluster_count(n: int, least: int = 5, most: int = 500) -> int:
    """The whole root of n within bounds, but never more than n."""
    return min(n, max(least, min(most, math.isqrt(n))))


def assign(records: DataFrame, centroids: DataFrame, *, key: str, vector: str, dimensions: int) -> DataFrame:
    """key, cluster, similarity: the centroid with the largest dot product, ties to the smaller cluster.

    centroids: cluster, centroid; at most 500 by the rule above, so they go to every worker.
    """
    known = sorted((r.cluster, r.centroid) for r in centroids.limit(MOST_CENTROIDS + 1).collect())
    if len(known) > MOST_CENTROIDS:
        raise ValueError("too many centroids to hand to every worker")
    names, matrix = [c for c, _ in known], np.array([v for _, v in known], dtype=np.float64).reshape(len(known), dimensions)
    rows = records.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            scores = np.round(x @ matrix.T, 12)
            best = scores.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in best], pa.int64()), pa.array(scores[np.arange(len(best)), best])], ["key", "cluster", "similarity"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, cluster bigint, similarity double").select(F.col("key").alias(key), "cluster", F.round("similarity", 6).alias("similarity"))


def updated(records: DataFrame, assigned: DataFrame, *, key: str, vector: str, dimensions: int) -> DataFrame:
    """cluster, centroid: the unit mean of each cluster's records."""
    return unit_mean(records.select(key, vector).join(assigned.select(key, "cluster"), key), group="cluster", vector=vector, dimensions=dimensions)


def kmeans(records: DataFrame, *, key: str, vector: str, dimensions: int, iterations: int = 20, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, cluster, similarity) and (cluster, centroid) after rounds of assigning and updating, or once nothing moves.

    The first centroids are the k records of the smallest hashed keys, so a run can be repeated. A cluster that loses all
    its records keeps its centroid. Each round's result is written out, which keeps plans short and survives lost workers.
    """
    n = records.count()
    k = k or cluster_count(n)
    first = records.select(key, vector).orderBy(F.xxhash64(key), key).limit(k).collect()
    spark = records.sparkSession
    centroids = spark.createDataFrame([(i, [float(x) for x in r[1]]) for i, r in enumerate(first)], "cluster bigint, centroid array<double>")
    assigned = None
    for _ in range(iterations):
        now = cut(assign(records, centroids, key=key, vector=vector, dimensions=dimensions))
        moved = assigned is None or not now.join(assigned.select(key, F.col("cluster").alias("_c")), key).filter("cluster <> _c").isEmpty()
        assigned = now
        if not moved:
            break
        fresh = updated(records, assigned, key=key, vector=vector, dimensions=dimensions)
        centroids = cut(centroids.join(fresh.withColumnRenamed("centroid", "_f"), "cluster", "left").select("cluster", F.coalesce("_f", "centroid").alias("centroid")))
    return assigned, centroids
