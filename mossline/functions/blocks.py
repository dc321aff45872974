"""Every query against every record of its scope, block by block: what top-k search by vectors and by terms has in common.

Queries and records of a scope are cut into blocks of a bounded size, and each pair of blocks is one row, multiplied in one
place with numpy. A scope of any size spreads over all its pairs of blocks, nothing passes through the driver, and of a
pair only each query's best k are handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and records of a block at most, on average; blocks of records are smaller where that keeps all cores busy.
QUERY_ROWS, RECORD_ROWS, LEAST_ROWS = 1_024, 4_096, 256

#: Given the items of two blocks as columns (without their ids): scores, a row a query and a column a record; NaN for no score.
Kernel = Callable[[pa.StructArray, pa.StructArray], np.ndarray]


def paired(queries: DataFrame, records: DataFrame, query_rows: int, record_rows: int) -> DataFrame:
    """qs, rs: arrays of the items (columns but scope; the first is the id) of each pair of blocks of one scope."""
    cores = records.sparkSession.sparkContext.defaultParallelism
    n = F.col("count")
    spread_over = F.greatest(F.ceil(n / record_rows), F.least(F.lit(cores), F.ceil(n / LEAST_ROWS))).cast("int")
    sizes = queries.groupBy("scope").count().select("scope", F.ceil(n / query_rows).cast("int").alias("_q")).join(records.groupBy("scope").count().select("scope", spread_over.alias("_r")), "scope")

    def blocks(items: DataFrame, size: str, name: str) -> DataFrame:
        own = [c for c in items.columns if c != "scope"]
        placed = items.join(sizes, "scope").withColumn("_b", F.pmod(F.xxhash64(own[0]), F.col(size)).cast("int"))
        return placed.groupBy("scope", F.col("_b").alias(f"_{name}b")).agg(F.first("_r").alias("_n"), F.collect_list(F.struct(*own)).alias(f"{name}s"))

    asked = blocks(queries, "_q", "q").withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return asked.join(blocks(records, "_r", "r").drop("_n"), ["scope", "_rb"]).select("qs", "rs")


def best_of_row(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties by `order`; NaN takes no part."""
    known = np.flatnonzero(~np.isnan(scores))
    if len(known) > k:
        least = np.partition(scores[known], len(known) - k)[len(known) - k]
        known = known[scores[known] >= least]
    return known[np.lexsort((order[known], -scores[known]))[:k]]


def best(queries: DataFrame, records: DataFrame, k: int, kernel: Kernel, *, query_rows: int = QUERY_ROWS, record_rows: int = RECORD_ROWS) -> DataFrame:
    """q, r, score, rank (from 1): each query's k best records of its scope, ties by r.

    queries: scope, q and what the kernel needs; records: scope, r and what it needs. Ids are expected to be unique in a
    scope. A null scope is met by none.
    """
    kinds = [queries.schema["q"].dataType, records.schema["r"].dataType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qs, rs = batch.column(0)[i].values, batch.column(1)[i].values
                q_ids, r_ids = qs.field("q"), rs.field("r")
                place = np.empty(len(r_ids), dtype=np.int64)
                place[np.argsort(np.array(r_ids.to_pylist(), dtype=object), kind="stable")] = np.arange(len(r_ids))
                scores = kernel(qs, rs)
                chosen = [best_of_row(row, place, k) for row in scores]
                rows = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
                columns = np.concatenate(chosen) if chosen else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(rows)), r_ids.take(pa.array(columns)), pa.array(scores[rows, columns])], ["q", "r", "score"])

    found = paired(queries, records, query_rows, record_rows).mapInArrow(run, f"q {kinds[0].simpleString()}, r {kinds[1].simpleString()}, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "r")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_kernel(dimensions: int) -> Kernel:
    """Dot products of the column `v`, to twelve digits behind the point."""

    def run(qs: pa.StructArray, rs: pa.StructArray) -> np.ndarray:
        q, r = (x.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions) for x in (qs, rs))
        return np.round(q @ r.T, 12)

    return run


#: Terms that are multiplied at once; bounds the dense matrices of a pair of blocks.
TERM_ROWS = 4_096


def sparse_kernel(digits: int) -> Kernel:
    """Products of the columns `t` (terms by their hashes) and `w` (weights); only positive ones count."""

    def run(qs: pa.StructArray, rs: pa.StructArray) -> np.ndarray:
        def parts(x: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = x.field("t")
            counts = np.diff(t.offsets.to_numpy())
            return np.repeat(np.arange(len(x)), counts), t.flatten().to_numpy(), x.field("w").flatten().to_numpy()

        (q_row, q_term, q_weight), (r_row, r_term, r_weight) = parts(qs), parts(rs)
        terms = np.intersect1d(q_term, r_term)
        scores = np.zeros((len(qs), len(rs)))
        for low in range(0, len(terms), TERM_ROWS):
            some = terms[low : low + TERM_ROWS]

            def matrix(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, some: np.ndarray = some) -> np.ndarray:
                at = np.searchsorted(some, term)
                here = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == term)
                out = np.zeros((n, len(some)))
                out[row[here], at[here]] = weight[here]
                return out

            scores += matrix(q_row, q_term, q_weight, len(qs)) @ matrix(r_row, r_term, r_weight, len(rs)).T
        scores = np.round(scores, digits)
        return np.where(scores > 0, scores, np.nan)

    return run
