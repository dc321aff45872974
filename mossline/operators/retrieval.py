"""Lexical and fused retrieval: BM25, reciprocal ranks, the pre-filter that chooses between them, outline budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossline.functions import blocks
from mossline.functions import text as T
from mossline.runtime import cut

#: Texts of a block: one may have some thousand terms.
TEXT_ROWS = 512
# Constants of BM25, fusion constant and the weight of each list, lengths that decide whether a repository is large.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, LIST_WEIGHTS = 60, {"llm": 1.0, "bm25": 0.7, "dense": 0.7}
OUTLINE_CHARS, POOL_FACTOR, POOL_FILES = 600_000, 5, 100


def postings(documents: DataFrame, *, scope: str, key: str, text: str, tokenizer=T.identifiers) -> DataFrame:
    """scope, term, key, weight: the score that one occurrence of the term in a query adds to the document.

    Statistics are those of the documents of a scope. A term in more than half of them has a negative inverse frequency;
    it then takes a quarter of the scope's mean, which counts the negative ones. The floor needs one aggregate before the
    weights, a row per scope. Texts are tokenised once. Null keys are dropped, null texts are empty.
    """
    tokens = documents.select(F.col(scope).alias("scope"), F.col(key).alias("doc"), tokenizer(F.col(text)).alias("tokens")).filter("doc is not null")
    counts = cut(tokens.select("scope", "doc", F.size("tokens").alias("len"), F.explode_outer("tokens").alias("term")).groupBy("scope", "doc", "len", "term").agg(F.count(F.lit(1)).alias("tf")))
    sizes = counts.select("scope", "doc", "len").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    counts = counts.filter("term is not null")
    frequencies = counts.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df")).join(sizes, "scope")
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    frequencies = cut(frequencies.select("scope", "term", "avg_len", idf.alias("idf")))
    floors = frequencies.groupBy("scope").agg((EPSILON * F.avg("idf")).alias("floor"))
    lengths = 1 - B + B * F.col("len") / F.col("avg_len")
    weight = F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * lengths)
    return (
        counts.join(frequencies, ["scope", "term"]).join(floors, "scope")
        .select(F.col("scope").alias(scope), "term", F.col("doc").alias(key), weight.alias("weight"))
    )


def bm25(queries: DataFrame, index: DataFrame, k: int, *, scope: str, query: str, text: str, key: str, tokenizer=T.identifiers) -> DataFrame:
    """query, key, score, rank (from 1): the k best documents of the query's scope, of those only with a positive score.

    A term counts as often as the query has it. Ties go to the smaller key. Queries and documents are multiplied as sparse
    vectors in pairs of blocks, so a term that all of a scope's documents have is no key of a join; terms are told apart
    by hashes of 64 bits.
    """
    counted = F.col("count").cast("double")
    terms = queries.select(F.col(scope).alias("scope"), F.col(query).alias("q"), F.explode(tokenizer(F.col(text))).alias("term")).groupBy("scope", "q", "term").count()
    asked = terms.groupBy("scope", "q").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), counted.alias("w"))).alias("x"))
    known = index.groupBy(F.col(scope).alias("scope"), F.col(key).alias("r")).agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("weight").alias("w"))).alias("x"))
    found = blocks.best(asked.select("scope", "q", "x.t", "x.w"), known.select("scope", "r", "x.t", "x.w"), k, blocks.sparse_kernel(6), query_rows=TEXT_ROWS, record_rows=TEXT_ROWS)
    return found.select(F.col("q").alias(query), F.col("r").alias(key), "score", "rank")


def list_positions(rankings: DataFrame) -> DataFrame:
    """instance_id, retriever, file_path, score, position: places in each list from 0, by rank, then score, then path."""
    once = rankings.select("instance_id", "retriever", "file_path", "rank", F.when(~F.isnan("score"), F.col("score")).alias("score")).filter("instance_id is not null and file_path is not null").distinct()
    order = Window.partitionBy("instance_id", "retriever").orderBy(F.asc_nulls_last("rank"), F.desc_nulls_last("score"), "file_path")
    return once.select("instance_id", "retriever", "file_path", "score", (F.row_number().over(order) - 1).alias("position"))


def reciprocal_ranks(positions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """instance_id, file_path, score, first_list, first_position: the sum of weight / (60 + position) over all lists.

    A path that a list has twice adds up. first_list and first_position say where the path came up first, lists in the
    order of `weights`; they decide ties.
    """
    weights = weights or LIST_WEIGHTS
    pick = F.create_map(*[F.lit(x) for i, (name, w) in enumerate(weights.items()) for x in (name, F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")))])
    rows = positions.filter(F.col("retriever").isin(*weights)).withColumn("_l", pick[F.col("retriever")])
    return (
        rows.groupBy("instance_id", "file_path")
        .agg(F.round(F.sum(F.col("_l.w") / (RRF_K + F.col("position"))), 9).alias("score"), F.min(F.struct(F.col("_l.i").alias("i"), "position")).alias("_f"))
        .select("instance_id", "file_path", "score", F.col("_f.i").alias("first_list"), F.col("_f.position").alias("first_position"))
    )


def penalised(fused: DataFrame, k: int) -> DataFrame:
    """instance_id, file_path, score, rank (from 0): test files at half their score, cut to k."""
    score = F.round(T.test_penalty(F.col("score"), F.col("file_path")), 9)
    order = Window.partitionBy("instance_id").orderBy(F.desc("score"), "first_list", "first_position", "file_path")
    return fused.withColumn("score", score).withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("instance_id", "file_path", "score", "rank")


def candidate_pool(positions: DataFrame, k: int = POOL_FILES) -> DataFrame:
    """instance_id, file_path: what a model is given to order in a large repository, the union of the first k files of both other lists."""
    return positions.filter(F.col("retriever").isin("bm25", "dense") & (F.col("position") < k)).select("instance_id", "file_path").distinct()


def pooled(positions: DataFrame, k: int) -> DataFrame:
    """The candidates of a large repository: the model's list of the pool alone, or where it is empty both others one after the other."""
    model = positions.filter("retriever = 'llm'").withColumn("score", F.round(1.0 / (RRF_K + F.col("position")), 9))
    rest = positions.filter("retriever in ('bm25', 'dense')").join(model.select("instance_id").distinct(), "instance_id", "left_anti")
    order = Window.partitionBy("instance_id").orderBy(F.desc("score"), "file_path")
    ranked = model.withColumn("score", F.round(T.test_penalty(F.col("score"), F.col("file_path")), 9)).withColumn("rank", F.row_number().over(order) - 1)
    plain = Window.partitionBy("instance_id").orderBy("retriever", "position", "file_path")
    fallback = rest.withColumn("rank", F.row_number().over(plain) - 1).withColumn("score", F.lit(0.0))
    columns = ["instance_id", "file_path", "score", "rank"]
    return ranked.select(*columns).union(fallback.select(*columns)).filter(F.col("rank") < k)


def outline_sizes(outlines: DataFrame, *, scope: str, text: str) -> DataFrame:
    """scope, chars: the length of a scope's outline, two characters between its parts."""
    return outlines.groupBy(scope).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit(""))) + 2).alias("chars"))


def prefiltered(rankings: DataFrame, sizes: DataFrame, *, scope: str = "repo", k: int = 20, limit: int = OUTLINE_CHARS * POOL_FACTOR) -> DataFrame:
    """instance_id, file_path, score, rank: fusion, or for scopes with an outline beyond `limit` the pool.

    Both plans are for all instances at once; which one holds is a column, not a second job. An instance whose scope has
    no known size is taken for a small one.
    """
    modes = rankings.select("instance_id", scope).distinct().join(sizes, scope, "left").groupBy("instance_id").agg(F.max(F.coalesce("chars", F.lit(0)) > limit).alias("large"))
    positions = cut(list_positions(rankings))
    large = cut(modes.filter("large").select("instance_id"))
    fusion = penalised(reciprocal_ranks(positions.join(large, "instance_id", "left_anti")), k)
    return fusion.union(pooled(positions.join(large, "instance_id", "left_semi"), k))


def within_budget(items: DataFrame, *, scope: str, key: str, text: str, budget: int) -> DataFrame:
    """scope, key, running: the items of a scope in the order of their keys up to the first that overruns the budget."""
    sizes = items.select(F.col(scope).alias("s"), F.col(key).alias("k"), (F.length(F.coalesce(F.col(text), F.lit(""))) + 2).alias("n"))
    running = F.sum("n").over(Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("running", running).filter(F.col("running") <= budget).select(F.col("s").alias(scope), F.col("k").alias(key), "running")


def decayed_budget(rank: Column) -> Column:
    """How many functions a file of this rank may give: 8, 6, 4, 3, 2, 2, ..."""
    return F.greatest(F.lit(2), F.ceil(8 * F.exp(-0.4 * rank)).cast("int"))


def decayed_prior(rank: Column, n: Column) -> Column:
    return 0.35 - 0.20 * rank / F.greatest(F.lit(1), n - 1)
