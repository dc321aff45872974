"""Queries of the llm operators over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossline.llm import clusters, docpairs, mixing, quality, ranking, splitting, tokens
from mossline.runtime import cut, table

#: Every list counts alike.
LISTS = {"bm25": 1.0, "dense": 1.0, "llm": 1.0}


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "concepts")
    return clusters.described(cut(clusters.concept_clusters(concepts)), concepts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.pairs_of(cut(clusters.concept_clusters(table(spark, sf_dir, "concepts"))))


def _long_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_latest(table(spark, sf_dir, "nodes"), key="node_id", text="code", at="ingested_at", limit=splitting.LIMIT)


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(_long_codes(spark, sf_dir), key="node_id", text="code")


def p4_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, code of every long code, put together from its pieces."""
    return splitting.rebuilt(p4_pieces(spark, sf_dir), key="node_id", text="code")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_offsets(_long_codes(spark, sf_dir), key="node_id", text="code")
    return pieces.groupBy("node_id").agg((F.max("longest_line") > splitting.LIMIT).cast("int").alias("forced"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf_dir, "source_files"), keys=["repo", "file_path"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("repo", "file_path", "qualname", "start_line")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = table(spark, sf_dir, "rankings").select("instance_id", "retriever", "rank", "score", ranking.root_relative(F.col("file_path")).alias("file_path"))
    return ranking.fused_scores(rankings, LISTS)


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.positions(cut(_fused(spark, sf_dir)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_items(_fused(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of every document after encoding and decoding: null comes back as an empty text."""
    return tokens.decoded_texts(tokens.token_ids(table(spark, sf_dir, "documents")))


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(tokens.token_counts(table(spark, sf_dir, "documents"), keep=["doc_id", "source"]))
    return mixing.mixed(sizes, table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares_reached(_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, max_repeats, within_cap, near_target: whether the mix keeps to the caps and, among sources with records, to the shares within 0.02 or two blocks."""
    reached = cut(p8_shares(spark, sf_dir))
    live = reached.filter("n_records > 0").agg(F.sum("target_share").alias("_live"), F.sum("mixed_tokens").alias("_mixed"))
    wanted = F.when(F.col("n_records") > 0, F.col("target_share") / F.col("_live")).otherwise(0.0)
    return reached.crossJoin(live).select("source", F.col("max_repeats").cast("int").alias("max_repeats"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("reached_share") - wanted) < 0.02 + 2 * mixing.BLOCK_TOKENS / F.col("_mixed")).alias("near_target"))


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.quality(table(spark, sf_dir, "documents"))
    return stats.select("doc_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in quality.COLUMNS], "kind")


def p9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the statistics those that SQL can count."""
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "n_words", "n_lines", "longest_word")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).filter("kind <> ''").select("doc_id", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_clusters, p4_found, p4_pieces, p4_rebuilt, p5_found, p5_pairs, p6_found, p6_ranking, p7_ids, p7_decoded, p8_mix, p8_shares, p8_kept, p9_found, p9_counts, p9_stats)
}
