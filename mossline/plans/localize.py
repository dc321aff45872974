"""From reports to the files, functions and lines they point to, for all reports at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossline.functions import text as T
from mossline.functions.vectors import dot, top_k, unit_mean
from mossline.operators import code_graph, consensus, retrieval, seeding, traversal
from mossline.plans.providers import encoded, listwise_by_overlap
from mossline.runtime import cut


@dataclass
class Index:
    """Code bases: nodes (repo, node_id, node_type, file_path, name, qualname, start_line, end_line, docstring and maybe code) and edges (repo, src, dst, edge_type).

    concepts: repo, label, member_function_ids, centroid, built_at; statements: repo, node_id, line, text; sizes: repo,
    chars of its outline. Without them there are no concept seeds, lines are those of whole functions, no repository is large.
    """

    nodes: DataFrame
    edges: DataFrame
    concepts: DataFrame | None = None
    statements: DataFrame | None = None
    sizes: DataFrame | None = None


def functions(nodes: DataFrame, code: bool = False) -> DataFrame:
    """repo, file_path, node_id, name, qualname, start_line, end_line, docstring, code, order_key: one row per function of a repository, in order of declaration; code is null unless asked for."""
    rows = nodes.filter("node_type = 'function' and node_id is not null")
    if not code or "code" not in nodes.columns:
        rows = rows.withColumn("code", F.lit(None).cast("string"))
    own = ["file_path", "name", "qualname", "start_line", "end_line", "docstring", "code"]
    if "ingested_at" in nodes.columns:
        rows = rows.groupBy("repo", "node_id").agg(F.max_by(F.struct(*own), F.struct("ingested_at", "start_line")).alias("n")).select("repo", "node_id", "n.*")
    return rows.select("repo", "file_path", "node_id", "name", "qualname", "start_line", "end_line", "docstring", "code", F.coalesce("start_line", F.lit(0)).alias("order_key"))


def reports(issues: DataFrame) -> DataFrame:
    """instance_id, repo, text, symptoms: one row per instance, that created last."""
    last = F.max_by(F.struct("repo", "problem_statement"), F.struct("created_at", "problem_statement")).alias("r")
    rows = issues.filter("instance_id is not null").groupBy("instance_id").agg(last).select("instance_id", "r.repo", F.coalesce("r.problem_statement", F.lit("")).alias("text"))
    return rows.withColumn("symptoms", T.extracted_symptoms(F.col("text")))


#: Numbers of a vector, and characters that are encoded of a function and of a candidate of the pool.
DIMENSIONS, FUNCTION_CHARS, POOL_CHARS = 128, 4_000, 600
#: First files whose functions may join the pool, length of the head that is ordered anew, concepts whose members are seeds.
POOL_FILES, HEAD, CONCEPTS = 3, 10, 3


def distinct_variants(asked: DataFrame, runs: int) -> DataFrame:
    """instance_id, repo, run, runs, text: what each report looks like to its runs; runs that see the same text are one, of the first one's number."""
    each = asked.select("instance_id", "repo", "text", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("_r"))
    seen = each.withColumn("_t", T.run_variant(F.col("text"), F.col("_r")))
    return seen.groupBy("instance_id", "repo", F.col("_t").alias("text")).agg(F.min("_r").alias("run"), F.sort_array(F.collect_list("_r")).alias("runs"))


def function_text(chars: int) -> Column:
    """Name, summary and code of a function, cut to so many characters; what is encoded of it."""
    return F.substring(F.concat_ws("\n", "qualname", F.coalesce("docstring", F.lit("")), F.coalesce("code", F.lit(""))), 1, chars)


def pool_text() -> Column:
    return F.concat_ws("\n", "qualname", F.coalesce("docstring", F.lit("")), F.substring(F.coalesce("code", F.lit("")), 1, POOL_CHARS))


def nearness(files: DataFrame, known: DataFrame, queries: DataFrame) -> DataFrame:
    """instance_id, run, repo, file_path, rank, node_id, order_key: functions of each run's files, the nearest to its report with the smallest key."""
    inside = files.join(known.select("repo", "file_path", "node_id"), ["repo", "file_path"])
    vectors = encoded(known.join(files.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi").select("repo", "node_id", pool_text().alias("text")), key=["repo", "node_id"], dimensions=DIMENSIONS)
    met = inside.join(vectors, ["repo", "node_id"]).join(queries.select("instance_id", "run", F.col("vector").alias("_q")), "instance_id")
    return met.select("instance_id", "run", "repo", "file_path", "rank", "node_id", (-F.round(dot(F.col("vector"), F.col("_q")), 6)).alias("order_key"))


def concept_seeds(concepts: DataFrame, known: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """instance_id, run, node_id: members of the concepts of the report's repository that are nearest to the run's report.

    A concept's centroid is the mean of its members' vectors, so it lies in the encoder's space. Of its members, those of the
    smallest ids are enough: no more can be among the seeds.
    """
    edges = cut(code_graph.concept_graph(concepts, known)[1].withColumn("concept", F.xxhash64("repo", "dst")))
    members = edges.select("repo", "concept", F.col("src").alias("node_id"))
    centroids = cut(unit_mean(members.join(vectors, ["repo", "node_id"]), group="concept", vector="vector", dimensions=DIMENSIONS).join(edges.select("repo", "concept").distinct(), "concept"))
    case = F.struct("instance_id", "run").alias("case")
    nearest = top_k(queries.select("repo", case, "vector"), centroids, CONCEPTS, query_id="case", record_id="concept", query_vector="vector", record_vector="centroid", dimensions=DIMENSIONS, scope="repo")
    leading = members.withColumn("_n", F.row_number().over(Window.partitionBy("concept").orderBy("node_id"))).filter(F.col("_n") <= seeding.SEED_CAP)
    matched = seeding.concept_matches(nearest.select(F.col("case").alias("instance_id"), F.col("concept").alias("concept_id")), leading.select(F.col("concept").alias("concept_id"), "node_id"))
    return matched.select("instance_id.*", "node_id")


def seeds_of_runs(asked: DataFrame, variants: DataFrame, known: DataFrame, near: DataFrame, files: DataFrame, concept: DataFrame | None) -> DataFrame:
    """instance_id, repo, run, node_id, prior, provenance, rank: the seeds of each run. Frames and literals are those of the report, the rest depends on the run."""
    case = F.struct("instance_id", "run").alias("instance_id")
    numbers = variants.select("instance_id", "run")
    own_files = files.join(numbers, "instance_id").select(case, case.alias("repo"), "file_path", "rank")
    functions = near.select(case.alias("repo"), "file_path", "node_id", "order_key")
    per_run = lambda frame: frame.join(numbers, "instance_id").select(case, "node_id")
    found = seeding.seeds(
        stack=per_run(seeding.stack_matches(asked, known)), literal=per_run(seeding.literal_matches(asked, known, seeding.SEED_CAP)), files=seeding.file_matches(own_files, functions),
        concept=concept.select(case, "node_id") if concept is not None else None,
    )
    return found.select("instance_id.*", "node_id", "prior", "provenance", "rank").join(asked.select("instance_id", "repo"), "instance_id")


def pooled_and_reranked(found: DataFrame, variants: DataFrame, files: DataFrame, near: DataFrame, vectors: DataFrame) -> DataFrame:
    """instance_id, run, node_id, score, rank (from 0): each run's functions and the nearest of its first files, by their vectors and its report with the chains found.

    Instance and run together stand for the instance of the operators of `consensus`.
    """
    case = F.struct("instance_id", "run").alias("instance_id")
    chains = found.groupBy("instance_id", "run").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chain"))), lambda c: F.coalesce(c["chain"], F.array().cast("array<string>")))).alias("chains"))
    texts = variants.join(chains, ["instance_id", "run"], "left").select(case, consensus.augmented_query(F.col("text"), F.coalesce("chains", F.array().cast("array<string>"))).alias("text"))
    asked = encoded(texts, key="instance_id", dimensions=DIMENSIONS).withColumnRenamed("vector", "query")
    searched = found.select(case, "node_id", "rank")
    first = files.filter(F.col("rank") < POOL_FILES).join(variants.select("instance_id", "run"), "instance_id").select(case, case.alias("repo"), "file_path", "rank")
    pool = consensus.extended_pool(searched, first, near.select(case.alias("repo"), "file_path", "node_id", "order_key"), top_files=POOL_FILES)
    placed = pool.join(searched, ["instance_id", "node_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(1_000_000))).select("instance_id.*", "node_id", "rank")
    owned = placed.join(variants.select("instance_id", "run", "repo"), ["instance_id", "run"]).join(vectors, ["repo", "node_id"], "left")
    return consensus.reranked(owned.select(case, "node_id", "vector", "rank").join(asked, "instance_id"), key="node_id").select("instance_id.*", "node_id", "score", "rank")


def listwise(ranked: DataFrame, variants: DataFrame, known: DataFrame) -> DataFrame:
    """instance_id, run, node_id, score, rank: the head of each run's ranking in the order that the stand-in for a model gives."""
    case = F.struct("instance_id", "run").alias("instance_id")
    head = ranked.filter(F.col("rank") < HEAD).join(variants.select("instance_id", "run", "repo", "text"), ["instance_id", "run"])
    named = head.join(known.select("repo", "node_id", F.concat_ws(" ", "qualname", "docstring").alias("name")), ["repo", "node_id"])
    ordered = listwise_by_overlap(named.select(case, "node_id", "rank", "name", "text"))
    return consensus.merged_head(ranked.select(case, "node_id", "score", "rank"), ordered, key="node_id", head=HEAD).select("instance_id.*", "node_id", "score", "rank")


def localize(issues: DataFrame, rankings: DataFrame, index: Index, *, runs: int = 3, limits: traversal.Limits = traversal.Limits(), details: dict | None = None) -> DataFrame:
    """instance_id, function_key, score, appearances, label, rank, start_line, end_line, chain: functions that each report points to, after a vote of `runs` searches.

    Each run has its own variant of the report, which decides its seeds, scores, pool and order; the lines of a function,
    those of the statements drilled into or all of its own, and its chain are from the last run that has it. Without a
    model there are no paraphrases, so runs from the third on see the report as it is. An instance without any candidate
    gives no row. `details`, if given, takes the results of the searches under "searches".
    """
    asked = cut(reports(issues))
    known = cut(functions(index.nodes, code=True))
    variants = cut(distinct_variants(asked, runs))
    queries = cut(encoded(variants, key=["instance_id", "repo", "run"], dimensions=DIMENSIONS))
    vectors = cut(encoded(known.select("repo", "node_id", function_text(FUNCTION_CHARS).alias("text")), key=["repo", "node_id"], dimensions=DIMENSIONS))
    fused = retrieval.penalised(retrieval.reciprocal_ranks(retrieval.list_positions(rankings)), 20) if index.sizes is None else retrieval.prefiltered(rankings, index.sizes)
    files = cut(fused.join(asked.select("instance_id", "repo"), "instance_id").select("instance_id", "repo", "file_path", "rank"))
    near = cut(nearness(files, known, queries))
    concept = concept_seeds(index.concepts, known, vectors, queries) if index.concepts is not None else None
    seeds = cut(seeds_of_runs(asked, variants, known, near, files, concept))
    found = cut(traversal.traversed(seeds, index.edges, vectors=vectors, queries=queries, limits=limits))
    if details is not None:
        details["searches"] = found
    ranked = cut(listwise(cut(pooled_and_reranked(found, variants, files, near, vectors)), variants, known))
    return voted(found, ranked, variants, known, index.statements, queries, runs)


def voted(found: DataFrame, ranked: DataFrame, variants: DataFrame, known: DataFrame, statements: DataFrame | None, queries: DataFrame, runs: int) -> DataFrame:
    """The vote over all runs, with lines and chains."""
    case = F.struct("instance_id", "run").alias("instance_id")
    spans = ranked.join(variants.select("instance_id", "run", "repo"), ["instance_id", "run"]).join(known.select("repo", "node_id", F.concat_ws("::", "file_path", "qualname").alias("function_key"), "start_line", "end_line"), ["repo", "node_id"])
    drilled = found.limit(0).select(case, "node_id", F.lit(0).alias("line"))
    if statements is not None:
        searched = found.join(variants.select("instance_id", "run", "repo"), ["instance_id", "run"])
        drilled = traversal.drilled_lines(searched, statements, queries, encode=lambda s: encoded(s, key=["repo", "node_id", "line"], dimensions=DIMENSIONS)).select(case, "node_id", "line")
    lines = consensus.suspect_lines(spans.select(case, "node_id", "start_line", "end_line"), drilled).select("instance_id.*", "node_id", "start_line", "end_line")
    whole = spans.drop("start_line", "end_line").join(lines, ["instance_id", "run", "node_id"]).join(found.select("instance_id", "run", "node_id", "chain"), ["instance_id", "run", "node_id"], "left")
    every = cut(whole.join(variants.select("instance_id", "run", F.explode("runs").alias("_run")), ["instance_id", "run"]).select("instance_id", F.col("_run").alias("run"), "rank", "function_key", "score", "start_line", "end_line", "chain"))
    last = every.groupBy("instance_id", "function_key").agg(F.max_by(F.struct("start_line", "end_line", "chain"), F.struct("run", -F.col("rank"))).alias("_l"))
    return consensus.vote(every, runs, key="function_key").join(last, ["instance_id", "function_key"]).select("instance_id", "function_key", "score", "appearances", "label", "rank", "_l.start_line", "_l.end_line", "_l.chain")
