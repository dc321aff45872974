"""Where to begin looking: seeds from stack frames, literals, concepts and pre-filtered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossline.functions import text as T
from mossline.operators.retrieval import decayed_budget, decayed_prior
from mossline.runtime import cut

# Priors of the sources, in their order of precedence, and how many seeds a search starts from.
PRIORS = {"stack": 1.0, "literal": 0.8, "concept": 0.5, "memory": 0.4, "stage1": None}
SEED_CAP = 30


def stack_matches(symptoms: DataFrame, functions: DataFrame) -> DataFrame:
    """instance_id, node_id: functions that a stack frame names by file, last part of the name, and a line within.

    symptoms: instance_id, repo, symptoms; functions: repo, file_path, node_id, qualname, start_line, end_line. The
    range condition stands on a hash join by repository, file and name.
    """
    frames = symptoms.select("instance_id", "repo", F.explode("symptoms.stack_frames").alias("f")).select("instance_id", "repo", F.col("f.file").alias("file_path"), F.col("f.func").alias("name"), F.col("f.line").alias("line"))
    named = functions.select("repo", "file_path", "node_id", T.last_part(F.col("qualname")).alias("name"), "start_line", "end_line")
    return frames.join(named, ["repo", "file_path", "name"]).filter("start_line <= line and line <= end_line").select("instance_id", "node_id").distinct()


#: Characters of the pieces by which keywords and texts meet.
GRAM = 3


def grams(text: Column, least: int) -> Column:
    """The distinct pieces of `least` to three characters of a text."""

    def pieces(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*[pieces(n) for n in range(least, GRAM + 1)])))


def literal_matches(symptoms: DataFrame, functions: DataFrame, first: int | None = None) -> DataFrame:
    """instance_id, node_id: functions whose name and docstring contain a keyword of the instance.

    With `first`, of each keyword only so many functions of the smallest ids: seeds of one source and prior go by their
    ids, so no other can be among as many seeds, and a keyword that all functions have stays small. Keywords are compared once per repository, however many instances share them. A keyword meets the texts that have its
    rarest piece of three characters (or itself, if it is shorter), by an equi-join on repository and piece, and is then
    looked for in them.
    """
    asked = cut(symptoms.select("instance_id", "repo", F.explode(F.array_distinct(F.transform(T.symptom_keywords(F.col("symptoms")), F.lower))).alias("keyword")))
    hay = functions.select("repo", "node_id", F.lower(F.concat_ws(" ", F.coalesce("qualname", F.lit("")), F.coalesce("docstring", F.lit("")))).alias("hay"))
    least = min(GRAM, asked.agg(F.min(F.length("keyword"))).first()[0] or GRAM)
    keywords = asked.select("repo", "keyword").distinct()
    own_grams = F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(grams(F.col("keyword"), GRAM))
    parts = keywords.select("repo", "keyword", F.size(own_grams).alias("_n"), F.explode(own_grams).alias("gram"))
    held = cut(hay.select("repo", "node_id", F.explode(grams(F.col("hay"), least)).alias("gram")).join(parts.select("repo", "gram").distinct(), ["repo", "gram"], "left_semi"))
    met = parts.join(held.groupBy("repo", "gram").count(), ["repo", "gram"]).groupBy("repo", "keyword", "_n").agg(F.count(F.lit(1)).alias("_m"), F.min(F.struct("count", "gram")).alias("_g"))
    rarest = met.filter("_m = _n").select("repo", "keyword", F.col("_g.gram").alias("gram"))
    found = rarest.join(held, ["repo", "gram"]).join(hay, ["repo", "node_id"]).filter(F.col("hay").contains(F.col("keyword"))).select("repo", "keyword", "node_id")
    if first:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("repo", "keyword").orderBy("node_id"))).filter(F.col("_n") <= first).drop("_n")
    return asked.join(found, ["repo", "keyword"]).select("instance_id", "node_id").distinct()


def concept_matches(nearest: DataFrame, members: DataFrame) -> DataFrame:
    """instance_id, node_id: the member functions of an instance's nearest concepts. nearest: instance_id, concept_id; members: concept_id, node_id."""
    return nearest.join(members, "concept_id").select("instance_id", "node_id").distinct()


def file_matches(files: DataFrame, functions: DataFrame) -> DataFrame:
    """instance_id, node_id, prior: of each file the first functions, fewer and with a smaller prior the lower its rank.

    files: instance_id, repo, file_path, rank (from 0); functions: repo, file_path, node_id, order_key.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("instance_id"))
    ranked = files.withColumn("_n", n)
    order = Window.partitionBy("instance_id", "file_path").orderBy("order_key", "node_id")
    prior = T.test_penalty(decayed_prior(F.col("rank"), F.col("_n")), F.col("file_path"))
    return (
        ranked.join(functions.select("repo", "file_path", "node_id", "order_key"), ["repo", "file_path"])
        .withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= decayed_budget(F.col("rank")))
        .select("instance_id", "node_id", F.round(prior, 6).alias("prior"))
    )


def seeds(*, stack: DataFrame, literal: DataFrame, files: DataFrame, concept: DataFrame | None = None, memory: DataFrame | None = None, cap: int = SEED_CAP) -> DataFrame:
    """instance_id, node_id, prior, provenance, rank (from 1): the best seed of each node, at most `cap` an instance.

    Equal priors of a node go to the earlier source, equal priors of nodes to the earlier source and then the smaller id.
    """
    sources = {"stack": stack, "literal": literal, "concept": concept, "memory": memory}
    rows = files.select("instance_id", "node_id", "prior", F.lit("stage1").alias("provenance"))
    for name, frame in sources.items():
        if frame is not None:
            rows = rows.union(frame.select("instance_id", "node_id", F.lit(PRIORS[name]), F.lit(name)))
    place = F.create_map(*[F.lit(x) for i, name in enumerate(PRIORS) for x in (name, -i)])[F.col("provenance")]
    best = rows.groupBy("instance_id", "node_id").agg(F.max(F.struct("prior", place.alias("place"), "provenance")).alias("b"))
    order = Window.partitionBy("instance_id").orderBy(F.desc("b.prior"), F.desc("b.place"), "node_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select("instance_id", "node_id", "b.prior", "b.provenance", "rank")


def symptom_nodes(symptoms: DataFrame) -> DataFrame:
    """instance_id, node_id, label, kind: one node per label, of the first kind that has it."""
    kinds = (("exception_types", "exception"), ("error_messages", "error_msg"), ("behaviors", "behavior"), ("api_calls_named", "api"))

    def labelled(order: int, field: str, kind: str):
        return F.transform(F.col(f"symptoms.{field}"), lambda x: F.struct(F.lit(order).alias("o"), F.lit(kind).alias("kind"), x.alias("label")))

    rows = symptoms.select("instance_id", F.explode(F.concat(*[labelled(i, *k) for i, k in enumerate(kinds)])).alias("s"))
    first = rows.filter("s.label is not null and s.label <> ''").groupBy("instance_id", "s.label").agg(F.min_by("s.kind", "s.o").alias("kind"))
    return first.select("instance_id", T.node_id("symptom", F.col("kind"), F.col("label")).alias("node_id"), "label", "kind")
