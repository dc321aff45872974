"""The typed graph of a code base: nodes and edges from skeletons, call resolution, inheritance, and lookups by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossline.functions import text as T

EDGE = ["repo", "src", "dst", "edge_type"]


def functions_of(skeletons: DataFrame) -> DataFrame:
    """repo, file_path, class, name, qualname, start_line, end_line, docstring, signature, decl: methods and module functions in order."""
    methods = skeletons.select("repo", "file_path", F.posexplode("classes").alias("ci", "c")).select("repo", "file_path", F.col("c.name").alias("class"), "ci", F.posexplode("c.methods").alias("fi", "f"))
    free = skeletons.select("repo", "file_path", F.lit(None).cast("string").alias("class"), F.lit(-1).alias("ci"), F.posexplode("functions").alias("fi", "f"))
    order = Window.partitionBy("repo", "file_path").orderBy("ci", "fi")
    return methods.union(free).select("repo", "file_path", "class", "f.*", F.row_number().over(order).alias("decl"))


def graph_nodes(skeletons: DataFrame) -> DataFrame:
    """repo, node_id, node_type, name, file_path, qualname, start_line, end_line, docstring."""
    none = lambda kind: F.lit(None).cast(kind)
    dirs = skeletons.select("repo", F.explode(T.ancestor_dirs(F.col("file_path"))).alias("d")).distinct()
    dirs = dirs.select("repo", T.node_id("dir", F.col("d")).alias("node_id"), F.lit("directory").alias("node_type"), T.last_part(F.col("d"), "/").alias("name"), F.col("d").alias("file_path"), none("string").alias("qualname"), none("int").alias("start_line"), none("int").alias("end_line"), F.lit("").alias("docstring"))
    files = skeletons.select("repo", T.node_id("file", F.col("file_path")), F.lit("file"), T.last_part(F.col("file_path"), "/"), "file_path", none("string"), F.lit(1), "n_lines", F.lit(""))
    classes = skeletons.select("repo", "file_path", F.explode("classes").alias("c"))
    classes = classes.select("repo", T.node_id("class", F.col("file_path"), F.col("c.name")), F.lit("class"), "c.name", "file_path", "c.name", "c.start_line", "c.end_line", "c.docstring")
    functions = functions_of(skeletons).select("repo", T.node_id("func", F.col("file_path"), F.col("qualname")), F.lit("function"), "name", "file_path", "qualname", "start_line", "end_line", "docstring")
    return dirs.union(files).union(classes).union(functions).dropDuplicates(["repo", "node_id"])


def contain_edges(skeletons: DataFrame) -> DataFrame:
    """Directory to directory, file, class and function, each to what lies directly in it."""
    f = F.col("file_path")
    paths = skeletons.select("repo", "file_path", T.ancestor_dirs(f).alias("d"))
    dirs = paths.select("repo", F.explode(F.expr("transform(slice(d, 2, size(d)), (x, i) -> struct(d[i] as a, x as b))")).alias("e")).select("repo", T.node_id("dir", F.col("e.a")).alias("src"), T.node_id("dir", F.col("e.b")).alias("dst")).distinct()
    files = paths.filter("size(d) > 0").select("repo", T.node_id("dir", F.element_at("d", -1)), T.node_id("file", f))
    classes = skeletons.select("repo", "file_path", F.explode("classes").alias("c")).select("repo", T.node_id("file", f), T.node_id("class", f, F.col("c.name")))
    functions = functions_of(skeletons).select("repo", F.when(F.col("class").isNull(), T.node_id("file", f)).otherwise(T.node_id("class", f, F.col("class"))), T.node_id("func", f, F.col("qualname")))
    return dirs.union(files).union(classes).union(functions).distinct().withColumn("edge_type", F.lit("contain"))


def import_edges(skeletons: DataFrame) -> DataFrame:
    """File to the file that an import names, kept only if the repository has it."""
    statements = skeletons.select("repo", F.col("file_path").alias("f"), F.explode("imports").alias("i"))
    wanted = statements.select("repo", "f", T.import_path(F.col("i")).alias("file_path")).filter("file_path is not null").distinct()
    return wanted.join(skeletons.select("repo", "file_path"), ["repo", "file_path"], "left_semi").select("repo", T.node_id("file", F.col("f")).alias("src"), T.node_id("file", F.col("file_path")).alias("dst"), F.lit("import").alias("edge_type"))


def inherit_edges(classes: DataFrame) -> DataFrame:
    """repo, src, dst: class to every other class of the repository with the short name of one of its bases.

    classes: repo, node_id, name, bases. Names are looked up by an equi-join on repository and name.
    """
    bases = classes.select("repo", F.col("node_id").alias("src"), F.explode("bases").alias("b")).select("repo", "src", T.last_part(F.trim("b")).alias("name")).filter("name <> ''").distinct()
    return bases.join(classes.select("repo", "name", F.col("node_id").alias("dst")), ["repo", "name"]).filter("src <> dst").select("repo", "src", "dst").distinct()


def unambiguous(functions: DataFrame) -> DataFrame:
    """repo, name, node_id: short names that a single function of the repository has."""
    return functions.groupBy("repo", "name").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("node_id")).filter("n = 1").select("repo", "name", "node_id")


def call_edges(skeletons: DataFrame) -> DataFrame:
    """repo, src, dst, line (of the last one): resolved calls, by name in the same file (smallest qualified name), else a module function of a name that is unique in the repository."""
    functions = functions_of(skeletons).select("repo", "file_path", "name", "qualname", "class", T.node_id("func", F.col("file_path"), F.col("qualname")).alias("node_id"))
    calls = skeletons.select("repo", "file_path", F.explode("calls").alias("c")).select("repo", "file_path", T.node_id("func", F.col("file_path"), F.col("c.caller")).alias("src"), T.last_part(F.col("c.callee")).alias("name"), F.col("c.line").alias("line"))
    calls = calls.join(functions.select("repo", F.col("node_id").alias("src")), ["repo", "src"], "left_semi")
    here = functions.groupBy("repo", "file_path", "name").agg(F.min_by("node_id", "qualname").alias("here"))
    single = unambiguous(functions).join(functions.filter("class is null").select("repo", "node_id"), ["repo", "node_id"], "left_semi").select("repo", "name", F.col("node_id").alias("there"))
    resolved = calls.join(here, ["repo", "file_path", "name"], "left").join(single, ["repo", "name"], "left").withColumn("dst", F.coalesce("here", "there")).filter("dst is not null and dst <> src")
    return resolved.groupBy("repo", "src", "dst").agg(F.max("line").alias("line"))


def structural_edges(skeletons: DataFrame) -> DataFrame:
    """repo, src, dst, edge_type, line: contain, import, inherit and invoke edges, unique by ends and type."""
    classes = skeletons.select("repo", "file_path", F.explode("classes").alias("c")).select("repo", T.node_id("class", F.col("file_path"), F.col("c.name")).alias("node_id"), "c.name", "c.bases")
    plain = contain_edges(skeletons).select(*EDGE).union(import_edges(skeletons).select(*EDGE)).union(inherit_edges(classes).withColumn("edge_type", F.lit("inherit")).select(*EDGE))
    invoke = call_edges(skeletons).select("repo", "src", "dst", F.lit("invoke").alias("edge_type"), "line")
    return plain.withColumn("line", F.lit(None).cast("int")).union(invoke)


def commit_nodes(commits: DataFrame, message_chars: int = 500) -> DataFrame:
    """repo, node_id, name, message, authored_at: a node for every commit, whether its files are kept or not."""
    return commits.select("repo", T.node_id("commit", F.col("sha")).alias("node_id"), F.substring("sha", 1, 12).alias("name"), F.substring(F.coalesce("message", F.lit("")), 1, message_chars).alias("message"), "authored_at")


def concept_graph(concepts: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: repo, node_id, name, centroid, n_members), (edges: repo, src, dst): concepts of a repository with equal labels are one node, the last centroid counts.

    concepts: repo, label, member_function_ids, centroid, built_at; functions: repo, node_id. Members that aren't functions
    of the repository's graph give no edge.
    """
    named = concepts.filter("label is not null and label <> ''")
    nodes = named.groupBy("repo", "label").agg(F.max_by(F.struct("centroid", "member_function_ids"), "built_at").alias("c")).select("repo", T.node_id("concept", F.col("label")).alias("node_id"), F.col("label").alias("name"), "c.centroid", F.size(F.coalesce("c.member_function_ids", F.array())).alias("n_members"))
    edges = named.select("repo", "label", F.explode("member_function_ids").alias("m")).filter(F.col("m").contains("::")).select("repo", T.node_id("func", F.col("m")).alias("src"), T.node_id("concept", F.col("label")).alias("dst")).distinct()
    return nodes, edges.join(functions.select("repo", F.col("node_id").alias("src")).distinct(), ["repo", "src"], "left_semi")


def contain_edges_of(nodes: DataFrame) -> DataFrame:
    """repo, src, dst: the class or file that each class and function of a node table lies in. nodes: repo, node_id, node_type, file_path, qualname."""
    known = nodes.select("repo", "node_id").distinct()
    inner = nodes.filter("node_type in ('class', 'function')").select("repo", F.col("node_id").alias("dst"), "file_path", F.expr("nullif(regexp_extract(qualname, '^(.*)[.][^.]*$', 1), '')").alias("owner")).distinct()
    classes = known.select("repo", F.col("node_id").alias("_class"))
    placed = inner.withColumn("_class", T.node_id("class", F.col("file_path"), F.col("owner"))).join(classes.withColumn("_known", F.lit(True)), ["repo", "_class"], "left")
    return placed.select("repo", F.when(F.col("owner").isNotNull() & F.col("_known"), F.col("_class")).otherwise(T.node_id("file", F.col("file_path"))).alias("src"), "dst").distinct()


def file_of(functions: DataFrame, contain: DataFrame) -> DataFrame:
    """repo, node_id, file: the file around each function, one contain edge up, or two where a class lies between.

    functions: repo, node_id; contain: repo, src, dst. A function with neither gives no row.
    """
    first = functions.select("repo", "node_id").distinct().join(contain.select("repo", F.col("dst").alias("node_id"), F.col("src").alias("_up")), ["repo", "node_id"])
    second = first.join(contain.select("repo", F.col("dst").alias("_up"), F.col("src").alias("_file")), ["repo", "_up"], "left")
    place = F.when(F.col("_up").startswith("file::"), F.col("_up")).otherwise(F.col("_file"))
    return second.select("repo", "node_id", place.alias("file")).filter(F.col("file").startswith("file::")).distinct()


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as parquet, in folders by repository and type; each folder's rows are gathered first, in several tasks where they are many."""
    nodes.hint("rebalance", "repo", "node_type").write.mode("overwrite").partitionBy("repo", "node_type").parquet(f"{path}/nodes")
    edges.hint("rebalance", "repo", "edge_type").write.mode("overwrite").partitionBy("repo", "edge_type").parquet(f"{path}/edges")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); filters on repository and type read their folders only."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


LINE_BUCKET = 256


def enclosing(lines: DataFrame, spans: DataFrame, *, keys: list[str], line: str = "line") -> DataFrame:
    """The rows of `lines` with the node_id of the innermost span around each line; lines in no span are left out.

    lines: keys, line and any others; spans: keys, node_id, start_line, end_line. Spans are cut into buckets of lines, so
    the containment is checked within one bucket of one file and a single vast file spreads over many.
    """
    own = [c for c in lines.columns if c not in keys]
    left = lines.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in own], F.floor(F.col(line) / LINE_BUCKET).alias("_b"))
    right = spans.select(*keys, "node_id", "start_line", "end_line").filter("start_line <= end_line").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / LINE_BUCKET), F.floor(F.col("end_line") / LINE_BUCKET))))
    inside = left.join(right, [*keys, "_b"]).filter((F.col(f"_l_{line}") >= F.col("start_line")) & (F.col(f"_l_{line}") <= F.col("end_line")))
    best = inside.groupBy(*keys, *[f"_l_{c}" for c in own]).agg(F.max_by("node_id", F.struct("start_line", -F.col("end_line"), "node_id")).alias("node_id"))
    return best.select(*keys, *[F.col(f"_l_{c}").alias(c) for c in own], "node_id")


def def_use(statements: DataFrame, *, keys: list[str]) -> DataFrame:
    """keys, var, def_line, use_line: each use linked to the nearest earlier statement that defined the variable.

    statements: keys, ix (order in the function), line, defs, uses. A statement's own definition doesn't serve its uses.
    """
    marks = statements.select(*keys, "ix", "line", F.explode(F.array_distinct(F.concat("defs", "uses"))).alias("var"), "defs", "uses")
    order = Window.partitionBy(*keys, "var").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.array_contains("defs", F.col("var")), F.col("line")), ignorenulls=True).over(order)
    return marks.withColumn("def_line", last).filter(F.array_contains("uses", F.col("var")) & F.col("def_line").isNotNull()).select(*keys, "var", "def_line", F.col("line").alias("use_line")).distinct()


def reached(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """start, node, distance: nodes within `hops` edges of each start, at their least distance. edges: src, dst; seeds: start."""
    from mossline.runtime import cut

    seen = seeds.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        ahead = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen
