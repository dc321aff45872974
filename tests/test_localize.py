from datetime import datetime

from pyspark.sql import functions as F

from mossline.plans import providers
from mossline.functions import text as T
from mossline.functions.vectors import hashed_vector
from mossline.plans.localize import Index, localize


def test_runs_see_their_own_report_and_pool(spark):
    names = [f"step{chr(97 + i)}" for i in range(8)] + ["broken_parser", "lost_header", "seed"] + [f"other{chr(97 + i)}" for i in range(12)]  # a run takes eleven by similarity, equal ones by name
    nodes = spark.createDataFrame(
        [("r", f"func::a.py::{n}", "function", "a.py", n, n, 10 * i + 1, 10 * i + 5, "") for i, n in enumerate(names)],
        "repo string, node_id string, node_type string, file_path string, name string, qualname string, start_line int, end_line int, docstring string",
    )
    edges = spark.createDataFrame([], "src string, dst string, edge_type string")
    issues = spark.createDataFrame([("i", "r", "broken parser lost header", datetime(2024, 1, 1))], "instance_id string, repo string, problem_statement string, created_at timestamp")
    rankings = spark.createDataFrame([("i", "bm25", "a.py", 1, 1.0)], "instance_id string, retriever string, file_path string, rank int, score double")
    found = {r.function_key: (r.appearances, r.label) for r in localize(issues, rankings, Index(nodes, edges)).collect()}
    assert found["a.py::broken_parser"] == found["a.py::lost_header"] == (3, "high")
    assert found["a.py::seed"] == (1, "low")


def test_vectors_are_those_of_the_hashed_encoder(spark):
    texts = spark.createDataFrame([(1, "read_file of a path"), (2, "seed seed other"), (3, ""), (4, None)], "k int, text string")
    of = lambda frame: {r.k: [round(x, 9) for x in r.vector] for r in frame.collect()}
    assert of(providers.encoded(texts, key="k")) == of(texts.select("k", hashed_vector(T.code_tokens(F.col("text"))).alias("vector")))


REPO = "repo string, node_id string, node_type string, file_path string, name string, qualname string, start_line int, end_line int, docstring string, code string"


def test_repositories_do_not_mix(spark):
    """Two repositories share path, function, label and call graph ids; each report finds its own."""
    name = lambda n: f"func::setup.py::{n}"
    nodes = spark.createDataFrame([(r, name(n), "function", "setup.py", n, n, 10 * i + k, 10 * i + 5 + k, "", f"def {n}(): pass") for k, r in enumerate(("r", "s")) for i, n in enumerate(("load", "parse", f"only_{r}"))], REPO)
    edges = spark.createDataFrame([("r", name("load"), name("only_r"), "invoke"), ("s", name("load"), name("only_s"), "invoke")], "repo string, src string, dst string, edge_type string")
    t = datetime(2024, 1, 1)
    concepts = spark.createDataFrame([("r", "reading", ["setup.py::load"], t), ("s", "reading", ["setup.py::parse"], t)], "repo string, label string, member_function_ids array<string>, built_at timestamp").withColumn("centroid", F.lit(None).cast("array<double>"))
    statements = spark.createDataFrame([("r", name("load"), 3, "load the header"), ("r", name("load"), 4, "x = 1"), ("s", name("load"), 77, "load the header")], "repo string, node_id string, line int, text string")
    issues = spark.createDataFrame([("ir", "r", "load fails `load`", t), ("is", "s", "load fails `load`", t)], "instance_id string, repo string, problem_statement string, created_at timestamp")
    rankings = spark.createDataFrame([(i, "bm25", "setup.py", 1, 1.0) for i in ("ir", "is")], "instance_id string, retriever string, file_path string, rank int, score double")
    searches = {}
    found = {(r.instance_id, r.function_key): r for r in localize(issues, rankings, Index(nodes, edges, concepts, statements), details=searches).collect()}
    keys = lambda i: {k for x, k in found if x == i}
    assert keys("ir") == {"setup.py::load", "setup.py::parse", "setup.py::only_r"} and keys("is") == {"setup.py::load", "setup.py::parse", "setup.py::only_s"}
    assert (found["ir", "setup.py::load"].start_line, found["ir", "setup.py::load"].end_line) == (3, 4)
    assert (found["is", "setup.py::load"].start_line, found["is", "setup.py::load"].end_line) == (77, 77)
    assert found["ir", "setup.py::load"].chain == ["load"] and {r.ended for r in searches["searches"].collect()} <= {"stable", "queue_empty", "iter_cap"}
    assert all(r.node_id in (name("load"), name("parse"), name("only_r")) for r in searches["searches"].filter("instance_id = 'ir'").collect())


def test_empty_tables_and_missing_values(spark):
    t = datetime(2024, 1, 1)
    issue, ranking = "instance_id string, repo string, problem_statement string, created_at timestamp", "instance_id string, repo string, retriever string, file_path string, rank int, score double"
    concept = "repo string, label string, member_function_ids array<string>, built_at timestamp, centroid array<double>"
    nodes = spark.createDataFrame([("r", "func::a.py::f", "function", "a.py", "f", "f", 1, 5, None, None), (None, "func::a.py::f", "function", "a.py", "f", "f", 1, 5, "", ""), ("r", None, "function", None, None, None, None, None, None, None)], REPO)
    edges = spark.createDataFrame([], "repo string, src string, dst string, edge_type string")
    issues = spark.createDataFrame([("i", "r", None, None), ("j", None, "f fails", t), (None, "r", "x", t), ("i", "r", None, None)], issue)
    rankings = spark.createDataFrame([("i", "r", "bm25", "a.py", 1, None), ("i", "r", "bm25", "a.py", 1, None), ("i", "r", None, "a.py", None, 1.0), ("j", None, "dense", None, 1, 1.0)], ranking)
    concepts = spark.createDataFrame([("r", None, ["a.py::f"], t, None), ("r", "x", None, t, None), ("r", "y", ["a.py::f", None, "no"], None, None)], concept)
    sizes = spark.createDataFrame([("r", 10), (None, 5)], "repo string, chars bigint")
    statements = spark.createDataFrame([("r", "func::a.py::f", 2, None)], "repo string, node_id string, line int, text string")
    found = localize(issues, rankings, Index(nodes, edges, concepts, statements, sizes)).collect()
    assert [(r.instance_id, r.function_key, r.appearances) for r in found] == [("i", "a.py::f", 3)]
    none = lambda frame: frame.limit(0)
    assert localize(none(issues), none(rankings), Index(none(nodes), edges, none(concepts), none(statements), none(sizes))).count() == 0
    assert localize(issues, none(rankings), Index(nodes, edges)).count() == 0
