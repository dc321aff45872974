from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mossline.operators import code_graph as G
from mossline.operators import history as H
from mossline.operators import seeding as S
from mossline.operators.traversal import Graph, Limits, search, traversed
from mossline.sources import diffs, skeletons

SOURCE = '''"""Module."""
import os
from a.b import c

class Thing(base.Other):
    """A thing."""

    def run(self, x: int = 1) -> str:
        y = x
        for z in y:
            y = helper(z)
        return y

def helper(v):
    return helper2(v)

def helper2(v):
    return v
'''
BASE = datetime(2024, 6, 1)


def files(spark, rows):
    return spark.createDataFrame(rows, "repo string, file_path string, content string")


def test_skeleton_of_a_module(spark):
    r = skeletons.skeletons(files(spark, [("r", "m.py", SOURCE), ("r", "bad.py", "def f(:"), ("r", "none.py", None)])).orderBy("file_path").collect()
    assert [x.file_path for x in r] == ["bad.py", "m.py"] and r[0].parse_error and not r[0].functions
    m = r[1]
    assert m.imports == ["import os", "from a.b import c"] and [f.name for f in m.functions] == ["helper", "helper2"]
    c = m.classes[0]
    assert (c.name, c.bases, c.docstring, c.methods[0].qualname, c.methods[0].signature) == ("Thing", ["base.Other"], "A thing.", "Thing.run", "(self, x: int = 1)")
    outline = skeletons.outline_text(skeletons.skeletons(files(spark, [("r", "m.py", SOURCE)]))).first().outline
    assert "FILE: m.py" in outline and "class Thing(base.Other)" in outline and "  def run(self, x: int = 1)" in outline and "def helper(v)" in outline


def test_edges(spark):
    s = skeletons.skeletons(files(spark, [("r", "p/m.py", SOURCE), ("r", "a/b.py", "class Other:\n    def run(self):\n        helper2(1)\n")]))
    e = {(x.src, x.dst, x.edge_type) for x in G.structural_edges(s).collect()}
    assert ("class::p/m.py::Thing", "class::a/b.py::Other", "inherit") in e
    assert ("file::p/m.py", "file::a/b.py", "import") in e and ("dir::p", "file::p/m.py", "contain") in e
    assert ("func::p/m.py::Thing.run", "func::p/m.py::helper", "invoke") in e and ("func::a/b.py::Other.run", "func::p/m.py::helper2", "invoke") in e
    assert not any(a == b for a, b, _ in e)
    n = {x.node_id: x.node_type for x in G.graph_nodes(s).collect()}
    assert n["dir::p"] == "directory" and n["func::p/m.py::Thing.run"] == "function" and len(n) == 2 + 2 + 2 + 4


def test_def_use_takes_the_nearest_earlier_definition(spark):
    rows = [("f", 0, 1, ["x"], []), ("f", 1, 2, ["x"], ["x"]), ("f", 2, 3, [], ["x", "q"]), ("g", 0, 1, [], ["x"])]
    got = G.def_use(spark.createDataFrame(rows, "fn string, ix int, line int, defs array<string>, uses array<string>"), keys=["fn"])
    assert sorted((r.def_line, r.use_line) for r in got.collect()) == [(1, 2), (2, 3)]


def test_innermost_span(spark):
    spans = spark.createDataFrame([("r", "f", "outer", 1, 900), ("r", "f", "inner", 250, 520)], "repo string, file string, node_id string, start_line int, end_line int")
    lines = spark.createDataFrame([("r", "f", n) for n in (1, 249, 250, 512, 520, 521, 901)], "repo string, file string, line int")
    assert {r.line: r.node_id for r in G.enclosing(lines, spans, keys=["repo", "file"]).collect()} == {1: "outer", 249: "outer", 250: "inner", 512: "inner", 520: "inner", 521: "outer"}


def test_patches():
    patch = "--- a/x.py\n+++ b/x.py\n@@ -2,3 +2,3 @@\n ctx\n-old\n+new\n ctx\n@@ -20 +20,2 @@\n+added\n last\n--- a/gone.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"
    assert diffs.hunks_of(patch) == [("x.py", 0, 2, 4, 3), ("x.py", 1, 20, 20, 20), ("gone.py", 0, 1, 2, 1)]
    assert diffs.hunks_of("") == [] and diffs.hunks_of("@@ nonsense\n+++ x") == []


def commits(spark, rows):
    return H.latest_commits(spark.createDataFrame([(*r, BASE, "m") for r in rows], "sha string, repo string, authored_at timestamp, files array<string>, ingested_at timestamp, message string"))


def test_nothing_at_or_after_the_base(spark):
    c = commits(spark, [("a", "r", BASE + timedelta(days=2), ["f"]), ("b", "r", BASE, ["f"]), ("c", "r", BASE - timedelta(days=1), ["f"]), ("d", "r", BASE - timedelta(days=400), ["f"]), ("n", "r", None, ["f"])])
    assert [r.sha for r in H.before(c, F.lit(BASE), 10).collect()] == ["c", "d"] and H.before(c, F.lit(BASE), 1).count() == 1
    issues = spark.createDataFrame([("i", "b"), ("j", "a"), ("k", "none")], "instance_id string, base_commit string")
    assert sorted(map(tuple, H.commits_before_base(issues, c).select("instance_id", "n_before").collect())) == [("i", 2), ("j", 3)]


def test_common_edits(spark):
    rows = [(f"s{i}", "r", BASE, ["a", "b", "a"]) for i in range(3)] + [("t", "r", BASE, ["a", "c"]), ("u", "r", BASE, []), ("v", "r", BASE, None)]
    c = commits(spark, rows)
    counts = H.edit_counts(c)
    assert {r.file_path: r.n_commits for r in counts.collect()} == {"a": 4, "b": 3, "c": 1}
    kept = H.most_edited(counts, 2)
    assert sorted(map(tuple, H.co_edited(c, kept, 3).collect())) == [("r", "a", "b", 3), ("r", "b", "a", 3)]


def test_seeds_keep_the_larger_prior(spark):
    schema = "instance_id string, node_id string"
    got = S.seeds(stack=spark.createDataFrame([("i", "n1")], schema), literal=spark.createDataFrame([("i", "n1"), ("i", "n2")], schema), files=spark.createDataFrame([("i", "n2", 0.35), ("i", "n3", 0.35)], schema + ", prior double"), cap=2)
    assert [(r.node_id, r.prior, r.provenance) for r in got.orderBy("rank").collect()] == [("n1", 1.0, "stack"), ("n2", 0.8, "literal")]


def test_search_on_a_tiny_graph():
    graph = Graph({"A": 1.0, "B": 0.0, "C": 0.0}, {"invoke": {"A": ["B"]}})
    best, ended, steps = search([("A", 1.0)], graph)
    assert best[0][0] == "A" and "B" in [b[0] for b in best] and ended in ("iter_cap", "queue_empty", "stable")
    assert search([("A", 1.0)], graph, Limits(iterations=2))[1] == "iter_cap"
    assert search([], graph) == ([], "queue_empty", 0)
    assert search([("missing", 1.0)], graph)[0] == []


def test_search_reads_the_best_functions_of_a_class_and_drills():
    graph = Graph({f"f{i}": i / 10 for i in range(6)}, {"contain": {"class": [f"f{i}" for i in range(6)]}}, {"f5": [(3, 0.1), (9, 0.9), (4, 0.5)]})
    strong = lambda batch, scores: ([(n, 9.0) for n in batch], ["f0"])
    best, _, _ = search([("class", 1.0)], graph, reasoner=strong)
    assert [b[0] for b in best[:3]] == ["f5", "f4", "f3"] and "f0" in [b[0] for b in best] and "f1" not in [b[0] for b in best]
    assert dict((b[0], b[4]) for b in best)["f5"] == [9, 4, 3]


def test_search_for_many_instances_does_not_depend_on_order(spark):
    seeds = spark.createDataFrame([(f"i{k}", 0, "A", 1.0, 1) for k in range(3)], "instance_id string, run int, node_id string, prior double, rank int")
    edges = spark.createDataFrame([("A", "B", "invoke"), ("B", "C", "invoke"), ("C", "A", "invoke")], "src string, dst string, edge_type string")
    scores = spark.createDataFrame([(f"i{k}", "A", 1.0) for k in range(3)], "instance_id string, node_id string, sem double")
    first = sorted(map(str, traversed(seeds, edges, scores).collect()))
    assert first == sorted(map(str, traversed(seeds.repartition(3), edges.repartition(2), scores).collect()))
    assert sum("node_id='A'" in r for r in first) == 3 and sum("node_id='B'" in r for r in first) == 3


def test_search_reaches_as_deep_as_its_iterations(spark):
    names = [f"n{i}" for i in range(20)]
    seeds = spark.createDataFrame([("i", 0, "n0", 1.0, 1)], "instance_id string, run int, node_id string, prior double, rank int")
    edges = spark.createDataFrame([(a, b, "invoke") for a, b in zip(names, names[1:], strict=False)], "src string, dst string, edge_type string")
    sem = {n: 5.0 * i for i, n in enumerate(names)}
    scores = spark.createDataFrame([("i", n, x) for n, x in sem.items()], "instance_id string, node_id string, sem double")
    whole, ended, steps = search([("n0", 1.0)], Graph(sem, {"invoke": {a: [b] for a, b in zip(names, names[1:], strict=False)}}))
    got = traversed(seeds, edges, scores).orderBy("rank").collect()
    assert [(r.node_id, r.distance, r.ended, r.iterations) for r in got] == [(n, d, ended, steps) for n, _, d, _, _ in whole] and max(r.distance for r in got) > 3


def test_runs_are_searched_with_their_own_scores(spark):
    seeds = spark.createDataFrame([("i", r, n, 1.0, k) for r in range(2) for k, n in enumerate("AB")], "instance_id string, run int, node_id string, prior double, rank int")
    edges = spark.createDataFrame([], "src string, dst string, edge_type string")
    scores = spark.createDataFrame([("i", 0, "A", 1.0), ("i", 1, "B", 1.0)], "instance_id string, run int, node_id string, sem double")
    assert {r.run: r.node_id for r in traversed(seeds, edges, scores).filter("rank = 1").collect()} == {0: "A", 1: "B"}


def test_search_goes_up_and_down_inherit_edges_and_asks_for_what_it_needs(spark):
    seeds = spark.createDataFrame([("i", "r", 0, "base", 1.0, 1)], "instance_id string, repo string, run int, node_id string, prior double, rank int")
    edges = spark.createDataFrame([("r", "child", "base", "inherit"), ("s", "other", "base", "inherit"), ("r", "child", "far", "invoke"), ("r", "far", "further", "invoke")], "repo string, src string, dst string, edge_type string")
    vectors = spark.createDataFrame([("r", n, [1.0, 0.1 * i]) for i, n in enumerate(("base", "child", "far", "further"))] + [("s", "base", [0.0, 0.0]), ("s", "other", [9.0, 9.0])], "repo string, node_id string, vector array<double>")
    queries = spark.createDataFrame([("i", 0, [0.5, 1.0])], "instance_id string, run int, vector array<double>")
    got = traversed(seeds, edges, vectors=vectors, queries=queries, limits=Limits(iterations=40)).collect()
    assert {r.node_id: r.distance for r in got} == {"base": 0, "child": 1, "far": 2, "further": 3} and {r.ended for r in got} <= {"stable", "queue_empty"}


def test_concepts_and_files_stay_in_their_repository(spark):
    concepts = spark.createDataFrame([("r", "seeds", ["a.py::f"], None, BASE), ("s", "seeds", ["a.py::f", "b.py::g"], None, BASE)], "repo string, label string, member_function_ids array<string>, centroid array<double>, built_at timestamp")
    functions = spark.createDataFrame([("r", "func::a.py::f"), ("s", "func::b.py::g")], "repo string, node_id string")
    nodes, edges = G.concept_graph(concepts, functions)
    assert nodes.count() == 2 and sorted(map(tuple, edges.collect())) == [("r", "func::a.py::f", "concept::seeds"), ("s", "func::b.py::g", "concept::seeds")]
    rows = [("r", "file::a.py", "file", "a.py", None), ("r", "class::a.py::C", "class", "a.py", "C"), ("r", "func::a.py::C.m", "function", "a.py", "C.m"), ("r", "func::a.py::f.g", "function", "a.py", "f.g"), ("s", "func::a.py::C.m", "function", "a.py", "C.m")]
    tree = spark.createDataFrame(rows, "repo string, node_id string, node_type string, file_path string, qualname string")
    contain = G.contain_edges_of(tree)
    assert ("r", "class::a.py::C", "func::a.py::C.m") in set(map(tuple, contain.collect())) and ("s", "file::a.py", "func::a.py::C.m") in set(map(tuple, contain.collect()))
    assert {(r.repo, r.node_id, r.file) for r in G.file_of(tree.filter("node_type = 'function'"), contain).collect()} == {("r", "func::a.py::C.m", "file::a.py"), ("r", "func::a.py::f.g", "file::a.py"), ("s", "func::a.py::C.m", "file::a.py")}


def test_literals_meet_by_pieces(spark):
    import random

    rng = random.Random(8)
    names = ["".join(rng.choice("abc_.") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    words = ["", "a", "b_", *["".join(rng.choice("abc_") for _ in range(rng.randrange(1, 6))) for _ in range(20)]]
    symptoms = spark.createDataFrame([(f"i{k}", "r" if k % 3 else "s", ([w], [], [], [], [])) for k, w in enumerate(words)], "instance_id string, repo string, symptoms struct<exception_types:array<string>,error_messages:array<string>,stack_frames:array<struct<file:string,func:string,line:int>>,behaviors:array<string>,api_calls_named:array<string>>")
    functions = spark.createDataFrame([("r" if k % 2 else "s", f"n{k}", n, "Doc" if k % 5 else None) for k, n in enumerate(names)], "repo string, node_id string, qualname string, docstring string")
    hay = lambda k: (names[k] + " " + ("Doc" if k % 5 else "")).lower()
    exact = {(f"i{i}", f"n{k}") for i, w in enumerate(words) for k in range(60) if w and ("r" if i % 3 else "s") == ("r" if k % 2 else "s") and w in hay(k)}
    assert set(map(tuple, S.literal_matches(symptoms, functions).collect())) == exact
    assert S.literal_matches(symptoms.limit(0), functions).count() == 0


def test_outline_line_by_line(spark):
    rows = skeletons.skeletons(files(spark, [("r", "m.py", SOURCE), ("r", "n.py", "x = 1\n")]))
    summaries = spark.createDataFrame([("r", "m.py", "Runs things."), ("r", "other.py", "No file.")], "repo string, file_path string, summary string")
    got = {r.file_path: r.outline for r in skeletons.outline_text(rows, summaries).collect()}
    assert got["m.py"].split("\n") == [
        "FILE: m.py", "SUMMARY: Runs things.", "IMPORTS: import os, from a.b import c", "class Thing(base.Other)", '  """A thing."""', "  def run(self, x: int = 1)", "def helper(v)", "def helper2(v)",
    ] and got["n.py"] == "FILE: n.py"


def test_windows_before_bases(spark):
    days = {"a": 1, "b": 2, "c": 2, "d": 3, "e": 90, "f": 91}
    c = commits(spark, [(s, "r", BASE + timedelta(days=d), ["x"]) for s, d in days.items()] + [("z", "s", BASE, ["x"])])
    issues = spark.createDataFrame([("i", "f"), ("j", "d"), ("k", "a"), ("l", "none")], "instance_id string, base_commit string")
    for limit, expected in ((2, {"i": (4, 5, "d"), "j": (2, 3, "c")}), (7_000, {"i": (1, 5, "a"), "j": (1, 3, "a")}), (1, {"i": (5, 5, "e"), "j": (3, 3, "b")})):
        got = {r.instance_id: (r.first_no, r.last_no, r.oldest_sha) for r in H.windows_before_bases(issues, c, limit).collect()}
        assert got == expected
        newest = [r.sha for r in H.before(c.filter("repo = 'r'"), F.lit(BASE + timedelta(days=3)), limit).collect()]
        assert newest[-1] == expected["j"][2]
