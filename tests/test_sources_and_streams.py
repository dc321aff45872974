import os
from datetime import datetime, timedelta

from mossline.operators import code_graph
from mossline.sources import skeletons
from mossline.streaming import edits


def test_files_of_a_folder_and_round_trips(spark, tmp_path):
    root = tmp_path / "build" / "repo"
    for path, text in {"a/x.py": "def f():\n    g()\ndef g():\n    pass\n", "venv/y.py": "z = 1", "b.txt": "no", "c.py": "import a.x\n"}.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(text)
    found = skeletons.python_files(spark, str(root), "r")
    assert sorted(r.file_path for r in found.collect()) == ["a/x.py", "c.py"]
    rows = skeletons.skeletons(found)
    skeletons.write_skeletons(rows, str(tmp_path / "s"))
    again = skeletons.read_skeletons(spark, str(tmp_path / "s"))
    assert sorted(r.file_path for r in again.filter("size(functions) > 0").collect()) == ["a/x.py"]
    code_graph.save_graph(code_graph.graph_nodes(again), code_graph.structural_edges(again), str(tmp_path / "g"))
    nodes, edges = code_graph.load_graph(spark, str(tmp_path / "g"))
    assert nodes.filter("node_type = 'function'").count() == 2 and edges.filter("edge_type = 'invoke'").count() == 1


def test_commit_stream_counts_redelivered_commits_once(spark, tmp_path):
    t = datetime(2024, 1, 3)
    rows = [("a", "r", ["f", "f"], t), ("a", "r", ["f"], t), ("b", "r", ["f", "g"], t + timedelta(hours=1)), ("z", "r", ["f"], t + timedelta(days=90)), (None, "r", ["f"], t)]
    spark.createDataFrame(rows, "sha string, repo string, files array<string>, authored_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sha string, repo string, files array<string>, authored_at timestamp").parquet(str(tmp_path / "in"))
    query = edits.started(edits.edits_per_window(stream), str(tmp_path / "out"), str(tmp_path / "chk"))
    query.awaitTermination(120)
    got = {(r.file_path, r.n_commits) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("f", 2), ("g", 1)}
