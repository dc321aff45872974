from pyspark.sql import functions as F

from mossline.functions import prompts
from mossline.plans import providers as V


def test_replies_are_asked_once_and_cached(spark):
    requests = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b"), ("k3", "boom")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "old", None)], "key string, text string, reasoning string")

    def model(prompt):
        if prompt == "boom":
            raise RuntimeError("no")
        return prompt.upper(), None

    every, fresh = V.answered(requests, cache, model, tries=2)
    assert sorted((r.key, r.text or "") for r in every.collect()) == [("k1", "old"), ("k2", "B"), ("k2", "B"), ("k3", "")]
    assert [(r.key, r.text) for r in fresh.collect()] == [("k2", "B")]


def test_defaults_without_a_model(spark):
    f = spark.createDataFrame([("n1", "loadSeed", "Loads it.\nMore."), ("n2", "loadSeed", ""), ("n3", "run", None)], "node_id string, name string, docstring string")
    assert {r.node_id: r.summary for r in V.summaries(f).collect()} == {"n1": "Loads it.", "n2": "load seed", "n3": "run"}
    members = spark.createDataFrame([(1, "a", "load the seed"), (1, "b", "load it"), (2, "c", None)], "cluster int, node_id string, summary string")
    assert {r.cluster: r.label for r in V.labels(members).collect()} == {1: "load it seed", 2: ""}
    v = {r.k: r.vector for r in V.encoded(spark.createDataFrame([("x", "alpha beta"), ("y", "")], "k string, t string"), key="k", text="t").collect()}
    assert abs(sum(a * a for a in v["x"]) - 1) < 1e-9 and not any(v["y"])
    reports = spark.createDataFrame([("i", "r", "alpha beta")], "instance_id string, repo string, text string")
    outlines = spark.createDataFrame([("r", "a.py", "alpha"), ("r", "b.py", "alpha beta"), ("r", "c.py", "none")], "repo string, file_path string, outline string")
    assert [r.file_path for r in V.ranked_by_overlap(reports, outlines).orderBy("position").collect()] == ["b.py", "a.py"]


def test_prompts_and_rows(spark):
    row = spark.createDataFrame([("r" * 9000,)], "t string")
    assert len(row.select(prompts.symptom_prompt(F.col("t"))).first()[0]) < 6500
    assert [m.role for m in row.select(prompts.messages(F.col("t"), F.lit("be brief"))).first()[0]] == ["system", "user"]
    drawing = prompts.drawn(spark.createDataFrame([("i", 1, "n", "p/a.py", "f"), ("i", 9, "m", "p/b.py", "g")], "instance_id string, rank int, node_id string, file_path string, qualname string")).first().drawing
    assert drawing.startswith("graph TD\n  n") and 'a.py::f' in drawing and "b.py" not in drawing
    pairs = spark.createDataFrame([("q", "p", ["n1", "n2"]), ("r", "p", None)], "anchor string, positive string, negatives array<string>")
    assert sorted((r.anchor, r.text, r.label) for r in prompts.training_rows(pairs).collect()) == [("q", "n1", 0), ("q", "p", 1), ("r", "p", 1)]
    hunks = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "a")], "instance_id string, file_path string")
    issues = spark.createDataFrame([("i", "r"), ("j", "r"), ("k", "s")], "instance_id string, repo string")
    assert [r.instance_id for r in V.instances(issues, hunks, repos=["r"], several_files=True).collect()] == ["i"]


def test_a_model_is_asked_once_per_key_whatever_is_read(spark, tmp_path):
    """The model leaves a mark for each call, in files, since it runs in other processes."""
    folder = str(tmp_path)

    def model(prompt):
        with open(f"{folder}/{prompt}", "a") as calls:
            calls.write("x")
        return prompt + "!", "because"

    requests = spark.createDataFrame([("a", "pa"), ("b", "pb"), ("b", "pb"), ("c", "pc")], "key string, prompt string")
    cache = spark.createDataFrame([("c", None, None)], "key string, text string, reasoning string")
    every, fresh = V.answered(requests, cache, model)
    assert sorted((r.key, r.text) for r in every.collect()) == [("a", "pa!"), ("b", "pb!"), ("b", "pb!"), ("c", "pc!")] and fresh.count() == 3 and every.count() == 4
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"pa": "x", "pb": "x", "pc": "x"}


def test_the_rate_holds_for_all_tasks_together(spark):
    requests = spark.createDataFrame([(f"k{i}", "p") for i in range(6)], "key string, prompt string")
    cache = spark.createDataFrame([], "key string, text string, reasoning string")
    import time

    times = sorted(float(r.text) for r in V.answered(requests, cache, lambda p: (str(time.time()), None), per_minute=600, tasks=2)[1].collect())
    assert len(times) == 6 and all(b - a > 0.15 for a, b in zip(times, times[2:], strict=False))


def test_listwise_order_and_thinking(spark):
    head = spark.createDataFrame([("i", "n1", 0, "load_seed", "parse it"), ("i", "n2", 1, "parse", "parse it"), ("i", "n3", 2, "", "parse it")], "instance_id string, node_id string, rank int, name string, text string")
    assert [(r.node_id, r.confidence) for r in V.listwise_by_overlap(head).orderBy("position").collect()] == [("n2", 1.0), ("n1", 0.0), ("n3", 0.0)]
    bodies = spark.createDataFrame([("qwen3", "think-high"), ("qwen3", "non-think"), ("Meta-Llama-3", "think-max"), ("DeepSeek-R1", "think-high")], "m string, t string").select(prompts.extra_body(F.col("m"), F.col("t")).alias("b")).collect()
    assert [r.b != "{}" for r in bodies] == [True, False, False, False]
    block = spark.createDataFrame([("a.py::f", ["x", "y"], "c" * 9_000), ("a.py::g", [], None)], "k string, c array<string>, t string").select(prompts.candidate_block(F.col("k"), F.col("c"), F.col("t")).alias("b")).collect()
    assert "chain: x -> y" in block[0].b and len(block[0].b) < 1_600 and "(none)" in block[1].b
