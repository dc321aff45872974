import hashlib

from pyspark.sql import functions as F

from mossline.functions import text as T
from mossline.operators import consensus as C
from mossline.operators import evaluation as E
from mossline.operators import grouping as K
from mossline.sources import replies, settings


def test_hits_and_recall(spark):
    gold = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "z"), ("k", "q")], "instance_id string, file_path string")
    predicted = spark.createDataFrame([("i", 1, "x"), ("i", 2, "y"), ("i", 3, "a"), ("j", 1, "z"), ("none", 1, "a")], "instance_id string, rank int, file_path string")
    got = {r.instance_id: r for r in E.hits(predicted, gold, "file_path").select("instance_id", E.accuracy_at(1).alias("a1"), E.accuracy_at(3).alias("a3"), E.recall_at(3).alias("r3"), E.reciprocal_rank().alias("mrr")).collect()}
    assert (got["i"].a1, got["i"].a3, got["i"].r3) == (0.0, 1.0, 0.5) and abs(got["i"].mrr - 1 / 3) < 1e-9
    assert got["j"].a1 == got["j"].mrr == 1.0 and got["k"].mrr == 0.0 and "none" not in got


def test_line_recall_with_tolerance(spark):
    gold = spark.createDataFrame([("i", "f", 10, 20), ("i", "f", 50, 60)], "instance_id string, file_path string, start_line int, end_line int")
    lines = lambda *rows: spark.createDataFrame(list(rows), "instance_id string, rank int, file_path string, start_line int, end_line int")
    assert E.line_recall(lines(("i", 1, "f", 25, 30)), gold).first().line_recall == 0.5
    assert E.line_recall(lines(("i", 1, "f", 500, 600), ("i", 9, "f", 10, 20)), gold).first().line_recall == 0.0


def test_calibration_edges(spark):
    rows = [(0.0, 0), (0.3, 1), (0.6, 0), (0.7, 1), (1.0, 1), (-0.5, 0)]
    edges = [i * 0.1 for i in range(10)] + [1.0]
    total = 0.0
    for i in range(10):
        own = [(c, y) for c, y in rows if edges[i] <= c < edges[i + 1]]
        if own:
            total += len(own) / len(rows) * abs(sum(c for c, _ in own) / len(own) - sum(y for _, y in own) / len(own))
    assert abs(E.calibration_error(spark.createDataFrame(rows, "confidence double, correct int")).first().ece - round(total, 6)) < 1e-9
    assert E.calibration_error(spark.createDataFrame([], "confidence double, correct int")).first().ece is None


def test_vote_labels(spark):
    table = {(1, 1): "high", (2, 1): "low", (2, 2): "high", (3, 1): "low", (3, 2): "medium", (3, 3): "high", (4, 2): "low", (4, 3): "medium"}
    rows = spark.createDataFrame([(a, b) for a, b in table], "n int, k int").select("n", "k", T.confidence_label(F.col("n"), F.col("k")).alias("l")).collect()
    assert {(r.n, r.k): r.l for r in rows} == table
    runs = [("i", 0, 0, "a", 0.9), ("i", 1, 0, "a", 0.7), ("i", 2, 0, "b", 1.0), ("i", 2, 1, "b", 0.0), ("i", 0, 25, "late", 1.0)]
    got = {r.k: (r.score, r.appearances, r.label) for r in C.vote(spark.createDataFrame(runs, "instance_id string, run int, rank int, k string, score double"), 3, key="k").collect()}
    assert got == {"a": (0.533333, 2, "medium"), "b": (0.166667, 1, "low")}


def test_head_follows_the_list(spark):
    ranking = spark.createDataFrame([("i", c, 1.0 - i / 10, i) for i, c in enumerate("abcd")], "instance_id string, k string, score double, rank int")
    model = spark.createDataFrame([("i", "c", 0, 0.9), ("i", "a", 1, 0.5), ("i", "c", 2, 0.1), ("i", "zz", 3, 1.0), ("i", "d", 4, 1.0)], "instance_id string, k string, position int, confidence double")
    assert [r.k for r in C.merged_head(ranking, model, key="k", head=3).orderBy("rank").collect()] == ["c", "a", "b", "d"]
    assert [r.k for r in C.merged_head(ranking, model.limit(0), key="k").orderBy("rank").collect()] == list("abcd")


def test_rerank_by_another_query(spark):
    rows = [("i", "a", [1.0, 0.0], [0.0, 1.0], 0), ("i", "b", [0.6, 0.8], [0.0, 1.0], 1), ("i", "c", None, [0.0, 1.0], 2)]
    got = C.reranked(spark.createDataFrame(rows, "instance_id string, k string, vector array<double>, query array<double>, rank int"), key="k", cut_to=2)
    assert [(r.k, r.score) for r in got.orderBy("rank").collect()] == [("b", 0.8), ("a", 0.0)]
    texts = spark.createDataFrame([("q", ["", "x y"]), ("q", [])], "r string, c array<string>").select(C.augmented_query(F.col("r"), F.col("c")).alias("t")).collect()
    assert [r.t for r in texts] == ["q\nx y", "q"]


def test_extended_pool_excludes_before_counting(spark):
    known = spark.createDataFrame([("i", "n1")], "instance_id string, node_id string")
    files = spark.createDataFrame([("i", "r", "f", 0), ("i", "r", "g", 5)], "instance_id string, repo string, file_path string, rank int")
    functions = spark.createDataFrame([("r", "f", f"n{j}", j) for j in range(1, 7)] + [("r", "g", "far", 0)], "repo string, file_path string, node_id string, order_key int")
    assert sorted(r.node_id for r in C.extended_pool(known, files, functions).collect()) == ["n1", "n2", "n3", "n4"]


def test_cluster_count_and_kmeans(spark):
    assert [K.cluster_count(n) for n in (3, 100, 14_227, 300_000)] == [3, 10, 119, 500]
    rows = [(i, [1.0, 0.01 * i]) for i in range(10)] + [(10 + i, [0.01 * i, 1.0]) for i in range(10)] + [(99, None)]
    assigned, centroids = K.kmeans(spark.createDataFrame(rows, "id bigint, v array<double>"), key="id", vector="v", dimensions=2, k=2, iterations=5)
    of = {r.id: r.cluster for r in assigned.collect()}
    assert len(of) == 20 and len(centroids.collect()) == 2


def test_cache_and_settings(spark, tmp_path):
    none = F.lit(None).cast("struct<type:string>")

    def key(model="m", mode="plain", said=("q",), form=none, temperature=0, seed=0):
        messages = F.array(*[F.struct(F.lit("user").alias("role"), F.lit(x).alias("content")) for x in said])
        return spark.range(1).select(T.request_key(model=F.lit(model), mode=F.lit(mode), messages=messages, response_format=form, temperature=F.lit(temperature), seed=F.lit(seed))).first()[0]

    keys = [key(), key(mode="think"), key(form=F.struct(F.lit("object").alias("type"))), key(said=("q", "")), key(said=("q|mode=plain",)), key(temperature=0.3), key(seed=1), key(model="m2")]
    assert key() == keys[0] and len(set(keys)) == len(keys) and all(len(k) == 64 for k in keys)
    assert keys[0] == hashlib.sha256(b'{"messages":[{"content":"q","role":"user"}],"mode":"plain","model":"m","response_format":null,"seed":0,"temperature":0.0}').hexdigest()
    replies.add(spark.createDataFrame([("aa1", "x", None)], "key string, text string, reasoning string"), str(tmp_path / "c"))
    hit, miss = replies.looked_up(spark.createDataFrame([("aa1",), ("bb2",)], "key string"), replies.read(spark, str(tmp_path / "c")))
    assert [r.text for r in hit.collect()] == ["x"] and [r.key for r in miss.collect()] == ["bb2"]
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\ntraversal: {iterations: 5}\n")
    (tmp_path / "own.yaml").write_text("inherits: base.yaml\na: {y: 3}\n")
    loaded = settings.load(str(tmp_path / "own.yaml"))
    assert loaded["a"] == {"x": 1, "y": 3} and settings.limits(loaded).iterations == 5
    (tmp_path / "more.yaml").write_text("traversal: {iterations: 9}\n")
    (tmp_path / "both.yaml").write_text("inherits: [own.yaml, more.yaml]\na: {z: 4}\n")
    assert settings.load(str(tmp_path / "both.yaml")) == {"a": {"x": 1, "y": 3, "z": 4}, "traversal": {"iterations": 9}}
    assert "–" in E.markdown({"mrr": float("nan"), "n": 3}, "own")


def test_concepts_are_grouped_until_nothing_moves(spark, tmp_path, monkeypatch):
    from mossline.plans import reference_queries

    asked = []
    monkeypatch.setattr(K, "kmeans", lambda records, **options: (asked.append(options), (records, records))[1])
    spark.createDataFrame([(1, [1.0] * 64)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    reference_queries.kmeans_concepts(spark, str(tmp_path))
    assert asked == [{"key": "vec_id", "vector": "embedding", "dimensions": 64}]


def test_report_counts_and_calibration(spark):
    asked = spark.createDataFrame([(i,) for i in "ijk"], "instance_id string")
    files = spark.createDataFrame([("i", "a.py", 1), ("i", "b.py", 2), ("j", "c.py", 1)], "instance_id string, file_path string, rank int")
    functions = spark.createDataFrame([("i", "a.py::f", 1, 0.9), ("j", "c.py::g", 1, 0.5)], "instance_id string, function_key string, rank int, score double")
    gold = spark.createDataFrame([("i", "a.py::f"), ("j", "x.py::y"), ("k", "z.py::z")], "instance_id string, function_key string")
    gold_files = gold.select("instance_id", F.substring_index("function_key", "::", 1).alias("file_path"))
    lines = spark.createDataFrame([("i", 1, "a.py", 1, 5)], "instance_id string, rank int, file_path string, start_line int, end_line int")
    gold_lines = spark.createDataFrame([("i", "a.py", 3, 4)], "instance_id string, file_path string, start_line int, end_line int")
    row = E.report(files, gold_files, functions, gold, lines, gold_lines, asked=asked).first()
    assert (row.n_predictions, row.n_with_gold_function, row.file_acc_1, row.line_recall_5, row.ece) == (3, 3, 0.333333, 1.0, 0.3)
    assert {r.instance_id: (r.top1_func, r.n_files) for r in E.per_instance(asked, functions, files).collect()} == {"i": ("a.py::f", 2), "j": ("c.py::g", 1), "k": (None, 0)}
