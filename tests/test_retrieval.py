import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mossline.functions import text as T
from mossline.functions import vectors
from mossline.operators import retrieval as R


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_tokens_by_worked_values(spark):
    cases = {
        "foo_bar": "foo_bar foo bar foo bar", "HTTPServer": "httpserver http server", "A x1": "x1", "__x__": "__x__ x", "getURL2": "geturl2 get ur",
        "ABC1": "abc1", "parse_JSON_v2": "parse_json_v2 parse json v2 parse jso v", "Vièle aile": "vi le aile", "": "",
    }
    for text, tokens in cases.items():
        assert one(spark, T.code_tokens, text) == tokens.split(), text
    assert one(spark, T.code_tokens, None) == []


def test_paths_and_flags(spark):
    for path in ("tests/a.py", "a/tests.py", "test_a.py", "a_test.py", "src/test/u.py"):
        assert one(spark, T.is_test_file, path)
    for path in ("contest.py", "attest/x.py", "testing/x.py", "conftest.py"):
        assert not one(spark, T.is_test_file, path)
    imports = {"from a.b import x": "a/b.py", "import a.b, c": "a/b.py", "from ..a import b": "a.py", "from . import x": None, "import a as b": "a.py"}
    for statement, path in imports.items():
        assert one(spark, T.import_path, statement) == path
    assert one(spark, T.ancestor_dirs, "a/b/c.py") == ["a", "a/b"] and one(spark, T.ancestor_dirs, "c.py") == []
    assert one(spark, T.whitespace_tokens, " a  b\n") == 2 and one(spark, T.whitespace_tokens, "") == 0


def test_replies_are_parsed_tolerantly(spark):
    empty = ([], [], [], [], [])
    for reply in ("", "no json", "[1, 2]", "{}", "```json\n{\"exception_types\": \"x\"\n```"):
        assert tuple(one(spark, T.symptoms_of_reply, reply)) == empty, reply
    got = one(spark, T.symptoms_of_reply, 'So:\n```json\n{"exception_types": ["E"], "api_calls_named": ["f", ""], "stack_frames": [{"file": "a.py", "func": "g", "line": 3}]}\n```')
    assert got.exception_types == ["E"] and got.stack_frames[0].line == 3


def test_bm25_against_a_plain_version(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta_x", "eta"]
    docs = [("r", f"d{i}", " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(12)] + [("r", "empty", ""), ("r", "null", None), ("s", "other", "alpha")]
    queries = [("q1", "r", "alpha alpha beta Nothing"), ("q2", "r", ""), ("q3", "r", "eta zeta_x"), ("q4", "t", "alpha")]
    index = R.postings(spark.createDataFrame(docs, "repo string, doc string, text string"), scope="repo", key="doc", text="text")
    got = R.bm25(spark.createDataFrame(queries, "q string, repo string, text string"), index, 5, scope="repo", query="q", text="text", key="doc").collect()

    def plain(query, scope):
        own = {d: re.findall(r"[a-z_][a-z0-9_]+", (t or "").lower()) for r, d, t in docs if r == scope}
        if not own:
            return []
        n, avg = len(own), sum(map(len, own.values())) / len(own)
        df = Counter(t for ts in own.values() for t in set(ts))
        idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
        floor = 0.25 * sum(idf.values()) / len(idf)
        scores = defaultdict(float)
        for t in re.findall(r"[a-z_][a-z0-9_]+", query.lower()):
            for d, ts in own.items():
                tf = ts.count(t)
                if tf:
                    w = idf[t] if idf[t] >= 0 else floor
                    scores[d] += w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        best = sorted(((-round(s, 6), d) for d, s in scores.items()))[:5]
        return [(d, -s) for s, d in best if -s > 0]

    for q, scope, text in queries:
        mine = [(r.doc, r.score) for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])]
        assert [(d, round(s, 5)) for d, s in mine] == [(d, round(s, 5)) for d, s in plain(text, scope)]


def test_fusion_by_worked_values(spark):
    rows = [("i", "llm", "a", None, 0), ("i", "bm25", "a", None, 0), ("i", "dense", "a", None, 0), ("i", "llm", "b", None, 1), ("j", "bm25", "c", None, 0), ("j", "dense", "c", None, 1), ("j", "llm", "d", None, 0), ("j", "bm25", "tests/t.py", None, 1)]
    positions = spark.createDataFrame(rows, "instance_id string, retriever string, file_path string, score double, position int")
    score = {r.file_path: r.score for r in R.reciprocal_ranks(positions).collect()}
    assert abs(score["a"] - 0.04) < 1e-6 and abs(score["c"] - 0.0231421) < 1e-6 and abs(score["d"] - 0.0166667) < 1e-6
    ranked = {(r.instance_id, r.file_path): (r.score, r["rank"]) for r in R.penalised(R.reciprocal_ranks(positions), 2).collect()}
    assert ranked["j", "c"][1] == 0 and ranked["j", "d"][1] == 1 and ("j", "tests/t.py") not in ranked


def test_prefilter_switches_and_falls_back(spark):
    rows = [("i", "r", "llm", 0, "b", 1.0), ("i", "r", "bm25", 0, "a", 1.0), ("j", "r", "bm25", 0, "a", 1.0), ("j", "r", "dense", 0, "z", 1.0), ("k", "s", "bm25", 0, "a", 1.0)]
    rankings = spark.createDataFrame(rows, "instance_id string, repo string, retriever string, rank int, file_path string, score double")
    sizes = spark.createDataFrame([("r", 100), ("s", 1)], "repo string, chars bigint")
    got = {(r.instance_id, r.file_path) for r in R.prefiltered(rankings, sizes, limit=50).collect()}
    assert got == {("i", "b"), ("j", "a"), ("j", "z"), ("k", "a")}


def test_budget_and_decay(spark):
    ranks = spark.range(6).select(R.decayed_budget(F.col("id")).alias("b"), R.decayed_prior(F.col("id"), F.lit(20)).alias("p"))
    assert [r.b for r in ranks.collect()] == [8, 6, 4, 3, 2, 2]
    assert abs(ranks.collect()[1].p - 0.339474) < 1e-5
    items = spark.createDataFrame([("r", "a", "xxx"), ("r", "b", "xxxxxxxxx"), ("r", "c", "")], "s string, k string, t string")
    assert [r.k for r in R.within_budget(items, scope="s", key="k", text="t", budget=10).collect()] == ["a"]


def test_top_k_in_blocks_equals_one_pass(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(100, None), (101, [1.0]), (102, [float("nan")] * 4)]
    e = spark.createDataFrame(rows, "id bigint, v array<double>")
    q = e.filter("id % 5 = 0").select(F.col("id").alias("q"), "v")
    run = lambda block: sorted(map(tuple, vectors.top_k(q, e, 3, query_id="q", record_id="id", query_vector="v", record_vector="v", dimensions=4, query_block=block).collect()))
    assert run(5) == run(1000) and len(run(5)) == 36
    best = {a: max(range(60), key=lambda j: sum(x * y for x, y in zip(rows[a][1], rows[j][1]))) for a in range(0, 60, 5)}
    assert {r[0]: r[1] for r in run(5) if r[3] == 1} == best
    assert vectors.top_k(q.limit(0), e, 3, query_id="q", record_id="id", query_vector="v", record_vector="v", dimensions=4).count() == 0


def test_vectors_meet_in_their_scope_and_ties_go_to_the_smaller_id(spark):
    rows = [(f"{s}{i}", s, [1.0, float(i % 3)]) for s in "ab" for i in range(40)] + [("x", None, [1.0, 1.0])]
    e = spark.createDataFrame(rows, "id string, s string, v array<double>")
    q = e.filter("id in ('a1', 'b2', 'x')").select(F.col("id").alias("q"), "s", "v")
    run = lambda **o: sorted(map(tuple, vectors.top_k(q, e, 4, query_id="q", record_id="id", query_vector="v", record_vector="v", dimensions=2, scope="s", **o).collect()))
    assert run() == run(query_block=1, record_block=7)
    best = lambda s, w: sorted((-round(1 + w * (i % 3), 12), f"{s}{i}") for i in range(40))[:4]
    assert [(r[0], r[1], r[2]) for r in run()] == sorted([("a1", i, -x) for x, i in best("a", 1)] + [("b2", i, -x) for x, i in best("b", 2)])


def test_bm25_does_not_depend_on_blocks(spark, monkeypatch):
    from mossline.functions import blocks

    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([("r", f"d{i}", " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(70)], "repo string, doc string, text string")
    queries = spark.createDataFrame([(f"q{i}", "r", " ".join(rng.choices(words, k=5))) for i in range(9)], "q string, repo string, text string")
    index = R.postings(docs, scope="repo", key="doc", text="text").cache()
    run = lambda: sorted(map(tuple, R.bm25(queries, index, 6, scope="repo", query="q", text="text", key="doc").collect()))
    whole = run()
    best = blocks.best
    monkeypatch.setattr(blocks, "best", lambda *a, **o: best(*a, query_rows=2, record_rows=5))
    monkeypatch.setattr(blocks, "TERM_ROWS", 3)
    assert run() == whole and len(whole) > 40


def test_sums_of_groups_in_parts(spark, monkeypatch):
    rows = [(i % 5, [float(i), 1.0, float("nan") if i % 2 else 2.0]) for i in range(200)] + [(0, None), (1, [1.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "g bigint, v array<double>").repartition(3)
    got = {r.g: (r.s, r.n) for r in vectors.vector_sums(frame, group="g", vector="v", dimensions=3).collect()}
    for g in range(5):
        own = [v for k, v in rows[:200] if k == g]
        assert got[g] == ([sum(v[0] for v in own), 40.0, sum(v[2] for v in own if v[2] == v[2])], [40, 40, sum(v[2] == v[2] for v in own)])


def test_pool_of_a_large_repository(spark):
    rows = [("i", "bm25", f"b{k}.py", k) for k in range(120)] + [("i", "dense", "b0.py", 0), ("i", "dense", "d.py", 1), ("i", "llm", "m.py", 0)]
    pool = R.candidate_pool(spark.createDataFrame(rows, "instance_id string, retriever string, file_path string, position int")).collect()
    assert {r.file_path for r in pool} == {f"b{k}.py" for k in range(100)} | {"d.py"} and len(pool) == 101
