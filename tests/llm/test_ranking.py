import random
from statistics import NormalDist

from pyspark.sql import functions as F

from mossline.llm import ranking as R

SCHEMA = "instance_id string, retriever string, rank int, file_path string, score double, fused string"
EQUAL = {"bm25": 1.0, "dense": 1.0, "llm": 1.0}


def fused(spark, rows, weights=EQUAL, **options):
    return R.fused_scores(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), weights, **options)


def plain(rows, weights):
    out = {}
    for g in {r[0] for r in rows}:
        lists = {}
        for _, s, rank, item, score in (r for r in rows if r[0] == g):
            own = lists.setdefault(s, {}).setdefault(item, [None, None])
            if score is not None and score == score:
                own[0] = score if own[0] is None else max(own[0], score)
            if rank is not None:
                own[1] = rank if own[1] is None else min(own[1], rank)
        items = {i for own in lists.values() for i in own}
        for i in items:
            total = weight = 0.0
            for s, own in lists.items():
                by_score = all(a is not None for a, _ in own.values())
                value = {k: a if by_score else -b for k, (a, b) in own.items()}
                n, missing = len(items), len(items) - len(own)
                if i in value:
                    below = sum(v < value[i] for v in value.values())
                    ties = sum(v == value[i] for v in value.values())
                    p = (missing + below + ties / 2) / n
                else:
                    p = missing / 2 / n
                total += weights[s] * NormalDist().inv_cdf(p)
                weight += weights[s]
            out[g, i] = total / weight
    return out


def test_quantiles(spark):
    ps = [1e-6, 0.001, 0.02425, 0.3, 0.5, 0.9, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", R.inverse_normal(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7 for r in got)


def test_random_lists_against_a_plain_version(spark):
    rng = random.Random(6)
    rows = []
    for g in range(8):
        for s in ("bm25", "dense", "llm"):
            if rng.random() < 0.2:
                continue
            items = rng.sample(range(30), rng.randrange(1, 20))
            scores = [round(rng.choice([rng.gauss(0, 50), 5.0]), 3) for _ in items]
            order = sorted(range(len(items)), key=lambda i: -scores[i])
            mode = rng.choice(["both", "score", "rank", "some"])
            for place, i in enumerate(order):
                score = None if mode == "rank" or (mode == "some" and rng.random() < 0.3) else scores[i]
                rows.append((f"g{g}", s, None if mode == "score" else place, f"f{items[i]}", score))
    rows += rows[:5]
    weights = {"bm25": 1.0, "dense": 2.0, "llm": 0.5}
    got = {(r.instance_id, r.file_path): r.fused for r in fused(spark, rows, weights).collect()}
    exact = plain(rows, weights)
    assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) < 1e-6 for k in exact)
    for hot_rows in (0, 25):
        spread = {(r.instance_id, r.file_path): r.fused for r in fused(spark, rows, weights, hot_rows=hot_rows).collect()}
        assert spread == got


def test_a_wide_range_does_not_dominate(spark):
    rows = [("g", "bm25", i, f"f{i}", 1e9 / (i + 1)) for i in range(10)] + [("g", s, i, f"f{(i + 1) % 10}", 1 - i / 1000) for s in ("dense", "llm") for i in range(10)]
    assert R.first_items(fused(spark, rows)).first().file_path == "f1"


def test_nulls_ties_repeats_and_empty(spark):
    nan = float("nan")
    rows = [("g", "bm25", 0, "b", nan), ("g", "bm25", 0, "a", None), ("g", "bm25", None, "c", None), ("g", "BM25 ", 0, "a", None), ("g", "other", 0, "z", 1.0), (None, "bm25", 0, "a", 1.0), ("g", "bm25", 0, None, 1.0), ("g", "bm25", 0, "", 1.0), ("h", "llm", None, "x", float("inf")), ("h", "llm", None, "y", -1e308)]
    got = fused(spark, rows)
    assert {(r.instance_id, r.file_path) for r in got.collect()} == {("g", "a"), ("g", "b"), ("h", "x"), ("h", "y")}
    assert {r.instance_id: r.file_path for r in R.first_items(got).collect()} == {"g": "a", "h": "x"}
    assert {(r.file_path, r.position) for r in R.positions(got).collect()} == {("a", 1), ("b", 1), ("x", 1), ("y", 2)}
    assert fused(spark, []).count() == 0


def test_paths_are_spelled_from_the_root(spark):
    for path, root in {"./a/b.py": "a/b.py", "./x/b.py": "x/b.py", "/a/b.py": "a/b.py", "a/a/b.py": "a/b.py", "b/x.py": "x.py", "x\\y.py": "x/y.py", " x.py ": "x.py", "x//y/./z.py": "x/y/z.py", "ab/x.py": "ab/x.py", ".//c/x.py": "c/x.py", ".github/x.py": ".github/x.py"}.items():
        assert spark.createDataFrame([(path,)], "p string").select(R.root_relative(F.col("p"))).first()[0] == root, path
