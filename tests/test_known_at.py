import random
from datetime import datetime, timedelta

from mossline.operators import known_at as K

T0 = datetime(2022, 3, 1, 12)
EVENTS = "sha string, repo string, file_path string, at timestamp, version_id string"
VERSIONS = "version_id bigint, repo string, file_path string, valid_from timestamp, recorded_at timestamp, at string"


def run(spark, events, versions):
    e = spark.createDataFrame(events, EVENTS)
    v = spark.createDataFrame(versions, VERSIONS)
    got = K.attributes_known_at(e.drop("version_id") if not events else e, v, event_keys=["sha", "file_path"], entity=["repo", "file_path"], event_time="at", valid_from="valid_from", known_from="recorded_at", version_id="version_id")
    assert got.columns == ["sha", "file_path", "version_id"]
    return sorted(map(tuple, got.collect()))


def expected(events, versions):
    out = set()
    for sha, repo, path, at, _ in events:
        fit = [(v[3], v[4], v[0]) for v in versions if repo is not None and (v[1], v[2]) == (repo, path) and at and v[3] and v[4] and v[3] <= at and v[4] <= at]
        if fit:
            out.add((sha, path, max(fit)[2]))
    return sorted(out)


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    when = lambda: None if rng.random() < 0.05 else T0 + timedelta(hours=rng.choice([0, 1, 2, rng.randrange(40_000)]), microseconds=rng.randrange(3))
    versions = [(i, "r", rng.choice("ab"), when(), when(), "x") for i in range(300)]
    versions += versions[:40]
    events = [(f"s{i}", "r", rng.choice("abc"), when(), "clash") for i in range(400)]
    assert run(spark, events, versions) == expected(events, versions)


def test_edges_of_intervals_and_extreme_times(spark):
    day = timedelta(days=1)
    versions = [(1, "r", "f", T0, T0, ""), (2, "r", "f", T0 + day, T0 + day, ""), (3, "r", "f", T0, T0 + 3 * day, ""), (4, "r", "g", datetime(1700, 1, 1), datetime(1700, 1, 1), "")]
    events = [("a", "r", "f", T0, ""), ("b", "r", "f", T0 - timedelta(microseconds=1), ""), ("c", "r", "f", T0 + day, ""), ("d", "r", "f", T0 + 9 * day, ""), ("e", "r", "g", datetime(2400, 1, 1), "")]
    assert run(spark, events, versions) == expected(events, versions) == [("a", "f", 1), ("c", "f", 2), ("d", "f", 2), ("e", "g", 4)]


def test_nulls_ties_repeats_and_empty_tables(spark):
    versions = [(1, "r", "f", T0, T0, ""), (2, "r", "f", T0, T0, ""), (2, "r", "f", T0, T0, ""), (9, "r", "f", None, T0, ""), (8, None, "f", T0, T0, "")]
    events = [("a", "r", "f", T0, ""), ("a", "r", "f", None, ""), ("b", None, "f", T0, ""), ("c", "r", None, T0, "")]
    assert run(spark, events, versions) == [("a", "f", 2)]
    assert run(spark, [], versions) == [] and run(spark, events, []) == []


def test_commit_files_once_per_sha_and_file(spark):
    rows = [("s", "r", T0, ["a", "a", None, "b"], T0, 1), ("s", "r", T0, ["a", "b"], T0 + timedelta(days=1), 1), ("t", "r", None, ["a"], T0, 1), ("u", "r", T0, None, T0, 1), ("v", "r", T0, [], T0, 1)]
    commits = spark.createDataFrame(rows, "sha string, repo string, authored_at timestamp, files array<string>, ingested_at timestamp, version_id int")
    assert sorted((r.sha, r.file_path) for r in K.commit_files(commits).collect()) == [("s", "a"), ("s", "b")]


def test_nodes_cover_an_interval_and_little_more(spark):
    rng = random.Random(1)
    pairs = [(a, a + rng.choice([1, 10**6, 10**9, 10**11, 10**13]) * rng.randrange(1, 400)) for a in (rng.randrange(-(10**15), 10**15) for _ in range(200))] + [(0, K.NEVER), (-(10**18), 10**18)]
    rows = spark.createDataFrame(pairs, "s bigint, e bigint").selectExpr("s", "e", f"{K.nodes_of_interval('s', 'e')} as n").collect()
    for r in rows:
        low, high = (min(max((x + K.ORIGIN) >> K.LEAF_BITS, 0), K.TOP_LEAF) for x in (r.s, r.e - 1))
        spans = sorted((n.node << (2 * n.level), (n.node + 1) << (2 * n.level)) for n in r.n)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and len({n.level for n in r.n}) <= K.SPAN and len(r.n) <= 14
        assert spans[0][0] <= low and high < spans[-1][1]
        assert spans[-1][1] - spans[0][0] <= 1.5 * (high - low + 1) + 1 or high - low > K.TOP_LEAF // 64


def test_a_hot_entity_meets_few_neighbours(spark):
    versions = [(i, "r", "f", T0 + timedelta(seconds=7 * i), T0 + timedelta(seconds=7 * i), "") for i in range(3000)]
    events = [(f"s{i}", "r", "f", T0 + timedelta(seconds=7 * i + 3), "") for i in range(3000)]
    assert run(spark, events, versions) == sorted((f"s{i}", "f", i) for i in range(3000))
