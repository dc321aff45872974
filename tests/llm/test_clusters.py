import random
from datetime import datetime

import numpy as np

from mossline.llm import clusters as C

SCHEMA = "concept_id bigint, repo string, label string, member_function_ids array<string>, centroid array<float>, n_members int, built_at timestamp, cluster string"
T = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, T, "clash") for r in rows], SCHEMA)


def groups(spark, rows, **options):
    found = C.concept_clusters(frame(spark, rows), **options).collect()
    out = {}
    for r in found:
        out.setdefault(r.cluster, set()).add(r.concept_id)
    return sorted(map(sorted, out.values()))


def made(seed=1, n_groups=12, size=6):
    """Groups of rows with overlapping member sets and near centroids, and which row belongs where."""
    rng, rows, truth = random.Random(seed), [], {}
    for g in range(n_groups):
        base = [f"g{g}::m{i}" for i in range(10)]
        centre = np.random.default_rng(g).standard_normal(64)
        for nth in range(rng.randrange(1, size + 1)):
            k = len(rows)
            members = rng.sample(base, 8) + [f"x{rng.randrange(40)}"]
            vector = (centre + 0.15 * np.random.default_rng(1000 + k).standard_normal(64)) * rng.choice([1, 30])
            kind = rng.random() if nth else 0.5  # one row of each group has both, or nothing would tie the others together
            rows.append((k, "r", "utility helpers", None if kind < 0.2 else members, None if kind > 0.8 else [float(x) for x in vector]))
            truth.setdefault(g, set()).add(k)
    return rows, sorted(map(sorted, truth.values()))


def test_made_groups_are_found_also_when_blocks_are_divided(spark):
    rows, truth = made()
    assert groups(spark, rows) == truth
    assert groups(spark, rows, block_rows=3) == truth


def test_every_pair_above_the_threshold_is_an_edge(spark):
    rng = random.Random(4)
    sets = [(i, sorted(rng.sample(range(30), rng.randrange(2, 9))), 1) for i in range(120)]
    frame = spark.createDataFrame(sets, "id bigint, tokens array<int>, weight bigint")
    exact = {(a, b) for a, x, _ in sets for b, y, _ in sets if a < b and len(set(x) & set(y)) >= 2 and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.28}
    for block in (10_000, 20):
        got = [(r.a, r.b) for r in C.member_edges(frame, 0.28, block_rows=block).collect()]
        assert set(got) == exact and len(got) == len(exact)


def test_no_pair_of_a_group_larger_than_a_block_is_lost(spark):
    rng, size = random.Random(6), C.BLOCK_ROWS + 100
    sets = [(i, [-2, -1, *sorted(rng.sample(range(14), 3))], 1 + i % 3) for i in range(size)]
    rows = spark.createDataFrame(sets, "id bigint, tokens array<int>, weight bigint")
    x = np.zeros((size, 16), np.int64)
    for i, tokens, _ in sets:
        x[i, np.array(tokens) + 2] = 1
    common = x @ x.T
    near = np.triu(common >= 0.28 * (10 - common), 1)
    weight = np.array([w for *_, w in sets])
    found = C.member_edges(rows, 0.28).toPandas()
    assert len(found) == near.sum() and near[found.a, found.b].all() and not found.duplicated(["a", "b"]).any()
    assert (found.weight_a == weight[found.a]).all() and (found.weight_b == weight[found.b]).all()


def test_pointers_lead_to_the_densest(spark):
    nodes = spark.createDataFrame([(i, 1, 0) for i in range(6)], "id bigint, weight bigint, grade int")
    edges = spark.createDataFrame([(0, 1, 0.1, 1, 1), (1, 2, 0.2, 1, 1), (2, 3, 0.3, 1, 1)], "a bigint, b bigint, distance double, weight_a bigint, weight_b bigint")
    up = {r.id: (r.to, r.density) for r in C.denser_pointers(nodes, edges).collect()}
    assert up == {0: (1, 2), 1: (2, 3), 2: (2, 3), 3: (2, 2), 4: (4, 1), 5: (5, 1)}
    peaks = {r.id: r.peak for r in C.followed(C.denser_pointers(nodes, edges)).collect()}
    assert peaks == {0: 2, 1: 2, 2: 2, 3: 2, 4: 4, 5: 5}


def test_nulls_repeats_and_unusable_centroids(spark):
    m, v = [f"f{i}" for i in range(6)], [1.0] + [0.0] * 63
    rows = [
        (1, "r", None, m, None), (1, "r", None, m, None), (2, "r", "x", [*m, None, "", "f0"], [float("nan")] * 64), (3, "r", "x", None, v), (4, "r", "x", [], v), (5, "s", "x", None, v),
        (6, "r", "x", None, [0.0] * 64), (7, "r", "x", None, None), (8, "r", "x", [None, ""], [1.0] * 32), (None, "r", "x", m, v), (9, None, "x", m, None), (10, None, "x", m, v),
    ]
    assert groups(spark, rows) == [[1, 2], [3, 4], [5], [6], [7], [8], [9, 10]]
    assert groups(spark, []) == []


def test_pairs_and_descriptions(spark):
    rows, truth = made(seed=3)
    found = C.concept_clusters(frame(spark, rows)).cache()
    pairs = {(r.concept_a, r.concept_b) for r in C.pairs_of(found).collect()}
    assert pairs == {(a, b) for g in truth for a in g for b in g if a < b}
    described = C.described(found, frame(spark, rows)).collect()
    assert sorted(r["size"] for r in described) == sorted(map(len, truth))
    assert all(1 <= len(r.typical_concepts) <= 5 and r.label == "utility helpers" for r in described)


def test_directions_reach_almost_all_near_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 64))
    near = base + 0.25 * rng.standard_normal((300, 64))
    rows = [(i, 7, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate([base, near]))]
    records = spark.createDataFrame(rows, "id bigint, scope bigint, vector array<float>, weight bigint")
    found = {(r.a, r.b) for r in C.direction_edges(records.filter("id >= 300"), records, 0.85, 64).collect()}
    unit = np.concatenate([base, near])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    exact = {(min(a, b), max(a, b)) for a in range(300, 600) for b in np.flatnonzero(unit[a] @ unit.T >= 0.85) if a != b}
    assert found <= exact and len(found) >= 0.95 * len(exact)


def test_block_sizes_do_not_change_the_clusters_of_a_crowded_group(spark):
    rng = random.Random(9)
    rows = [(i, "r", None, [f"shared{j}" for j in sorted(rng.sample(range(8), 5))] + [f"own{i}::{j}" for j in range(3)], None) for i in range(300)]
    at_once = groups(spark, rows, block_rows=10**9)
    assert groups(spark, rows, block_rows=150) == groups(spark, rows, block_rows=3) == at_once


def test_peaks_are_chosen_by_distance_and_density(spark):
    nodes = spark.createDataFrame([(i, 1 + i % 2, 0) for i in range(5)], "id bigint, weight bigint, grade int")
    edges = spark.createDataFrame([(0, 1, 0.1, 1, 2), (1, 2, 0.5, 2, 1), (2, 3, 0.2, 1, 2), (3, 4, 0.6, 2, 1)], "a bigint, b bigint, distance double, weight_a bigint, weight_b bigint")
    peaks = lambda *how: {r.id for r in C.denser_pointers(nodes, edges, *how).collect() if r.to == r.id}
    assert peaks() == {2}
    assert peaks(0.4) == {1, 2, 4}
    assert peaks(0.4, 4) == {1, 2}


def test_large_clusters_are_paired_in_tiles(spark):
    clusters = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(99, 7)], "concept_id bigint, cluster bigint")
    exact = sorted((a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3)
    for block in (4, 2_000):
        assert sorted(map(tuple, C.pairs_of(clusters, block_rows=block).collect())) == exact


def test_hashes_grow_with_the_records_and_still_find_near_vectors(spark):
    assert [C.bits_for(n) for n in (0, 1 << 18, (1 << 18) + 1, 1 << 20, 1 << 40)] == [12, 12, 13, 14, 18]
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 64))
    other = rng.standard_normal((400, 64))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(base)
    other = unit(other - (other * base).sum(1, keepdims=True) * base)
    near = 0.85 * base + np.sqrt(1 - 0.85**2) * other
    rows = spark.createDataFrame([(i, 5, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]))], "id bigint, scope bigint, vector array<float>")
    for bits in (12, 15, 18):
        keys = C.direction_keys(rows.filter("id < 400"), 64, True, bits).selectExpr("key", "id + 400 as id").join(C.direction_keys(rows.filter("id >= 400"), 64, False, bits), ["key", "id"])
        assert keys.select("id").distinct().count() >= 0.94 * 400
