"""Best-first search of the code graph, one instance and run at a time.

Each step depends on the one before, so a search runs in one place; instances and runs are what is spread out. A search
is shipped the neighbourhood of its seeds only; where it gets to the border of that, it asks for what it needs next and is
run again with it, so results are those of a search that sees the whole graph.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossline.runtime import cut


@dataclass(frozen=True)
class Limits:
    """Weights of the priority and the budgets of a search (fixed values, the defaults that results depend on)."""

    sem: float = 1.0
    chain: float = 0.8
    seed: float = 0.6
    recent: float = 0.2
    depth: float = 0.4
    visited: float = 2.0
    chain_decay: int = 10
    drill_score: float = 7.0
    iterations: int = 30
    reasoning_calls: int = 12
    queue: int = 1_000
    reason_every: int = 3
    reason_batch: int = 9
    output: int = 15
    drilled: int = 5
    children: int = 3


@dataclass
class Graph:
    """What a search sees: functions with scores, edges by type, statements of functions with their scores.

    Nodes without a score are classes and files: reading one of them reads its best contained functions. `opened` are the
    nodes whose edges are known, None if all are.
    """

    scores: dict[str, float]
    edges: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    statements: dict[str, list[tuple[int, float]]] = field(default_factory=dict)
    opened: set[str] | None = None


class NeedsMore(Exception):
    """Raised where a search comes to nodes whose edges it doesn't know; names them."""

    def __init__(self, nodes: list[str]) -> None:
        super().__init__(nodes)
        self.nodes = nodes


@dataclass
class Found:
    distance: int = 0
    chain_score: float = 0.0
    chain_step: int = -1
    chain: list[str] = field(default_factory=list)
    drilled: bool = False
    lines: list[int] = field(default_factory=list)


#: Given a batch of node ids and their scores: (node, chain score 0 to 10), also with the chain's steps, and suggested nodes.
Reasoner = Callable[[list[str], dict[str, float]], tuple[list[tuple], list[str]]]


def bounded_reasoner(batch: list[str], scores: dict[str, float]) -> tuple[list[tuple], list[str]]:
    """Stands in for a model: chain scores in proportion to the best similarity of the batch, a chain of the function's name, no suggestions."""
    most = max((scores.get(n, 0.0) for n in batch), default=0.0)
    return [(n, round(10 * max(0.0, scores.get(n, 0.0) / most), 6), [n.rsplit("::", 1)[-1]]) for n in batch] if most > 0 else [], []


def silent_reasoner(batch: list[str], scores: dict[str, float]) -> tuple[list[tuple], list[str]]:
    """No chains and no suggestions: the search goes by similarities and priors alone."""
    return [], []


def search(seeds: Iterable[tuple[str, float]], graph: Graph, limits: Limits = Limits(), reasoner: Reasoner = bounded_reasoner, expansions: tuple[str, ...] = ("invoke", "inherit"), details: dict[str, Found] | None = None) -> tuple[list[tuple[str, float, int, float, list[int]]], str, int]:
    """((node, score, distance, chain score, lines) best first, why it ended, iterations).

    `details` is filled with all that was found. An instance of NeedsMore is raised where a node's edges are needed that
    aren't known; it names that node and all that are queued.
    """
    heap: list = []
    visited: set[str] = set()
    distances: dict[str, int] = {}
    found: dict[str, Found] = {} if details is None else details
    waiting: list[str] = []
    step = pushed = calls = 0

    def priority(node: str, depth: int, prior: float, boost: float) -> float:
        if node not in graph.scores:
            return -1.0
        own, chain = found.get(node), 0.0
        if own is not None and own.chain_step >= 0:
            chain = own.chain_score / 10 * max(0.0, 1 - (step - own.chain_step) / max(1, limits.chain_decay))
        return limits.sem * graph.scores[node] + limits.chain * chain + limits.seed * prior + limits.recent - limits.depth * max(0, depth - 3) - limits.visited * (node in visited) + boost

    def push(kind: str, node: str, depth: int, prior: float, boost: float = 0.0) -> None:
        nonlocal pushed
        if len(heap) < limits.queue:
            pushed += 1
            heapq.heappush(heap, (-priority(node, depth, prior, boost), pushed, kind, node, depth, prior))

    def value(node: str) -> float:
        own = found[node]
        return limits.sem * graph.scores[node] + limits.chain * own.chain_score / 10 - limits.depth * max(0, own.distance - 3)

    def best(n: int) -> list[str]:
        return sorted((x for x in found if x in graph.scores), key=lambda x: -value(x))[:n]

    def enqueue(node: str, depth: int, prior: float) -> None:
        near = depth + 1 if node not in distances else min(depth + 1, distances[node] + 1)
        distances[node] = min(distances.get(node, near), near)
        push("read", node, near, prior * 0.85)

    def reason() -> None:
        nonlocal calls
        batch, waiting[:] = waiting[: limits.reason_batch], waiting[limits.reason_batch :]
        chains, suggested = reasoner(batch, graph.scores)
        calls += 1
        for node, score, *steps in chains:
            if node not in graph.scores:
                continue
            own = found.setdefault(node, Found())
            own.chain_score, own.chain_step, own.chain = score, step, list(steps[0]) if steps else []
            if score >= limits.drill_score:
                push("drill", node, own.distance, 0.5)
        for node in suggested:
            if node in graph.scores:
                push("read", node, distances.get(node, 2), 0.4, 0.5)

    for node, prior in seeds:
        distances[node] = 0
        push("read", node, 0, prior)
    same, last, ended = 0, (), ""
    while heap and step < limits.iterations:
        step += 1
        _, _, kind, node, depth, prior = heapq.heappop(heap)
        if kind == "read" and node in visited:
            continue
        unknown = graph.opened is not None and node not in graph.opened
        if unknown and (kind in expansions or (kind == "read" and node not in graph.scores)):
            raise NeedsMore(sorted({node} | {n for *_, n, _, _ in heap if n not in graph.opened}))
        if kind == "read":
            if node in graph.scores:
                visited.add(node)
                found.setdefault(node, Found()).distance = depth
                for i, name in enumerate(expansions):
                    push(name, node, depth, prior * (0.9 if i == 0 else 0.7))
                waiting.append(node)
            else:
                inside = [n for n in graph.edges.get("contain", {}).get(node, ()) if n in graph.scores]
                for child in sorted(inside, key=lambda n: -graph.scores[n])[: limits.children]:
                    enqueue(child, depth, prior)
        elif kind == "drill":
            found.setdefault(node, Found()).drilled = True
            found[node].lines = [n for n, _ in sorted(graph.statements.get(node, []), key=lambda s: (-s[1], s[0]))[: limits.drilled]]
        else:
            for neighbour in graph.edges.get(kind, {}).get(node, ()):
                enqueue(neighbour, depth, prior)
        if step % limits.reason_every == 0 and waiting and calls < limits.reasoning_calls:
            reason()
        now = tuple(best(3))
        same, last = (same + 1, last) if now == last else (0, now)
        if same >= 3 and step >= 6:
            ended = "stable"
            break
    ended = ended or ("iter_cap" if step >= limits.iterations else "queue_empty")
    if waiting and calls < limits.reasoning_calls:
        reason()
    return [(n, value(n), found[n].distance, found[n].chain_score, found[n].lines) for n in best(limits.output)], ended, step


RESULT = "instance_id {instance}, run int, rank int, node_id string, score double, distance int, chain_score double, chain array<string>, drilled boolean, ended string, iterations int"
#: What a group of rows is made of.
ROW = {"part": "string", "run": "int", "a": "string", "b": "string", "kind": "string", "x": "double", "n": "int", "v": "array<double>"}


def both_ways(edges: DataFrame, kinds: tuple[str, ...] = ("inherit",)) -> DataFrame:
    """The edges, and those of some kinds also from their end to their start: a search goes up and down them."""
    scope = [c for c in edges.columns if c == "repo"]
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    ways = F.when(F.col("edge_type").isin(*kinds), F.array(ends("src", "dst"), ends("dst", "src"))).otherwise(F.array(ends("src", "dst")))
    return edges.select(*scope, "edge_type", F.explode(ways).alias("e")).select(*scope, "e.src", "e.dst", "edge_type").distinct()


def traversed(
    seeds: DataFrame, edges: DataFrame, scores: DataFrame | None = None, *, vectors: DataFrame | None = None, queries: DataFrame | None = None,
    limits: Limits = Limits(), reasoner: Reasoner = bounded_reasoner,
) -> DataFrame:
    """instance_id, run, rank (from 1), node_id, score, distance, chain_score, chain, drilled, ended, iterations: the best functions of each search.

    seeds: instance_id, run, node_id, prior, rank; edges: src, dst, edge_type; both with repo where node ids are those of
    several repositories. Scores of functions are given by `scores` (instance_id, node_id, sem and, if runs differ, run), or are the
    dot products of `vectors` (repo, node_id, vector) with `queries` (instance_id, run, vector); a function without any
    scores 0. What lies one edge from a seed, and the edges of that, are shipped at first, once for all runs of the
    instance; searches that need more get what lies as far around the nodes that they name, in rounds of at most as many
    as iterations. Runs of equal seeds and scores are searched once.
    """
    scope = [c for c in ("repo",) if c in edges.columns and c in seeds.columns]
    links = cut(both_ways(edges))
    here = ["instance_id", *scope, "node_id"]
    steps = links.select(*scope, F.col("src").alias("node_id"), "dst", "edge_type")
    instance = seeds.schema["instance_id"].dataType.simpleString()
    schema = RESULT.format(instance=instance)

    def rows(part: str, frame: DataFrame, **columns: str) -> DataFrame:
        return frame.select("instance_id", F.lit(part).alias("part"), *[(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in ROW.items() if c != "part"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, begin, own_of, asked = Graph({}, opened=set()), {}, {}, {}
        names, vector = [], []
        for part, number, a, b, kind, x, n, v in pdf[list(ROW)].itertuples(index=False, name=None):
            if part == "seed":
                begin.setdefault(int(number), []).append((int(n), a, x))
            elif part == "node":
                graph.scores[a] = 0.0
                if v is not None:
                    names.append(a)
                    vector.append(v)
            elif part == "own":
                own_of.setdefault(-1 if pd.isna(number) else int(number), {})[a] = x
            elif part == "query":
                asked[int(number)] = v
            elif part == "open":
                graph.opened.add(a)
            else:
                graph.edges.setdefault(kind, {}).setdefault(a, []).append(b)
        for targets in graph.edges.values():
            for own in targets.values():
                own.sort()
        matrix = np.array(vector, dtype=np.float64) if vector else None
        known: dict[tuple, tuple] = {}
        out, key = [], pdf["instance_id"].iloc[0]
        for number, own in sorted(begin.items()):
            start = [(a, x) for _, a, x in sorted(own)]
            scored = own_of.get(number, own_of.get(-1, {}))
            if matrix is not None and asked.get(number) is not None:
                scored = dict(zip(names, np.round(matrix @ np.array(asked[number], dtype=np.float64), 6).tolist(), strict=True))
            alike = (tuple(start), tuple(sorted(scored.items())))
            if alike not in known:
                details: dict[str, Found] = {}
                try:
                    found = search(start, Graph(graph.scores | {n: x for n, x in scored.items() if n in graph.scores}, graph.edges, {}, graph.opened), limits, reasoner, details=details)
                    known[alike] = (*found, details)
                except NeedsMore as more:
                    known[alike] = ([(n, None, None, None, None) for n in more.nodes], None, None, {})
            best, ended, iterations, details = known[alike]
            for i, (node, score, distance, chain_score, _) in enumerate(best):
                whole = ended is not None
                out.append((key, number, i + 1 if whole else 0, node, score, distance, chain_score, details[node].chain if whole else None, details[node].drilled if whole else None, ended, iterations))
        frame = pd.DataFrame(out, columns=["instance_id", "run", "rank", "node_id", "score", "distance", "chain_score", "chain", "drilled", "ended", "iterations"])
        if (frame["rank"] == 0).any():  # all runs of an instance are searched again
            frame = frame[frame["rank"] == 0].drop_duplicates("node_id")
        return frame.astype({"distance": "Int32", "iterations": "Int32", "drilled": "boolean"})

    active, opened = seeds, None
    wanted = seeds.select(*here).distinct()
    done = []
    for _ in range(limits.iterations + 1):
        near = wanted.join(steps, [*scope, "node_id"]).select("instance_id", *scope, F.col("dst").alias("node_id"))
        opened = cut((wanted.union(near) if opened is None else opened.union(wanted).union(near)).distinct())
        own = cut(opened.join(steps, [*scope, "node_id"]))
        seen = opened.union(own.select("instance_id", *scope, F.col("dst").alias("node_id"))).distinct()
        parts = rows("seed", active, run="run", a="node_id", x="prior", n="rank").union(rows("open", opened, a="node_id")).union(rows("edge", own, a="node_id", b="dst", kind="edge_type"))
        if vectors is not None:
            parts = parts.union(rows("node", seen.join(vectors.select(*scope, "node_id", "vector"), [*scope, "node_id"], "left"), a="node_id", v="vector"))
            parts = parts.union(rows("query", queries.join(active.select("instance_id").distinct(), "instance_id", "left_semi"), run="run", v="vector"))
        else:
            parts = parts.union(rows("node", seen, a="node_id"))
            own_scores = seen.join(scores, ["instance_id", "node_id"])
            parts = parts.union(rows("own", own_scores, a="node_id", x="sem", **({"run": "run"} if "run" in scores.columns else {})))
        found = cut(parts.groupBy("instance_id").applyInPandas(run, schema))
        done.append(found.filter("rank > 0"))
        more = found.filter("rank = 0")
        if more.isEmpty():
            break
        asking = more.select("instance_id").distinct()
        active, opened = (cut(x.join(asking, "instance_id", "left_semi")) for x in (active, opened))
        wanted = more.select("instance_id", "node_id").distinct()
        if scope:
            wanted = wanted.join(active.select("instance_id", *scope).distinct(), "instance_id").select(*here)
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole


def drilled_lines(found: DataFrame, statements: DataFrame, queries: DataFrame, *, encode: Callable[[DataFrame], DataFrame], top: int = Limits.drilled) -> DataFrame:
    """instance_id, run, node_id, line: of each function that a search drilled into, the statements nearest to the run's report.

    found: as of `traversed`, with repo; statements: repo, node_id, line, text; queries: instance_id, run, vector; encode gives `vector` for
    the column text. Ties go to the earlier line.
    """
    from pyspark.sql import Window

    from mossline.functions.vectors import dot

    chosen = found.filter("drilled").select("instance_id", "run", "repo", "node_id")
    own = statements.join(chosen.select("repo", "node_id").distinct(), ["repo", "node_id"], "left_semi").select("repo", "node_id", "line", "text")
    scored = chosen.join(encode(own), ["repo", "node_id"]).join(queries.select("instance_id", "run", F.col("vector").alias("_q")), ["instance_id", "run"])
    order = Window.partitionBy("instance_id", "run", "node_id").orderBy(F.desc("_s"), "line")
    best = scored.withColumn("_s", F.round(dot(F.col("vector"), F.col("_q")), 6)).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top)
    return best.select("instance_id", "run", "node_id", "line")
