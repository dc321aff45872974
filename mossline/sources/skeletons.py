"""Python files to skeletons: declarations, call sites and statements of a file in one pass.

The parser is the standard library's; a file that it rejects gives a row with empty lists and parse_error. Only direct
children count: a definition under `if` or `try`, a decorated class's siblings and nested classes keep to what the
skeleton is for, an outline.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossline.functions.text import SKIPPED_DIRS

FUNCTION = "struct<name:string,qualname:string,start_line:int,end_line:int,docstring:string,signature:string>"
CLASS = f"struct<name:string,start_line:int,end_line:int,bases:array<string>,docstring:string,methods:array<{FUNCTION}>>"
CALL = "struct<caller:string,callee:string,line:int>"
STATEMENT = "struct<function:string,line:int,text:string,defs:array<string>,uses:array<string>>"
SKELETON = f"repo string, file_path string, language string, imports array<string>, classes array<{CLASS}>, functions array<{FUNCTION}>, calls array<{CALL}>, statements array<{STATEMENT}>, n_lines int, parse_error boolean"
DOC_CHARS, STATEMENT_CHARS = 200, 200


def summary_line(node: ast.AST) -> str:
    doc = ast.get_docstring(node, clean=False) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module)) else None
    return (doc or "").strip().split("\n")[0].strip()[:DOC_CHARS]


def raw_params(node, lines: list[str]) -> str:
    """The text of a function's parameters with their brackets, without the return annotation."""
    head = "\n".join(lines[node.lineno - 1 : node.body[0].lineno])
    start = head.find("(", head.find(node.name))
    depth = 0
    for i in range(start, len(head)) if start >= 0 else ():
        depth += (head[i] in "([{") - (head[i] in ")]}")
        if depth == 0:
            return head[start : i + 1]
    return f"({ast.unparse(node.args)})"


def names_of(node: ast.AST, context: type) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, context)}


def statements_of(qualname: str, node, lines: list[str]) -> list[tuple]:
    """(function, line, text, defs, uses) of each top-level statement of a body; a for defines its target only."""
    found = []
    for s in node.body:
        if isinstance(s, (ast.For, ast.AsyncFor)):
            defs, uses = names_of(s.target, ast.Store), names_of(s.iter, ast.Load)
        else:
            defs, uses = names_of(s, ast.Store), names_of(s, ast.Load)
        if isinstance(s, ast.AugAssign):
            uses |= {n.id for n in ast.walk(s.target) if isinstance(n, ast.Name)}
        found.append((qualname, s.lineno, lines[s.lineno - 1].strip()[:STATEMENT_CHARS] if s.lineno <= len(lines) else "", sorted(defs), sorted(uses)))
    return found


def calls_of(qualname: str, node) -> list[tuple[str, str, int]]:
    """(caller, callee as written, line) of the calls in a body; nested definitions are callers of their own."""
    found, stack = [], [(qualname, child) for child in ast.iter_child_nodes(node)]
    while stack:
        owner, n = stack.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            owner = f"{owner}.{n.name}"
        if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            found.append((owner, ast.unparse(n.func), n.lineno))
        stack.extend((owner, c) for c in ast.iter_child_nodes(n))
    return found


def skeleton(text: str) -> dict:
    """The parts of a skeleton of one file."""
    out = {"imports": [], "classes": [], "functions": [], "calls": [], "statements": [], "n_lines": text.count("\n") + 1, "parse_error": False}
    try:
        tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out | {"parse_error": True}
    lines = re.split(r"\r\n|\r|\n", text)

    def function(node, owner: str = "") -> tuple:
        qualname = f"{owner}.{node.name}" if owner else node.name
        out["calls"] += calls_of(qualname, node)
        out["statements"] += statements_of(qualname, node, lines)
        return (node.name, qualname, node.lineno, node.end_lineno, summary_line(node), raw_params(node, lines))

    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out["imports"].append(ast.get_source_segment(text.lstrip("﻿"), node) or ast.unparse(node))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append(function(node))
        elif isinstance(node, ast.ClassDef):
            methods = [function(n, node.name) for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
            out["classes"].append((node.name, node.lineno, node.end_lineno, [ast.unparse(b) for b in node.bases], summary_line(node), methods))
    return out


def skeletons(files: DataFrame) -> DataFrame:
    """One row per file (repo, file_path, content) with content; of repeated files that ingested last, where that is known."""
    if "ingested_at" in files.columns:
        files = files.groupBy("repo", "file_path").agg(F.max_by("content", F.struct("ingested_at", F.xxhash64("content"))).alias("content"))
    rows = files.select("repo", "file_path", "content").filter("file_path is not null and content is not null and content <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [skeleton(t) for t in batch["content"]]
            columns = {c: [p[c] for p in parsed] for c in ("imports", "classes", "functions", "calls", "statements", "n_lines", "parse_error")}
            names = dict(classes="name start_line end_line bases docstring methods", functions="name qualname start_line end_line docstring signature", calls="caller callee line", statements="function line text defs uses")
            for column, fields in names.items():
                columns[column] = [[dict(zip(fields.split(), x, strict=True)) for x in own] for own in columns[column]]
            for own in columns["classes"]:
                for c in own:
                    c["methods"] = [dict(zip(names["functions"].split(), m, strict=True)) for m in c["methods"]]
            yield pd.DataFrame({"repo": batch["repo"], "file_path": batch["file_path"], "language": "python", **columns})[[x.split()[0] for x in re.split(r", (?=\w+ (?:string|int|boolean|array))", SKELETON)]]

    return rows.mapInPandas(run, SKELETON)


def python_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """repo, file_path, content of all *.py files below a folder, without those in skipped directories.

    Only directories below the root count for skipping, so a checkout inside a folder named build is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    base = root.rstrip("/") + "/"
    relative = F.element_at(F.split("path", "\\Q" + base + "\\E", 2), -1)
    return (
        found.select(F.lit(repo).alias("repo"), relative.alias("file_path"), F.decode("content", "UTF-8").alias("content"))
        .filter(~F.arrays_overlap(F.split("file_path", "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRS])))
    )


def write_skeletons(rows: DataFrame, path: str) -> None:
    """JSON lines in the order of repositories and paths."""
    rows.orderBy("repo", "file_path").write.mode("overwrite").json(path)


def read_skeletons(spark: SparkSession, path: str) -> DataFrame:
    """Skeletons written as JSON lines; blank lines are skipped."""
    return spark.read.schema(SKELETON).json(path)


#: Imports of an outline, and characters of a docstring in it.
OUTLINE_IMPORTS, OUTLINE_DOC_CHARS = 50, 120


def outline_text(rows: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """repo, file_path, outline: a skeleton as compact text for ranking and prompts. summaries: repo, file_path, summary of files that have one."""

    def quoted(indent: str, doc: Column) -> Column:
        return F.when(doc != "", F.concat(F.lit(f'{indent}"""'), F.substring(doc, 1, OUTLINE_DOC_CHARS), F.lit('"""')))

    def function(indent: str):
        return lambda f: F.concat_ws("\n", F.concat(F.lit(f"{indent}def "), f["name"], f["signature"]), quoted(indent + "  ", f["docstring"]))

    def part(name: str, each) -> Column:
        return F.when(F.size(name) > 0, F.array_join(F.transform(name, each), "\n"))

    def whole_class(c: Column) -> Column:
        bases = F.when(F.size(c["bases"]) > 0, F.concat(F.lit("("), F.array_join(c["bases"], ", "), F.lit(")"))).otherwise("")
        methods = F.when(F.size(c["methods"]) > 0, F.array_join(F.transform(c["methods"], function("  ")), "\n"))
        return F.concat_ws("\n", F.concat(F.lit("class "), c["name"], bases), quoted("  ", c["docstring"]), methods)

    said = F.lit(None).cast("string") if summaries is None else F.when(F.col("summary") != "", F.concat(F.lit("SUMMARY: "), "summary"))
    joined = rows if summaries is None else rows.join(summaries.select("repo", "file_path", "summary"), ["repo", "file_path"], "left")
    imports = F.when(F.size("imports") > 0, F.concat(F.lit("IMPORTS: "), F.array_join(F.slice("imports", 1, OUTLINE_IMPORTS), ", ")))
    return joined.select("repo", "file_path", F.concat_ws("\n", F.concat(F.lit("FILE: "), "file_path"), said, imports, part("classes", whole_class), part("functions", function(""))).alias("outline"))
