"""Unified diffs to hunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
HUNKS = "instance_id string, file_path string, hunk int, start_line int, end_line int, changed_line int"


def hunks_of(patch: str) -> list[tuple[str, int, int, int, int | None]]:
    """(file, hunk number, first and last line before the change, first changed line) of each hunk.

    The file is that after the change, or before it for a deletion. The first changed line is numbered as before the
    change if it was removed, as after it if it was added. Broken hunks end where the next header begins.
    """
    found: list[tuple[str, int, int, int, int | None]] = []
    old, path, number = "", "", 0
    lines = patch.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if line.startswith("--- "):
            old = line[4:].split("\t")[0].strip()
        elif line.startswith("+++ "):
            new = line[4:].split("\t")[0].strip()
            path, number = (new if new != "/dev/null" else old), 0
            path = re.sub(r"^[ab]/", "", path)
        elif (m := HUNK.match(line)) and path:
            start, length, target = int(m[1]), int(m[2] or 1), int(m[3])
            source, changed, left, right = start, None, int(m[2] or 1), int(m[4] or 1)
            while i + 1 < len(lines) and (left > 0 or right > 0) and not HUNK.match(lines[i + 1]):
                i += 1
                mark = lines[i][:1]
                if mark == "-":
                    changed = changed if changed is not None else source
                    source, left = source + 1, left - 1
                elif mark == "+":
                    changed = changed if changed is not None else target
                    target, right = target + 1, right - 1
                elif mark != "\\":
                    source, target, left, right = source + 1, target + 1, left - 1, right - 1
            found.append((path, number, start, start + max(1, length) - 1, changed))
            number += 1
        i += 1
    return found


def patch_hunks(issues: DataFrame) -> DataFrame:
    """instance_id, file_path, hunk, start_line, end_line, changed_line: the hunks of Python files in each patch, once per issue."""
    rows = issues.select("instance_id", "patch").filter("instance_id is not null and patch is not null").dropDuplicates(["instance_id", "patch"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, *h) for key, patch in zip(batch["instance_id"], batch["patch"], strict=True) for h in hunks_of(patch)]
            yield pd.DataFrame(out, columns=["instance_id", "file_path", "hunk", "start_line", "end_line", "changed_line"]).astype({"changed_line": "Int32"})

    return rows.mapInPandas(run, HUNKS).filter(F.col("file_path").endswith(".py")).dropDuplicates()
