"""Queries of the core training-data operators over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mossline.operators import known_at, log_templates
from mossline.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_at.commit_file_versions(table(spark, sf_dir, "commits"), table(spark, sf_dir, "file_versions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates.log_entries(table(spark, sf_dir, "pipeline_log"), table(spark, sf_dir, "log_runs"))


def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mined template: its symbols and how many lines it covers."""
    found = log_templates.mined_templates(table(spark, sf_dir, "pipeline_log"), "message")
    return spark.createDataFrame([("".join(t.symbols), t.count) for t in found.values()], "template string, n_lines bigint")


P3_FOUND = """
WITH delivered AS (
  SELECT sha, repo, authored_at, files, row_number() OVER (PARTITION BY sha ORDER BY ingested_at DESC) AS k FROM commits WHERE authored_at IS NOT NULL
), events AS (
  SELECT DISTINCT sha, repo, authored_at, f AS file_path FROM (SELECT sha, repo, authored_at, unnest(files) AS f FROM delivered WHERE k = 1)
), best AS (
  SELECT e.sha, e.file_path, v.version_id,
         row_number() OVER (PARTITION BY e.sha, e.file_path ORDER BY v.valid_from DESC, v.recorded_at DESC, v.version_id DESC) AS k
  FROM events e JOIN file_versions v ON v.repo = e.repo AND v.file_path = e.file_path AND v.valid_from <= e.authored_at AND v.recorded_at <= e.authored_at
)
SELECT sha, file_path, version_id FROM best WHERE k = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_templates, p3_found)}
ORACLES = {"p3_found": P3_FOUND}
