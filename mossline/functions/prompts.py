"""Prompts as columns, the messages around them, and short drawings of candidates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that a prompt takes of each part. The report is longer where files are ranked.
REPORT_CHARS, RANKED_REPORT_CHARS, CODE_CHARS, OUTLINE_CHARS, SYMPTOM_CHARS, DRAWING_CHARS, CANDIDATE_CHARS = 6_000, 8_000, 1_500, 600_000, 2_000, 4_000, 60_000
# What makes a model think, and parts of the names of models that always or never do.
THINKING = {"enable_thinking": True, "thinking": True}
ALWAYS_THINKS = ("deepseek-r1", "deepseek-ai/deepseek-r1")
NEVER_THINKS = ("llama", "meta-llama", "mixtral", "gemma", "mistral")


def cut_to(text: Column, n: int) -> Column:
    """The first n characters; '' for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def messages(user: Column, system: Column | None = None) -> Column:
    """The messages of a request: what the system says, if anything, then the user."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    if system is None:
        return F.array(message("user", user))
    return F.when(F.coalesce(system, F.lit("")) != "", F.array(message("system", system), message("user", user))).otherwise(F.array(message("user", user)))


def extra_body(model: Column, mode: Column) -> Column:
    """What a mode adds to a request, as JSON: nothing without thinking, nor for models that always or never think."""
    named = [F.lower(model).contains(x) for x in (*ALWAYS_THINKS, *NEVER_THINKS)]
    plain = mode == "non-think"
    for known in named:
        plain = plain | known
    return F.when(plain, F.lit("{}")).otherwise(F.lit(json.dumps({"chat_template_kwargs": THINKING}, separators=(",", ":"))))


def candidate_block(key: Column, chain: Column, code: Column) -> Column:
    """One candidate in a prompt: its key, the steps of its chain and the beginning of its code."""
    steps = F.when(F.size(chain) > 0, F.array_join(chain, " -> ")).otherwise("(none)")
    return F.concat(F.lit("### "), key, F.lit("\nchain: "), steps, F.lit("\ncode:\n"), cut_to(code, CODE_CHARS))


def file_rank_prompt(report: Column, outlines: Column, n: int = 10) -> Column:
    return F.concat(F.lit(f"Name the {n} files that most likely have to change, most likely first. Answer with JSON: {{\"files\": [{{\"path\": ..., \"reason\": ...}}]}}\n\nReport:\n"), cut_to(report, RANKED_REPORT_CHARS), F.lit("\n\nFiles:\n"), cut_to(outlines, OUTLINE_CHARS))


def symptom_prompt(report: Column) -> Column:
    return F.concat(F.lit("List what the report says went wrong. Answer with JSON with the keys exception_types, error_messages, stack_frames (file, func, line), behaviors, api_calls_named.\n\nReport:\n"), cut_to(report, REPORT_CHARS))


def chain_prompt(report: Column, symptoms: Column, drawing: Column, code: Column) -> Column:
    return F.concat(
        F.lit("For each function say how it could cause the symptoms, with a score from 0 to 10, and which functions to read next. Answer with JSON with the keys chains (function_key, chain, score) and next_to_explore.\n\nReport:\n"),
        cut_to(report, REPORT_CHARS), F.lit("\n\nSymptoms:\n"), cut_to(symptoms, SYMPTOM_CHARS), F.lit("\n\nGraph:\n"), cut_to(drawing, DRAWING_CHARS), F.lit("\n\nFunctions:\n"), code,
    )


def rerank_prompt(report: Column, candidates: Column) -> Column:
    return F.concat(F.lit("Order the candidates by how likely they have to change. Answer with JSON: {\"ranking\": [{\"id\": ..., \"confidence\": 0 to 1}]}\n\nReport:\n"), cut_to(report, REPORT_CHARS), F.lit("\n\nCandidates:\n"), cut_to(candidates, CANDIDATE_CHARS))


def drawn(candidates: DataFrame, n: int = 8) -> DataFrame:
    """instance_id, drawing: the first n candidates of each instance as the nodes of a Mermaid graph, with ids from a stable hash.

    candidates: instance_id, rank (from 1), node_id, file_path, qualname.
    """
    name = F.concat(F.lit("n"), F.substring(F.md5("node_id"), 1, 8))
    line = F.concat(F.lit("  "), name, F.lit('["'), F.element_at(F.split("file_path", "/"), -1), F.lit("::"), F.col("qualname"), F.lit('"]'))
    rows = candidates.filter(F.col("rank") <= n).groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select("instance_id", F.concat(F.lit("graph TD\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("drawing"))


def training_rows(pairs: DataFrame) -> DataFrame:
    """anchor, text, label: a report with its positive (1) and at most one negative (0). pairs: anchor, positive, negatives."""
    none = F.array().cast("array<struct<text:string,label:int>>")
    negative = F.transform(F.slice(F.coalesce("negatives", F.array().cast("array<string>")), 1, 1), lambda t: F.struct(t.alias("text"), F.lit(0).alias("label")))
    rows = F.concat(F.array(F.struct(F.col("positive").alias("text"), F.lit(1).alias("label"))), F.coalesce(negative, none))
    return pairs.select("anchor", F.explode(rows).alias("x")).select("anchor", "x.text", "x.label")
