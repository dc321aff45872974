"""Column functions over text: tokens, paths, node ids, model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and names that results depend on.
#: An identifier of two characters or more, ASCII only; applied before lower-casing, which would change what splits.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]+"
CAMEL = "[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)"
TEST_FILE = r"(^|/)tests?/|(/|^)tests?\.py$|(/|^)test_[^/]*\.py$|_test\.py$"
SKIPPED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "build", "dist", ".tox")


def identifiers(text: Column) -> Column:
    """Lower-cased identifiers of a text in order, with repetitions; [] for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    return F.transform(found, F.lower)


def code_tokens(text: Column) -> Column:
    """Identifiers, each followed by its snake parts and, if it has several, its camel parts, all in lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))

    def parts(token: Column) -> Column:
        snake = F.when(token.contains("_"), F.filter(F.split(token, "_"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
        camel = F.regexp_extract_all(token, F.lit(CAMEL), F.lit(0))
        return F.concat(F.array(token), snake, F.when(F.size(camel) > 1, camel).otherwise(F.array().cast("array<string>")))

    return F.transform(F.flatten(F.transform(found, parts)), F.lower)


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def test_penalty(value: Column, path: Column, factor: float = 0.5) -> Column:
    return F.when(is_test_file(path), value * factor).otherwise(value)


def whitespace_tokens(text: Column) -> Column:
    """How many tokens blanks separate."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def ancestor_dirs(path: Column) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def source_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive) of a text, joined by LF; lines may end in LF, CR or CRLF."""
    lines = F.split(content, "\r\n|\r|\n")
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), F.least(end, F.size(lines)) - first + 1)), "\n")


def import_path(statement: Column) -> Column:
    """The file that an import statement names: `from a.b import x` and `import a.b, c` give a/b.py; null for `from . import x`."""
    name = F.coalesce(
        F.nullif(F.regexp_extract(statement, r"^\s*from\s+\.*([\w.]*)\s*import\b", 1), F.lit("")),
        F.nullif(F.regexp_extract(statement, r"^\s*import\s+([\w.]+)", 1), F.lit("")),
    )
    return F.concat(F.translate(name, ".", "/"), F.lit(".py"))


def node_id(kind: str, *parts: Column) -> Column:
    """Ids of graph nodes: dir, file, class, func, stmt, concept, commit or symptom, then its parts."""
    return F.concat_ws("::", F.lit(kind), *[p.cast("string") for p in parts])


def last_part(name: Column, separator: str = r"\.") -> Column:
    return F.element_at(F.split(name, separator), -1)


def fenced_json(reply: Column) -> Column:
    """The text of the first code fence of a model's reply, or the whole reply without blanks around it."""
    inner = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.+?)\s*```", 1), F.lit(""))
    return F.coalesce(inner, F.trim(reply))


FRAME = T.StructType([T.StructField("file", T.StringType()), T.StructField("func", T.StringType()), T.StructField("line", T.IntegerType())])
SYMPTOMS = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType())) for n in ("exception_types", "error_messages")]
    + [T.StructField("stack_frames", T.ArrayType(FRAME))]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("behaviors", "api_calls_named")]
)


def symptoms_of_reply(reply: Column) -> Column:
    """Symptoms of a model's JSON reply; malformed text, array roots and missing fields give empty arrays."""
    parsed = F.from_json(fenced_json(reply), SYMPTOMS)
    return F.struct(*[F.coalesce(parsed[f.name], F.array().cast(f.dataType)).alias(f.name) for f in SYMPTOMS.fields])


def symptom_keywords(symptoms: Column) -> Column:
    """Exceptions, behaviours and named calls; error messages take no part."""
    return F.filter(F.concat(symptoms["exception_types"], symptoms["behaviors"], symptoms["api_calls_named"]), lambda k: k != "")


def symptom_text(symptoms: Column) -> Column:
    """Symptoms as labelled lines, five error messages at most."""
    frames = F.transform(symptoms["stack_frames"], lambda f: F.concat(f["file"], F.lit(":"), f["line"].cast("string"), F.lit(" in "), f["func"]))

    def line(name: str, values: Column, between: str = ", ") -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, between)))

    return F.concat_ws(
        "\n", line("Exceptions", symptoms["exception_types"]), line("Errors", F.slice(symptoms["error_messages"], 1, 5), " | "),
        line("Stack", frames, "; "), line("Behaviors", symptoms["behaviors"]), line("APIs", symptoms["api_calls_named"]),
    )


def extracted_symptoms(report: Column) -> Column:
    """Symptoms that patterns find in a report; stands in for a model where there is none."""
    text = F.coalesce(report, F.lit(""))
    every = lambda pattern, group=1: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    frame = r'File "([^"\n]+)", line (\d+), in (\w+)'
    at = lambda group: F.regexp_extract_all(text, F.lit(frame), F.lit(group))
    frames = F.transform(F.arrays_zip(at(1).alias("file"), at(3).alias("func"), at(2).alias("line")), lambda f: F.struct(f["file"].alias("file"), f["func"].alias("func"), f["line"].try_cast("int").alias("line")))
    return F.struct(
        every(r"\b([A-Z]\w*(?:Error|Exception|Warning|Overflow))\b").alias("exception_types"),
        every(r"(?m)^[A-Z]\w*(?:Error|Exception|Warning|Overflow): (.+)$").alias("error_messages"),
        frames.alias("stack_frames"),
        F.array().cast("array<string>").alias("behaviors"),
        every(r"`([A-Za-z_][\w.]*)`").alias("api_calls_named"),
    )


def request_text(*, model: Column, mode: Column, messages: Column, response_format: Column, temperature: Column, seed: Column) -> Column:
    """A request as JSON with its fields in alphabetical order, nulls among them; what doesn't change a reply takes no part.

    messages: array of structs with role and content; response_format: a struct with its fields in order, or null.
    """
    said = F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    fields = F.struct(said.alias("messages"), mode.alias("mode"), model.alias("model"), response_format.alias("response_format"), seed.alias("seed"), temperature.cast("double").alias("temperature"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def request_key(**parts: Column) -> Column:
    return F.sha2(request_text(**parts), 256)


def confidence_label(runs: Column, appearances: Column) -> Column:
    """high if in all runs, medium if in at least two and all but one, else low."""
    return F.when(appearances >= runs, "high").when(appearances >= F.greatest(F.lit(2), runs - 1), "medium").otherwise("low")


def run_variant(report: Column, run: Column, paraphrase: Column | None = None) -> Column:
    """The report as run 0, 1 or a later one sees it."""
    return F.when(run == 0, report).when(run == 1, F.concat(report, F.lit("\n\n[seed=2]"))).otherwise(F.coalesce(paraphrase, report) if paraphrase is not None else report)
