"""Functions paired with their documentation.

Function spans and comment spans are extracted independently of each other, by a scanner that also copes with files that
don't parse. An as-of join on lines then gives each function the nearest comment above it; the comment counts only if
nothing, not even a blank line, stands between the two. What the documentation says is judged last.
"""

from __future__ import annotations

import ast
import inspect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mossline.llm.pysource import scan

# Words and phrases that stand for documentation which nobody wrote.
PLACEHOLDERS = {
    "", "todo", "to do", "fixme", "xxx", "tbd", "tba", "wip", "na", "n a", "none", "null", "nothing", "empty", "stub", "dummy", "placeholder", "init",
    "doc", "docs", "docstring", "a docstring", "the docstring", "docstring here", "docstring goes here", "docstring for this function", "docstring for this method",
    "add docstring", "add docstring here", "add documentation", "missing docstring", "insert docstring here", "write me", "document me", "describe me", "describe this",
    "no description", "no docstring", "no documentation", "not documented", "undocumented", "no doc", "no docs", "no comment", "to be documented", "to be done", "to be written",
    "description", "summary", "description here", "summary here", "short description", "one line summary", "documentation", "documentation here", "documentation goes here",
    "description goes here", "help", "comment", "comments", "function", "method", "fill me in", "fill in", "coming soon", "lorem ipsum", "self explanatory", "ditto",
}
OPEN_TASK = re.compile(r"(?:todo|fixme|xxx|tbd|tba|hack)\b", re.I)
POINTER = re.compile(
    r"(?:please\s+)?(?:see|cf\.?|refer\s+to|look\s+at)\b[^.!?\n]{0,80}[.!]?|"
    r"\{?@?\(?inherit(?:ed|s|doc)?\b[^.!?\n]{0,60}\)?\}?[.!]?|"
    r"(?:same|just)\s+(?:as|like)\b[^.!?\n]{0,60}[.!]?|(?:as|described)\s+(?:above|below|before)[.!]?|"
    r"overr(?:ide|ides|idden|iding)\b[^.!?\n]{0,60}[.!]?|implements?\s+(?:the\s+)?(?:base|parent|super|abstract|interface)\b[^.!?\n]{0,50}[.!]?",
    re.I,
)
DIRECTIVE = re.compile(
    r"(?:noqa|type:|pylint:|flake8:|fmt:|yapf:|isort:|pragma[: ]|mypy:|pyright:|ruff:|nosec|nosonar|noinspection|pyre-|pytype:|black:|coverage:|codespell:|autopep8:|"
    r"region\b|endregion\b|-\*-|!|vim?:|%%|language=|doctest:|cython:|distutils:|sphinx-)",
    re.I,
)
UNFILLED = re.compile(r"_(?:summary|description|type|extended_summary|name|param|returns?)_|[\[<{](?:summary|description|type|insert[^\]>}]*|add[^\]>}]*|your[^\]>}]*|todo)[\]>}]", re.I)
SECTION = re.compile(r"(?:args|arguments|parameters|params|other parameters|keyword args|keyword arguments|kwargs|returns?|yields?|raises|throws|attributes|examples?|notes?|see also|references)\s*:?:?", re.I)
FIELD = re.compile(r"(?::(?:param|type|arg|keyword|raises?|returns?|rtype|ivar|var)\b[^:]*:|[*\w]+(?:\s*\([^)]*\))?\s*:)(.*)", re.S)
IDENTIFIER = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+")
# Words that add nothing to a function's own name.
FILLERS = set("a an the this that is it its of for to and or in on by with from as be do does function method func fn def routine helper procedure python self cls class object instance return returns".split())
INIT_WORDS = set("init initialize initializes initialise initialises initializer constructor construct constructs create creates new initialization initialisation".split())


def stem(word: str) -> str:
    word = word.lower()
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


CODE_LINE = re.compile(r"[\w.\[\]\"'* ,]+\s*(?:[-+*/|&%]|//|\*\*)?=\s*[^=\s].*|(?:return|yield|raise|del|assert|await)\s+[\w.]+\(.*\)|[\w.]+\(.*\)|(?:import|from)\s+[\w.]+.*|(?:if|for|while|with|elif|def|class)\b.*:|(?:else|try|finally):|(?:pass|break|continue)")


def is_code(lines: list[str]) -> bool:
    """Whether commented lines are code that was switched off: they parse, and as more than names and numbers, or all look so."""
    if lines and all(CODE_LINE.fullmatch(x.strip()) for x in lines):
        return True
    body = inspect.cleandoc("\n".join(lines)) if lines else ""
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        if len(lines) > 1 and all(is_code([x]) for x in lines if x.strip()):
            return True
        try:
            tree = ast.parse(body + "\n    pass")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    working = (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Return, ast.Import, ast.ImportFrom, ast.Raise, ast.Delete, ast.Assert, ast.Call, ast.FunctionDef, ast.ClassDef, ast.For, ast.While, ast.If, ast.With, ast.Try, ast.Pass, ast.Break, ast.Continue)
    return bool(tree.body) and any(isinstance(n, working) for n in ast.walk(tree))


def comment_text(block: str) -> str:
    """What a block of comment lines says: without marks, directives to tools and switched-off code."""
    lines = [re.sub(r"^#+:?[ ]?", "", line) for line in block.split("\n")]
    kept = [x for raw, x in zip(block.split("\n"), lines, strict=True) if not DIRECTIVE.match(x.strip()) and not raw.startswith("#!")]
    if is_code([x for x in kept if x.strip()]):
        return ""
    return inspect.cleandoc("\n".join(kept)).strip()


def documentation_of(name: str, text: str) -> str:
    """The cleaned documentation, or '' if it is trivial for a function of this name."""
    text = inspect.cleandoc(text.replace("\r\n", "\n").replace("\r", "\n")).strip()
    if OPEN_TASK.match(text.lstrip("#*-: ([@")):
        return ""
    said = []
    for line in UNFILLED.sub(" ", text).split("\n"):
        line = line.strip()
        if SECTION.fullmatch(line) or not re.search(r"\w", line):
            continue
        if (m := FIELD.fullmatch(line)) and not re.search(r"\w", m.group(1)):
            continue
        said.append(line)
    rest = " ".join(said)
    plain = " ".join(re.findall(r"\w+", rest.lower()))
    if plain in PLACEHOLDERS or not re.search(r"[^\W\d_]{2}", rest) or POINTER.fullmatch(rest):
        return ""
    if all(DIRECTIVE.match(x) for x in said):
        return ""
    own = re.sub(r"\W|_", "", name).lower()
    if re.sub(r"\W|_", "", rest).lower() == own or re.fullmatch(rf"`*{re.escape(name)}`*\s*\(.*\)\s*(?:->.*)?[.:]?", rest, re.S):
        return ""
    known = {stem(w) for w in IDENTIFIER.findall(name)} | {stem(w) for w in FILLERS}
    if own in ("init", "new"):
        known |= {stem(w) for w in INIT_WORDS}
    words = [w for token in re.findall(r"\w+", rest) for w in ([token] if token.lower() == own else IDENTIFIER.findall(token))]
    if all(stem(w) in known or w.lower() in FILLERS or re.sub(r"\W|_", "", w).lower() in own.split() for w in words):
        return ""
    return text


SPAN = "kind string, at int, qualname string, name string, start_line int, anchor_line int, end_line int, signature string, doc string, code string"


def latest_contents(files: DataFrame, *, keys: list[str], content: str, at: str) -> DataFrame:
    """_k0, _k1, ..., _content: of each key the content ingested last. Partial aggregates hold one content a key, so repeats of a key don't gather."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = files.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(at).alias("_at"), F.col(content).alias("_content")).dropna(subset=names)
    best = F.max_by("_content", F.struct("_at", F.xxhash64("_content")))
    return rows.groupBy(*names).agg(best.alias("_content")).filter("_content is not null and _content <> ''")


def source_spans(contents: DataFrame, names: list[str]) -> DataFrame:
    """Function spans ('f', at their first decorator and at their def, the code with the latter) and comment spans ('c', at their last line)."""
    kinds = ", ".join(f"{n} {contents.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *key, text in zip(*(batch[c] for c in [*names, "_content"]), strict=True):
                functions, comments = scan(text)
                for c in comments:
                    out.append((*key, "c", c.end_line, None, None, c.start_line, None, c.end_line, None, c.text, None))
                for f in functions:
                    for line in {f.anchor_line, f.start_line}:
                        out.append((*key, "f", line, f.qualname, f.name, f.start_line, f.anchor_line, f.end_line, f.signature, f.docstring, text[f.start : f.end] if line == f.start_line else None))
            yield pd.DataFrame(out, columns=[*names, *[x.split()[0] for x in SPAN.split(", ")]])

    return contents.select(*names, "_content").mapInPandas(run, f"{kinds}, {SPAN}")


@F.pandas_udf(StringType())
def judged(name: pd.Series, docstring: pd.Series, comment: pd.Series) -> pd.Series:
    out = []
    for n, d, c in zip(name, docstring, comment, strict=True):
        text = d if d is not None else comment_text(c) if c is not None else ""
        out.append(documentation_of(n, text) if text else "")
    return pd.Series(out, dtype="object")


def documented_functions(files: DataFrame, *, keys: list[str], content: str = "content", at: str = "ingested_at") -> DataFrame:
    """keys, qualname, start_line, end_line, signature, documentation, code: each def whose documentation says something.

    Of several rows with the same keys that with the latest `at` counts (nulls first, then the larger hash of the
    content). Null and empty contents give no row, nor do rows with a null key. Line ends may be LF, CR or CRLF. A def
    without docstring takes the comment lines that end on the line above its first decorator or above its `def`.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    spans = source_spans(latest_contents(files, keys=keys, content=content, at=at), names)
    above = Window.partitionBy(*names).orderBy("at", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    comment = F.when(F.col("kind") == "c", F.struct("end_line", "doc"))
    joined = spans.withColumn("_above", F.last(comment, ignorenulls=True).over(above)).filter("kind = 'f'")
    touching = F.when(F.col("doc").isNull() & (F.col("_above.end_line") == F.col("at") - 1), F.col("_above.doc"))
    functions = (
        joined.withColumn("_comment", touching)
        .groupBy(*names, "qualname", "start_line")
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("name", "end_line", "signature", "doc", "code")], F.max_by("_comment", F.when(F.col("_comment").isNotNull(), F.col("at"))).alias("_comment"))
        .filter("doc is not null or _comment is not null")
    )
    return (
        functions.withColumn("documentation", judged("name", "doc", "_comment"))
        .filter("documentation <> ''")
        .select(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)], "qualname", "start_line", "end_line", "signature", "documentation", "code")
    )
