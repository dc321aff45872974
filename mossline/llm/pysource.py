"""A tolerant scanner of Python source: function spans, comment spans and statements, also of files that don't parse.

It needs no grammar: strings, comments and brackets are told apart by one pattern, and a bracket that was never closed
ends where a line begins a definition, since none can stand inside brackets.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from typing import NamedTuple

TOKEN = re.compile(
    r"""(?P<comment>\#[^\r\n]*)
    |(?P<prefix>(?<![\w])[rRbBuUfFtT]{1,2}(?=["']))?(?P<quote>\"\"\"|'''|"|')
    |(?P<newline>\r\n|\r|\n)
    |(?P<joined>\\(?:\r\n|\r|\n))
    |(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<colon>:)|(?P<semicolon>;)""",
    re.X,
)
LONG_END = {'"""': re.compile(r'(?:[^\\]|\\.)*?"""', re.S), "'''": re.compile(r"(?:[^\\]|\\.)*?'''", re.S)}
SHORT_END = {'"': re.compile(r'(?:[^"\\\r\n]|\\(?:\r\n|.))*"?', re.S), "'": re.compile(r"(?:[^'\\\r\n]|\\(?:\r\n|.))*'?", re.S)}
HEAD = re.compile(r"(?:(?P<kind>(?:async[ \t\f]+)?def|class)[ \t\f]+(?P<name>[^\W\d]\w*))|(?P<decorator>@)")
RESUMES = re.compile(r"[ \t\f]*(?:@[^\r\n]*(?:\r\n|\r|\n)[ \t\f]*)*(?:async[ \t]+def|def|class)[ \t]+[^\W\d]\w*[ \t]*[(:\[]")
BREAK = re.compile(r"\r\n|\r|\n")


class Str(NamedTuple):
    start: int
    end: int
    prefix: str


@dataclass
class Statement:
    """One logical line: lines from 1, positions of its text, its strings and its first colon outside brackets."""

    line: int
    start: int
    indent: int
    last_line: int = 0
    end: int = 0
    colon: int = -1
    strings: list[Str] = field(default_factory=list)
    params: tuple[int, int] | None = None


class Function(NamedTuple):
    qualname: str
    name: str
    start_line: int
    anchor_line: int
    prev_line: int
    end_line: int
    signature: str
    docstring: str | None
    start: int
    end: int


class Comment(NamedTuple):
    start_line: int
    end_line: int
    indent: int
    text: str


def width(blanks: str) -> int:
    """Columns of an indent, tabs to multiples of eight, as Python counts them."""
    n = 0
    for c in blanks:
        n = 0 if c == "\f" else n // 8 * 8 + 8 if c == "\t" else n + 1
    return n


def statements(text: str) -> tuple[list[Statement], list[tuple[int, int, str]]]:
    """Logical lines in order, and (line, indent, text) of comments that stand alone on their line."""
    found: list[Statement] = []
    comments: list[tuple[int, int, str]] = []
    line, depth, at, line_start, size = 1, 0, 1 if text.startswith("﻿") else 0, 0, len(text)
    line_start = at
    now: Statement | None = None

    def begin(upto: int) -> None:
        """Notes code between `at` and `upto`."""
        nonlocal now
        piece = text[at:upto]
        bare = piece.lstrip(" \t\f")
        if bare.strip():
            if now is None:
                first = at + len(piece) - len(bare)
                now = Statement(line, first, width(text[line_start:first]))
            now.last_line, now.end = line, at + len(piece.rstrip())

    def close() -> None:
        nonlocal now, depth
        if now is not None:
            found.append(now)
        now, depth = None, 0

    while at < size:
        m = TOKEN.search(text, at)
        upto = m.start() if m else size
        begin(upto)
        if not m:
            break
        kind = m.lastgroup
        if kind == "comment":
            if not text[line_start:upto].strip():
                comments.append((line, width(text[line_start:upto]), m.group()))
            at = m.end()
        elif kind == "quote":
            quote = m.group("quote")
            body = (LONG_END if len(quote) == 3 else SHORT_END)[quote].match(text, m.end())
            stop = body.end() if body else size
            if now is None:
                now = Statement(line, upto, width(text[line_start:upto]))
            now.strings.append(Str(upto, stop, (m.group("prefix") or "").lower()))
            for b in BREAK.finditer(text, m.end(), stop):
                line, line_start = line + 1, b.end()
            now.last_line, now.end, at = line, stop, stop
        elif kind in ("newline", "joined"):
            if kind == "newline" and (depth == 0 or RESUMES.match(text, m.end())):
                close()
            line, line_start, at = line + 1, m.end(), m.end()
        else:
            if now is None:
                now = Statement(line, upto, width(text[line_start:upto]))
            now.last_line, now.end = line, m.end()
            if kind == "open":
                if depth == 0 and now.params is None and now.colon < 0:
                    now.params = (m.end(), -1)
                depth += 1
            elif kind == "close":
                depth = max(0, depth - 1)
                if depth == 0 and now.params is not None and now.params[1] < 0:
                    now.params = (now.params[0], upto)
            elif kind == "colon" and depth == 0 and now.colon < 0:
                now.colon = upto
            elif kind == "semicolon" and depth == 0:
                close()
            at = m.end()
    close()
    return found, comments


def literal(text: str, s: Str) -> str:
    raw = text[s.start : s.end]
    try:
        return ast.literal_eval(raw)
    except (SyntaxError, ValueError, MemoryError):
        body = raw[len(s.prefix) :]
        quote = body[:3] if body[:3] in LONG_END else body[:1]
        return body[len(quote) :].removesuffix(quote)


def string_only(text: str, strings: list[Str], start: int, end: int) -> str | None:
    """The value of text[start:end] if it is nothing but plain strings, also joined or in round brackets."""
    own = [s for s in strings if s.start >= start and s.end <= end]
    if not own or any(set(s.prefix) & set("bft") for s in own):
        return None
    rest, at = [], start
    for s in own:
        rest.append(text[at : s.start])
        at = s.end
    rest.append(text[at:end])
    gap = re.sub(r"#[^\r\n]*", "", "\n".join(rest))
    return "".join(literal(text, s) for s in own) if not gap.strip("();\\ \t\f\r\n") else None


def scan(text: str) -> tuple[list[Function], list[Comment]]:
    """The functions and methods of a file and its blocks of comment lines, in the order of their lines."""
    lines, alone = statements(text)
    comments: list[Comment] = []
    for line, indent, body in alone:
        if comments and comments[-1].end_line == line - 1:
            last = comments[-1]
            comments[-1] = Comment(last.start_line, line, last.indent, f"{last.text}\n{body}")
        else:
            comments.append(Comment(line, line, indent, body))
    functions: list[Function] = []
    scopes: list[tuple[int, str, int]] = []
    anchor, before = None, 0
    ends: dict[int, tuple[int, int]] = {}
    for i, s in enumerate(lines):
        head = HEAD.match(text, s.start)
        while scopes and s.indent <= scopes[-1][0] and (i == 0 or lines[i - 1].last_line < s.line or scopes[-1][0] > s.indent):
            scopes.pop()
        for _, _, k in scopes:
            if k >= 0:
                ends[k] = (s.last_line, s.end)
        if head and head.group("decorator"):
            anchor = anchor or s.line
            continue
        if head and not head.group("decorator"):
            name, k = head.group("name"), -1
            if head.group("kind") != "class":
                k = len(functions)
                a, b = s.params or (s.start, s.start)
                params = text[a : b if b >= 0 else s.end]
                functions.append(Function(".".join([*(n for _, n, _ in scopes), name]), name, s.line, anchor or s.line, before, s.last_line, f"({params})", docstring_of(text, lines, i), s.start, s.end))
                ends[k] = (s.last_line, s.end)
            scopes.append((s.indent, name, k))
        anchor, before = None, s.last_line
    return [f._replace(end_line=ends[k][0], end=ends[k][1]) for k, f in enumerate(functions)], comments


def docstring_of(text: str, lines: list[Statement], i: int) -> str | None:
    """The docstring of the function that statement i begins: the first statement of its body, if it is a plain string."""
    s = lines[i]
    if s.colon >= 0 and text[s.colon + 1 : s.end].strip():
        inline = re.sub(r"^\s*#[^\r\n]*", "", text[s.colon + 1 : s.end])
        if inline.strip():
            return string_only(text, s.strings, s.colon + 1, s.end)
    if i + 1 < len(lines) and lines[i + 1].indent > s.indent and lines[i + 1].line > s.last_line:
        n = lines[i + 1]
        return string_only(text, n.strings, n.start, n.end)
    return None
